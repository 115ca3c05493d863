import random
import zlib

import numpy as np

from weftgraph.llm import langid

VOWELS = {"aa": "ka ta ra na", "bb": "öl üm äs ßt", "cc": "ñi ll ció rr"}


def text(lang, r, n):
    return " ".join("".join(r.choices(VOWELS[lang].split(), k=r.randrange(1, 4))) for _ in range(n))


def rows(n=240, seed=2):
    r = random.Random(seed)
    return [(i, text(lang := r.choice(list(VOWELS)), r, r.choice([5, 20, 400])), lang, "src") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_contract(spark):
    docs = langid.held_out(spark.createDataFrame(rows(), SCHEMA))
    model = langid.train(docs.where("not held_out"), bits=12)
    got = langid.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in VOWELS for r in got)


def test_und_nulls_ties_and_long_texts(spark):
    r = random.Random(4)
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = langid.train(docs, bits=12)
    long = text("bb", r, 200_000)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (3, "12 !! ²", None, None), (4, "ö", None, None), (5, long, None, None), (5, long, None, None), (None, "ka", None, None)], SCHEMA)
    got = langid.identify(odd, model).collect()
    assert [x.lang_pred == "und" for x in got] == [True, True, True, False, False, False, False]
    assert [x.score for x in got[:3]] == [0.0] * 3 and not any(x.accepted for x in got[:3])
    assert got[4].lang_pred == "bb" and got[4].score == got[5].score and got[4].accepted
    assert langid.identify(odd.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {x.lang_pred for x in langid.identify(odd, empty).collect()} == {"und"}


def test_prediction_does_not_depend_on_neighbours():
    x = rows(60)
    model = langid.fit([t for _, t, _, _ in x], [c for _, _, c, _ in x], bits=12)
    texts = [t for _, t, _, _ in x]
    langs, scores = langid.predict(model, texts)
    for t, a, s in zip(texts, langs, scores, strict=True):
        b, u = langid.predict(model, [t])
        assert b == [a] and u[0] == s


def test_against_plain_average():
    x = rows(60)
    model = langid.fit([t for _, t, _, _ in x], [c for _, _, c, _ in x], bits=12)
    t = "Ka, TA-rr öl!"
    buf = b" " + t.lower().encode()
    buf = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in buf)
    z = []
    for size in langid.SIZES:
        for i in range(len(buf)):
            g = (buf + b" " * 8)[i : i + size]
            key = int.from_bytes(g, "little")
            z.append(model.table[((key + size) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - model.bits)])
    z = (np.mean(z, axis=0) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    lang, score = langid.predict(model, [t])
    assert lang[0] == model.langs[int(p.argmax())] and abs(score[0] - p.max()) < 1e-5
