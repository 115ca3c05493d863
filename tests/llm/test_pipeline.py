import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_nearcopies import brute as groups

SYLLABLES = {"en": "th er on an re ing ed ou ha", "de": "sch ung keit ich ä ö ein ver", "fr": "eau oi é è ment eux ou lle"}


def corpus():
    r = random.Random(8)

    def prose(lang, n):
        s = SYLLABLES[lang].split()
        return " ".join("".join(r.choices(s, k=r.randrange(1, 5))) for _ in range(n))

    items = [(i, prose("en", 30)) for i in range(6)]
    rows = []
    for i in range(200):
        lang = r.choice(list(SYLLABLES))
        rows.append([i, prose(lang, r.choice([40, 150, 400])), lang, "s"])
    for i in range(200, 230):  # near and exact copies
        src = rows[r.randrange(200)]
        w = src[1].split()
        if i % 2 and len(w) > 300:
            w[5] = "changed"
        rows.append([i, " ".join(w), src[2], "s"])
    for i in range(230, 240):
        rows.append([i, prose("en", 50) + " " + items[i % 6][1] + " " + prose("en", 50), "en", "s"])
    rows += [[240, None, None, None], [241, "12 34 !!", "en", "s"], [242, "mail ab.c@mail.example.com from 10.1.2.3 " + prose("en", 60), "en", "s"]]
    return items, [(*x, len(x[1] or "")) for x in rows]


def test_stages_match_brute_force(spark, tmp_path):
    items, rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert set(before) - ids == {240, 241}
        elif name == "near_dedup":
            assert ids == set(groups(before)[1].values()) and len(ids) < len(before)
        elif name == "decontamination":
            assert set(before) - ids == {i for i, t in before.items() if any(x in t for _, x in items)} != set()
        elif name == "pii_surrogates":
            assert ids == set(before)
            changed = {r.doc_id for r in after if r.text != before[r.doc_id]}
            assert changed == {242} and all(r.n_chars == len(r.text) for r in after)
        else:
            tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(r.length for r in after) == sum(len(tk.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
            assert ids == set(before)
        seen.append(name)
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, after)) and len(seen) == 5


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Each stage over null ids and texts, texts that share an id, rows alike, and no rows; no stage fails or adds rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    _, rows = corpus()
    odd = [(None, None, None, None, None), (None, rows[3][1], "en", None, None), (7, rows[4][1], "en", "s", 1), (7, rows[5][1], None, "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        if name == "language_id":  # it learns from its own input
            given = rows[:60] + odd
        else:
            given = odd
        out = stage(spark, spark.createDataFrame(given, schema).withColumn("bin", F.lit(1)), str(tmp_path)).collect()
        n = {"near_dedup": 4, "decontamination": 6, "pii_surrogates": 6}.get(name)
        assert n is None or len(out) == n, name
        if k:
            assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
