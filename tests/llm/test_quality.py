import random

import numpy as np

from weftgraph.llm import quality as q


def rows(n=600, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(500)]
    out = []
    for i in range(n):
        g = r.choice([0, 1, 2, 2, 2])
        words = r.choices(vocab, k=r.choice([20, 100, 800]))
        if g == 1:
            words = [w + r.choice(["!!", "%%%"]) for w in words]
        if g == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["scum", "vejuxa", "vejuor", "idiot"]))
        out.append((i, " ".join(words), g))
    return out


def test_held_out_grades_and_monotone_tails(spark):
    x = rows()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in x], "doc_id long, text string, selected string, p_good double")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in x if i % 3], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in q.grade(docs, model).collect()}
    held = [(got[i], g) for i, _, g in x if i % 3 == 0]
    assert all(r.p_not_toxic >= r.p_good and abs(r.expected_grade - r.p_not_toxic - r.p_good) < 1e-9 for r in got.values())
    assert np.mean([(r.p_not_toxic < 0.5) == (g == 0) for r, g in held]) > 0.95
    assert np.mean([r.selected == (g == 2) for r, g in held]) > 0.93


def test_prediction_matches_plain_sums_and_ignores_neighbours():
    x = rows(80)
    model = q.fit([t for _, t, _ in x], [g for _, _, g in x])
    texts = [t for _, t, _ in x] + ["", None]
    mean, tail = q.predict(model, texts)
    for k, t in enumerate(texts):
        one, own = q.predict(model, [t])
        assert abs(one[0] - mean[k]) < 1e-9 and np.allclose(own[0], tail[k])
    col, a, b, shape = q._features([texts[0]], model.bits)
    z = sum(float(model.weights[c]) for c in set(col.tolist())) + float(shape[0] @ model.weights[-q.SHAPES :])
    assert np.allclose(tail[0], 1 / (1 + np.exp(model.thresholds - z)), atol=1e-4)


def test_nulls_repeats_long_and_empty(spark):
    x = rows(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in x], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, None), (3, 1, None), (999, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    texts, grades = q.sample(docs, labels)
    assert grades == [0, 2, 1] and len(texts) == 3
    model = q.train(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "a" * 300_000), (3, "b c"), (3, "b c")], "doc_id long, text string")
    got = q.grade(odd, model).collect()
    assert len(got) == 5 and got[0].p_good == got[1].p_good and got[3].p_good == got[4].p_good
    assert q.grade(odd.limit(0), model).count() == 0
    assert q.grade(odd, q.train(docs, labels.limit(0))).count() == 5
