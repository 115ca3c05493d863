import random

import numpy as np

from weftgraph.llm import decontaminate as dc
from weftgraph.llm import textnum


def vocabulary(r, n=900):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(n)]


def world(seed=1, n_items=25, n_docs=250):
    """Items, documents of a Zipf vocabulary, and what was planted: exact and with words changed, dropped and added."""
    r = random.Random(seed)
    vocab = vocabulary(r)
    weights = [1 / (k + 5) for k in range(len(vocab))]
    say = lambda k: r.choices(vocab, weights, k=k)
    items = {i: say(r.randrange(16, 60)) for i in range(n_items)}
    docs, planted = {}, set()
    for d in range(n_docs):
        words = say(r.choice([5, 60, 300, 1500]))
        if d % 5 == 0:
            i = r.randrange(n_items)
            text = list(items[i])
            if d % 10 == 0:
                for k in range(0, len(text), 9):
                    text[k] = r.choice(vocab)
                del text[3]
            at = r.randrange(len(words) + 1)
            words[at:at] = text
            planted.add((d, i))
        docs[d] = " ".join(words)
    return {i: " ".join(x) for i, x in items.items()}, docs, planted


def brute(items, docs, lcs=0.7, answer=0.5):
    """All pairs, quadratic dynamic programming over every span of the length that the operator allows."""

    def length(a, b):
        row = np.zeros(len(b) + 1, int)
        for x in a:
            new = row.copy()
            for j, y in enumerate(b, 1):
                new[j] = max(new[j - 1], row[j - 1] + 1 if x == y else row[j])
            row = new
        return row[-1]

    got = set()
    for d, t in docs.items():
        h = textnum.words([t])[0].tolist()
        for i, s in items.items():
            w = textnum.words([s])[0].tolist()
            n = len(w)
            span = n + max(4, n // 4)
            own = set(w)
            upto = np.cumsum([0, *(x in own for x in h)])
            for k in range(len(h)):  # every span
                part = h[k : k + span]
                if h[k] in own and upto[k + len(part)] - upto[k] >= lcs * n and length(w, part) >= lcs * n:
                    got.add((d, i))
                    break
    return got


def frames(spark, items, docs):
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = spark.createDataFrame([(k, t, "x", 1.0) for k, t in docs.items()], "doc_id long, text string, item_id string, cosine double")
    return d, b


def test_recall_against_brute_force(spark):
    items, docs, planted = world()
    d, b = frames(spark, items, docs)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    want = brute(items, docs)
    assert planted <= want
    assert len(got & want) >= 0.97 * len(want) and not {x for x in got if x not in want and x not in planted}
    assert {x for x in planted if x[0] % 10} <= got  # exact copies
    kept = {r.doc_id for r in dc.clean(d, b).collect()}
    assert kept == set(docs) - {x for x, _ in got}


def test_distributed_products_and_subspace_match_dense_ones(spark):
    _, docs, _ = world(n_docs=40)
    df = spark.createDataFrame([(t,) for t in docs.values()], "t string").repartition(3)
    idf = np.ones(1 << dc.BITS)
    row, col, val, n = dc._tfidf(list(docs.values()), idf)
    a = np.zeros((n, 1 << dc.BITS), np.float32)
    a[row, col] = val
    omega = np.random.default_rng(0).standard_normal((1 << dc.BITS, 6)).astype(np.float32)
    back, gram = dc._apply(df, idf, omega)
    y = a @ omega
    assert np.allclose(back, a.T @ y, atol=1e-2) and np.allclose(gram, y.T @ y, rtol=1e-3)
    right = np.linalg.svd(a, full_matrices=False)[2]
    got = dc.latent(df, idf, rank=4, over=60, power=2)
    q = np.linalg.qr(got)[0]
    assert np.linalg.norm(right[1:3] @ q, axis=1).min() > 0.97 and np.linalg.norm(right[:1] @ q) < 0.2


def test_bit_parallel_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a, b = r.choices(range(6), k=r.randrange(1, 20)), r.choices(range(7), k=r.randrange(0, 25))
        item = dc.Item(0, np.array(a))
        for k, w in enumerate(a):
            item.mask[w] = item.mask.get(w, 0) | 1 << k
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        assert dc.subsequence(item, b)[1] == t[-1][-1]


def test_window_vectors_match_plain_sums():
    r = np.random.default_rng(0)
    lengths = np.array([0, 3, 31, 32, 33, 48, 49, 200, 0, 16] * 12)
    end = np.cumsum(lengths)
    start, stop, own = dc._windows(end - lengths, end)
    assert [(own == i).any() for i in range(len(lengths))] == [x > 0 for x in lengths]
    h = r.integers(0, 1 << 63, end[-1]).astype(np.uint64)
    embed = r.standard_normal((1 << dc.BITS, 6)).astype(np.float32)
    got = dc._embed(h, end - lengths, end, embed)
    for k in range(len(start)):
        v = embed[dc._ids(h[start[k] : stop[k]])].sum(0)
        assert np.allclose(got[k], v / np.linalg.norm(v), atol=1e-4)
    for i, n in enumerate(lengths):  # every word stands in a window
        assert set().union(*(range(a, b) for a, b, o in zip(start, stop, own, strict=True) if o == i)) == set(range(end[i] - n, end[i]))


def test_nulls_repeats_long_and_empty(spark):
    items, docs, _ = world(n_items=4, n_docs=40)
    leak = items[1]
    d = [(1, None), (2, ""), (None, "so " + leak), (3, leak), (3, leak), (4, "zq " * 60_000 + leak + " yy" * 60_000), *((100 + k, t) for k, t in docs.items() if k % 5)]
    df = spark.createDataFrame(d, "doc_id long, text string")
    b = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "zq"), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in dc.contaminated(df, b).collect())
    assert got == [(-1, 1), (3, 1), (3, 1), (4, 1)]
    assert dc.contaminated(df.limit(0), b).count() == 0 and dc.contaminated(df, b.limit(0)).count() == 0
    assert {r.doc_id for r in dc.clean(df, b).collect()} == {x for x, _ in d} - {None, 3, 4}


def test_short_items_in_long_documents(spark):
    """Items of 5 to 20 words, exact or with a word changed, are found among hundreds of other words."""
    r = random.Random(6)
    vocab = vocabulary(r)
    weights = [1 / (k + 5) for k in range(len(vocab))]
    items = {i: r.choices(vocab, weights, k=5 + i % 16) for i in range(80)}
    docs, planted = {}, set()
    for d in range(160):
        words = r.choices(vocab, weights, k=300)
        text = list(items[d % 80])
        if d >= 80 and len(text) >= 8:
            text[2] = "zzzz"
        at = r.randrange(301)
        words[at:at] = text
        docs[d] = " ".join(words)
        planted.add((d, d % 80))
    items = {i: " ".join(w) for i, w in items.items()}
    d, b = frames(spark, items, docs)
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()}
    assert planted <= got


def test_scripts_without_spaces_and_very_short_items(spark):
    r = random.Random(9)
    han = [chr(0x4E00 + k) for k in range(3000)]
    thai = [chr(0x0E01 + k) for k in range(40)]
    items = {0: "".join(r.choices(han, k=40)) + "。" + "".join(r.choices(han, k=12)), 1: "".join(r.choices(thai, k=60)), 2: "Quite Short, item", 3: "".join(r.choices(han, k=3)), 4: "one"}
    docs = {0: "前面的话" + items[0] + "后面，的话", 1: "before " + items[1] + "กขค after", 2: "a quite short item b", 3: "又" + items[3] + "了", 4: "short quite item one", 5: "".join(r.choices(han, k=200))}
    docs[6] = items[0][:20] + "，" + items[0][20:]
    d, b = frames(spark, items, docs)
    assert {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (6, 0)}


def test_recall_where_the_fit_is_a_small_sample(spark):
    """Of 250 documents at most 12 are in the fit, and the last ones have a vocabulary that no drawn one has."""
    items, docs, planted = world(seed=4)
    other, more, _ = world(seed=5, n_items=6, n_docs=10)
    items |= {100 + i: t.upper().replace("A", "X1") for i, t in other.items()}
    for d, t in more.items():
        docs[1000 + d] = t.upper().replace("A", "X1")
    d, b = frames(spark, items, docs)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, fit_docs=6).collect()}
    want = brute(items, docs)
    assert planted <= want and len(got & want) >= 0.99 * len(want)


def test_the_fit_has_all_documents(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(dc, "latent", lambda passages, idf, rank: fitted.append(passages.count()) or np.ones((1 << dc.BITS, 2), np.float32))
    docs = spark.range(7000).selectExpr("id as doc_id", "concat('word', id) as text")
    bench = spark.createDataFrame([(1, "one item of five words")], "item_id long, text string")
    assert dc.contaminated(docs, bench).count() == 0
    assert fitted == [7001]


def test_shares_are_those_of_the_best_span():
    r = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    for _ in range(60):
        n = r.randrange(5, 12)
        item_text, text = " ".join(r.choices(words, k=n)), r.choices(words, k=40)
        items, _, _ = dc._items([{"item_id": 1, "text": item_text}], np.zeros((1 << dc.BITS, 2), np.float32))
        index = dc.Index(np.zeros((1 << dc.BITS, 2), np.float32), np.zeros((1, 2), np.float32), np.zeros(1, int), items, 0.5, 0.1, 0.5, np.zeros(1 << dc.BITS))
        h = textnum.words([" ".join(text)])[0].tolist()
        reach = n + max(4, n // 4)
        best = max(dc.subsequence(items[0], h[k : k + reach])[1] for k in range(40))
        assert dc._judge(index, items[0], h, 0, 40)[0] == best / n


def test_one_word_items(spark):
    docs = spark.createDataFrame([(1, "Yes!"), (2, "yes it is"), (3, None), (4, "no")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "yes"), (8, "?!"), (9, None)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in dc.contaminated(docs, bench).collect()] == [(1, 7)]


def test_documents_are_cut_into_words_once_for_counts_and_fit(spark, monkeypatch):
    """The fit's passes read stored words, those of all whole texts, and no text again."""
    fitted = []
    monkeypatch.setattr(dc, "latent", lambda passages, idf, rank: fitted.append((passages.columns, passages.inputFiles(), [r.ids for r in passages.collect()])) or np.ones((1 << dc.BITS, 2), np.float32))
    texts = [None, "", "Zwei zwei drei", "\u4e00\u4e8c\u3002\u4e09 a\u2013b", "w " * 90_000, *(f"x{k % 7} y{k}" for k in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dc.contaminated(docs, spark.createDataFrame([(1, "one item of five words")], "item_id long, text string")).count() == 0
    [(columns, files, got)] = fitted
    assert columns == ["ids"] and files
    want = [dc._ids(dc._words([t or ""])[0]).astype("<u2") for t in [*texts, "one item of five words"]]
    assert sorted(map(bytes, got)) == sorted(x.tobytes() for x in want)
    df, n = dc.document_frequencies(dc.tokens(docs.withColumnRenamed("text", "t")))
    assert n == len(texts)
    assert (df == sum(np.bincount(np.unique(x), minlength=1 << dc.BITS) for x in want[:-1])).all()


def test_products_of_frequent_and_rare_words_and_all_lengths():
    r = np.random.default_rng(2)
    lengths = np.array([0, 1, 15, 16, 17, 31, 32, 33, 48, 300, 0, 2500])
    ends = np.cumsum(lengths)
    ids = np.minimum(r.geometric(0.004, ends[-1]), 4000)
    ids[::3] = 7
    idf = np.append(r.random(1 << dc.BITS) + 1, 0.0)
    omega = r.standard_normal((1 << dc.BITS, 5)).astype(np.float32)
    table = np.concatenate([omega * idf[:-1, None].astype(np.float32), np.zeros((1, 5), np.float32)])
    back, gram = np.zeros(omega.shape, np.float32), np.zeros((5, 5))
    dc._products(ids, ends - lengths, ends, idf, table, back, gram)
    start, end, _ = dc._windows(ends - lengths, ends)
    a = np.array([np.bincount(ids[x:y], minlength=1 << dc.BITS) * idf[:-1] for x, y in zip(start, end, strict=True)])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    y = a @ omega
    assert np.allclose(gram, y.T @ y, rtol=1e-3, atol=1e-3) and np.allclose(back * idf[:-1, None], a.T @ y, atol=1e-3)


def test_no_match_is_left_for_its_words():
    r = random.Random(8)
    words = [f"w{k}" for k in range(14)]
    mark = np.zeros(1 << dc.BITS, bool)
    met = 0
    for _ in range(400):
        n = r.choice([1, 2, 3, 5, 6, 9, 12])
        own = r.choices(words, k=n)
        items, _, _ = dc._items([{"item_id": 1, "text": " ".join(own)}], np.zeros((1 << dc.BITS, 2), np.float32))
        index = dc.Index(np.zeros((1 << dc.BITS, 2), np.float32), np.zeros((1, 2), np.float32), np.zeros(1, int), items, 0.5, 0.7, 0.5, np.zeros(1 << dc.BITS))
        text = r.choices(words, k=r.choice([0, 8, 20])) + [w for w in own if r.random() < 0.8]
        h = textnum.words([" ".join(text or own)])[0]
        found = dc._judge(index, items[0], h.tolist(), 0, len(h), len(h) == 1)[0] >= 0.7
        met += found
        covered = dc._covered(index, 0, dc._ids(h), mark)
        assert not mark.any() and (covered or not found)
    assert met > 20
