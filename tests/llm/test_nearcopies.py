import itertools
import random

import corpus_pipeline as cp


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """All pairs: similar ones, and of each document the smallest id reachable."""
    sets = {k: grams(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            pairs.add((a, b))
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return pairs, {k: find(k) for k in texts}


def test_stage_drops_near_copies_like_a_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(500)]
    texts = {}
    for k in range(120):
        w = r.choices(vocab, k=r.choice([8, 40, 150, 600, 6000 if k % 40 == 0 else 90]))
        texts[3 * k + 2] = " ".join(w)
        for j in range(k % 3):
            v = list(w)
            for _ in range(max(1, len(v) * r.choice([1, 2, 4]) // 130)):
                v[r.randrange(len(v))] = r.choice(vocab)
            texts[3 * k + j] = "  ".join(v).upper() if j else " ".join(v)
    texts |= {1000: None, 1001: "", 1002: " \n"}
    pairs, least = brute(texts)
    sets = {k: grams(t) for k, t in texts.items()}
    assert sum(sets[a] != sets[b] for a, b in pairs) > 40
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in cp.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert got == set(least.values())
    bare = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "k l m n o p"), (4, "K l m n o p"), (4, "other words here")], "doc_id long, text string")
    from weftgraph.llm import nearcopies

    assert sorted((x.doc_id or 0, x.text[0].lower()) for x in nearcopies.representatives(bare).collect()) == [(0, "a"), (4, "k"), (4, "o")]
    twice = spark.createDataFrame([(3, "al be ga de ep ze"), (5, "al be ga de ep ze"), (5, "on tw th fo fi si")], "doc_id long, text string")
    assert sorted((x.doc_id, x.text[:2]) for x in nearcopies.representatives(twice).collect()) == [(3, "al"), (5, "on")]
    assert nearcopies.representatives(twice.limit(0)).count() == 0


def test_simhash_brings_candidates(spark, monkeypatch):
    """Pairs that no band brings together are compared if their fingerprints link, and only linked if similar."""
    from weftgraph.llm import nearcopies

    seen = []
    links = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda prints: seen.append(prints.count()) or links(prints))
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "another text of some six words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(seen) == 1 and 2 <= seen[0] <= 3
    monkeypatch.setattr(nearcopies, "bands", lambda own: own[:0].view("int64"))
    sets = {k: nearcopies.shingles(x) for k, x in ((1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1])))}
    assert nearcopies.linked(sets, 0.8) == {1: 1, 2: 2, 3: 3}
    assert nearcopies.linked(sets, 0.8, {1: [7], 2: [7], 3: [7]}) == {1: 1, 2: 1, 3: 3}
