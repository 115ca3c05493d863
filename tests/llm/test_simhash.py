import itertools
import random

import xxhash

from weftgraph.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute(texts: dict) -> dict:
    def fp(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {k: fp(t) for k, t in texts.items()}
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (f"{fps[k]:016x}", find(k)) for k in fps}


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choices(words, k=300) for _ in range(12)]
    texts, i = {}, 0
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(r.randrange(3)):
                c[r.randrange(len(c))] = r.choice(words)
            texts[i] = " ".join(c)
            i += 1
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "one", 1004: "ONE", 1005: "a b", 1006: "É é \x1f x y zz", 1007: "x " * 70000}
    return texts


def test_matches_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in texts.items()], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(texts)
    assert len({c for _, c in got.values()}) < len(got)
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == {c for _, c in got.values()}


def test_chain_within_radius_is_one_component(spark):
    fps = [0]
    for i in range(0, 60, 2):
        fps.append(fps[-1] | 3 << i)
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from weftgraph.llm.common import components

    got = components(simhash.links(prints)).collect()
    assert len(got) == len(fps) and len({r.component for r in got}) == 1


def test_covering_masks():
    family = [m % (1 << 64) for m in simhash.masks(2)]
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not (m >> i) & 1 and not (m >> j) & 1 for m in family)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "lonely words here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or -1) for r in simhash.representatives(docs).collect()) == [-1, 5]
