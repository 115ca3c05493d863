import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from weftgraph.llm import suffixes as sx


def brute(texts, length=100):
    """(n_removed, n_spans, digest) of each text, in order, with a set of all strings seen."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    say = lambda k: " ".join("".join(r.choices("abcdeé", k=r.randrange(1, 8))) for _ in range(k))
    passages = [say(r.randrange(10, 90)) for _ in range(8)]
    texts = []
    for i in range(n):
        t = say(r.choice([0, 3, 30, 200]))
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            at = r.randrange(len(t) + 1)
            t = t[:at] + p[a : a + r.choice([40, 99, 100, 101, 400])] + t[at:]
        if i % 9 == 0 and texts:
            t = texts[r.randrange(len(texts))]
        if i % 13 == 0 and texts:
            t = texts[r.randrange(len(texts))] + "x" + t
        texts.append(t)
    texts += ["a" * 99, "a" * 100, "a" * 350, "ab" * 200, "", "é" * 120, "".join(r.choices("ab", k=3000))]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "chunk", "bucket", "hot"), [(1, 1 << 14, 1 << 16, 64), (2, 1 << 13, 1 << 15, 1), (3, 4 << 20, 16 << 20, 64)])
def test_matches_brute_force(spark, monkeypatch, seed, chunk, bucket, hot):
    monkeypatch.setattr(sx, "CHUNK", chunk)
    monkeypatch.setattr(sx, "BUCKET", bucket)
    if hot != 64:
        monkeypatch.setattr(sx, "HOT", hot)
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(-500, 500), len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, g string, kind int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sx.remove_repeats(df).collect()}
    order = sorted(zip(ids, texts, strict=True))
    want = dict(zip([i for i, _ in order], brute([t for _, t in order]), strict=True))
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_hot_anchors_send_string_hashes():
    """The two ways of comparing agree; run in one process, where the limit can be changed."""
    texts = [t.encode() for t in corpus(5, 60)]
    import pandas as pd

    def run(hot, piece=sx.PIECE):
        sx.HOT, sx.PIECE, old = hot, piece, (sx.HOT, sx.PIECE)
        try:
            docs = pd.DataFrame({"doc_id": range(len(texts)), "text": [t.decode() for t in texts], "oid": range(len(texts)), "tie": 0, "g": [i % 5 for i in range(len(texts))]})
            none = pd.DataFrame({"oid": [], "tie": [], "kind": [], "data": []})
            groups = [x for _, x in docs.groupby("g")]
            told = pd.concat([sx._announce(100, 3)(x, none) for x in groups])
            back = pd.concat([sx._answer(x) for _, x in told.groupby("bucket")])
            sent = pd.concat([sx._send(100, 3)(x, back[back.g == x.g.iloc[0]].assign(oid=0, tie=0)) for x in groups])
            found = pd.concat([sx._merge(100)(x) for _, x in sent.groupby("bucket")])
            rows = pd.concat([sx._finish(100, False)(x, found[found.g == x.g.iloc[0]].assign(oid=0, tie=0)) for x in groups])
            return set(sent.kind), dict(zip(rows.doc_id, zip(rows.n_removed, rows.n_spans, rows.kept_sha256, strict=True), strict=True))
        finally:
            sx.HOT, sx.PIECE = old

    kinds, hot = run(1)
    assert kinds >= {1, 2} or 2 in kinds
    few, cold = run(64)
    assert 1 in few and 2 not in few
    want = brute([t.decode() for t in texts])
    assert run(64, 150)[1] == run(1, 333)[1] == hot  # documents cut into overlapping pieces
    assert hot == cold == {i: x[1:] for i, x in enumerate(want)}


def test_loser_tree_sorts_and_knows_common_prefixes():
    r = random.Random(4)
    for _ in range(60):
        runs = [sorted(bytes(r.choices(b"ab", k=r.randrange(0, 12))) for _ in range(r.randrange(0, 15))) for _ in range(r.randrange(1, 9))]
        common = [sx.front_code(x)[0] for x in runs]
        tree = sx.LoserTree(runs, common)
        got = [(runs[a][k], c) for a, k, c in tree]
        flat = sorted(s for x in runs for s in x)
        assert [s for s, _ in got] == flat
        for (a, _), (b, c) in zip(got, got[1:], strict=False):
            assert c == sx.shared(a, b, 0)
        assert all(sx.unfold(*sx.front_code(x)) == x for x in runs)


def test_loser_tree_reads_known_prefixes_once():
    runs = [[b"p" * 200 + bytes([k, j]) for j in range(100)] for k in range(8)]
    tree = sx.LoserTree(runs, [sx.front_code(x)[0] for x in runs])
    list(tree)
    assert tree.compared < 8 * 201 + 800 * 6


def test_nulls_repeats_long_and_empty(spark):
    r = random.Random(6)
    p = "".join(r.choices("abcdefgh ", k=300))
    long = "".join(r.choices("xyz", k=200_000))
    df = spark.createDataFrame([(None, p), (3, None), (3, None), (4, p + "q"), (4, "z" + p), (5, long + p), (5, long + p), (6, "")], "doc_id long, text string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, x.n_removed) for x in sx.remove_repeats(df).collect())
    assert got == [(-1, 300, 0), (3, 0, 0), (4, 301, 300), (4, 301, 300), (5, 200_300, 300), (6, 0, 0)]
    assert sx.remove_repeats(df.limit(0)).count() == 0
    kept = {x.doc_id: bytes(x.kept) for x in sx.remove_repeats(df.where("doc_id = 5 or doc_id is null"), keep_text=True).collect()}
    assert kept[5] == long.encode() and kept[None] == p.encode()


def test_equal_hashes_of_different_strings_are_told_apart():
    table = np.frombuffer(b"aaaaabbbbbaaaaabbbbbccccc", np.uint8).reshape(5, 5)
    late = sx._verified(table, np.zeros(5, int), 5, np.arange(5), np.array([1, 1, 1, 1, 4]), np.array([3, 0, 1, 2, 4]))
    assert late.tolist() == [True, False, False, True, False]


def test_long_text_is_worked_on_in_pieces():
    """64 MB of text in one document within 1.5 GB, the interpreter and its libraries included."""
    code = """
import resource, numpy as np, pandas as pd
from weftgraph.llm import suffixes as sx
r = np.random.default_rng(1)
text = bytes(r.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 1 << 26)).decode()
docs = pd.DataFrame({"doc_id": [1], "text": [text], "oid": [1], "tie": [0], "g": [0]})
none = pd.DataFrame({"oid": [], "tie": [], "kind": [], "data": []})
n = len(sx._announce(100, 4)(docs, none))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout.split()[-1]) < 1500
