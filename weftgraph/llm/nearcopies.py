"""Near copies by exact Jaccard similarity of word shingles; SimHash and MinHash bands only bring candidates together.

SimHash fingerprints link at up to 2 bits, as in simhash. They can't do this job alone: texts of similarity 0.8 to 1 differ in 5 to 7 of 64 bits at the median, and covering masks
for that radius would be 127 tables, for the 10 bits that 0.8 leads to 2,047.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import components, cut, with_columns
from .simhash import _LOWER, fingerprints, links

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9995 at 0.8.
BANDS, ROWS = 25, 6
_draw = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.int64).astype(np.uint64)
_TIMES, _PLUS = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words, words as in simhash; a text of fewer is one shingle."""
    got = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not got:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(b" ".join(got), np.uint8)
    gaps = np.flatnonzero(buf == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(buf))
    n = max(1, len(got) - words + 1)
    return np.unique(textnum.spans(textnum.prefix(buf), starts[:n], ends[-n:]))


def digest(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; 0 for none."""
    x = xxhash.xxh64_intdigest(own.tobytes(), 7) if len(own) else 0
    return x - (1 << 64) if x >> 63 else x


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of the set's MinHash values; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 4096):
            least = np.minimum(least, (_TIMES * own[k : k + 4096] + _PLUS).min(1))
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            key = textnum.mix((key ^ row) * np.uint64(textnum.BASE))
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least `least`."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def linked(sets: dict[int, np.ndarray], least: float, more: dict[int, list[int]] | None = None) -> dict[int, int]:
    """Of each node the least node of its component, where nodes that share a band, or a key in `more`, and are similar link.

    A node that has been reached leaves its bands, so near copies of one text cost a comparison each.
    """
    keys = {n: list({*bands(s).tolist(), *(more or {}).get(n, [])}) for n, s in sets.items()}
    at: dict[int, set[int]] = {}
    for n, ks in keys.items():
        for k in ks:
            at.setdefault(k, set()).add(n)
    root: dict[int, int] = {}
    for first in sorted(sets):
        if first in root:
            continue
        todo = [first]
        root[first] = first
        for k in keys[first]:
            at[k].discard(first)
        while todo:
            n = todo.pop()
            for m in set().union(*(at[k] for k in keys[n])):
                if similar(sets[n], sets[m], least):
                    root[m] = first
                    todo.append(m)
                    for k in keys[m]:
                        at[k].discard(m)
    return root


def near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, same (hash of the text), node (hash of the text's shingles), root
    (the component's least node) and component_id.

    Texts whose sets of shingles have a Jaccard similarity of at least `least` link, and component_id is the smallest
    doc_id reachable. Equal sets meet as one node. Nodes that share a band, or whose SimHash fingerprints over the same
    shingles are linked by chains of steps of up to 2 bits, form groups, which may be too large; inside
    each, whole texts are compared, so a link is never a guess, and one worker holds a group's shingles. Null, empty
    and blank texts are one node; a null doc_id takes the component's smallest known id.
    """

    def made(texts: list) -> list[pa.Array]:
        sets = [shingles(t, words) for t in texts]
        return [pa.array([digest(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]

    fields = [T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    marked = with_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("same")), "text", fields, made)
    marked = cut(fingerprints(marked, words=words).drop("text"))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("same", "doc_id"), F.min("same")).alias("same"))
    prints = cut(marked.select("node", "fp").distinct())
    near = cut(components(links(prints.select("fp").distinct()))).select(F.col("node").alias("fp"), "component")
    alike = prints.join(near, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key")).distinct()
    keyed = marked.select("node", F.explode("bands").alias("key")).unionByName(alike).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "lo")
    rough = cut(components(keyed.join(shared, "key").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct()))
    wanted = nodes.join(rough, "node").join(alike.groupBy("node").agg(F.collect_set("key").alias("alike")), "node")
    wanted = wanted.select("node", F.col("first_id").alias("_weft_id"), F.col("same").alias("_weft_same"), "component", "alike")
    texts = docs.select("doc_id", "text")
    texts = texts.join(wanted, texts.doc_id.eqNullSafe(wanted._weft_id) & (F.xxhash64("text") == wanted._weft_same)).select("component", "node", "text", "alike")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for n, t in zip(pdf["node"], pdf["text"], strict=True):
            if n not in sets:
                sets[n] = shingles(t, words)
        root = linked(sets, least, {n: list(k) for n, k in zip(pdf["node"], pdf["alike"], strict=True)})
        return pd.DataFrame({"node": list(root), "root": list(root.values())})

    found = texts.groupBy("component").applyInPandas(compare, "node long, root long")
    of = cut(nodes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")))
    of = of.join(of.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "root", "component_id")
    return marked.join(of, "node").select("doc_id", "same", "node", "root", "component_id")


def representatives(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """docs without the near copies: one row of each component, that of its smallest doc_id.

    Of several rows of that id the one with the least hash of its text stays, so texts that share an id and belong to
    different components both stay. Null ids come after all others. Rows alike in id and text are one. An empty table
    gives no rows; other columns are untouched, and of rows alike in id and text any one's are kept.
    """
    groups = near_duplicates(docs, least, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
    keep = cut(groups.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("_weft_id"), F.col("k.same").alias("_weft_same")).distinct())
    rows = docs.withColumn("_weft_hash", F.xxhash64("text"))
    rows = rows.join(keep, rows.doc_id.eqNullSafe(keep._weft_id) & (rows._weft_hash == keep._weft_same), "left_semi")
    return rows.dropDuplicates(["doc_id", "_weft_hash"]).drop("_weft_hash")
