"""SimHash near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, with_columns

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 for null and for a text without words.

    Words are runs of bytes other than ASCII white space after A-Z are lower-cased, shingles are `words` consecutive
    words joined by a space, repeats included, and a text of fewer words is one shingle. A bit is set if more than
    half of the shingles' XXH64 values (seed 42) have it.
    """
    import xxhash

    got = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not got:
        return 0
    h = xxhash.xxh64_intdigest
    if len(got) <= words:
        return h(b" ".join(got), 42)
    grams = zip(*(got[i:] for i in range(words)), strict=False)
    n = len(got) - words + 1
    hashes = np.fromiter((h(b" ".join(g), 42) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


#: bytes.split() without arguments splits at exactly 09-0D and 20.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = 3) -> DataFrame:
    """docs with its fingerprint as a signed long column, over whole texts."""

    def made(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return with_columns(docs, text, [T.StructField(out, T.LongType())], made)


def masks(radius: int) -> list[int]:
    """The 2^(r+1)-1 bit masks of the covering family, as signed 64-bit integers.

    Bit i carries the nonzero vector m(i) of r+1 bits, and mask v keeps the bits with odd <m(i), v>. Any r differing
    bits give r equations in r+1 unknowns, so some nonzero v drops them all: such a pair agrees on mask v.
    """
    size = 2 ** (radius + 1) - 1
    spread = [1 + (i * 5 + i // size) % size for i in range(BITS)]
    got = []
    for v in range(1, size + 1):
        x = sum(1 << i for i in range(BITS) if bin(spread[i] & v).count("1") % 2)
        got.append(x - (1 << BITS) if x >> (BITS - 1) else x)
    return got


def _dropped(mask: int) -> list[int]:
    flips = [1 << i for i in range(BITS) if not (mask >> i) & 1]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in flips]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all pairs within radius.

    Each fingerprint goes to one bucket per mask; buckets with one fingerprint end there. In the others a fingerprint
    stands at every point within one flip of a dropped bit, and all at one point, which are within the radius of
    each other, link to its least. A point holds at most 1 + 64 fingerprints for radius 2, so no group is unbounded
    and no pairs are listed, however many fingerprints share a bucket. The
    centre construction needs an even radius; only 2 is offered.
    """
    if radius != 2:
        raise ValueError("radius must be 2")
    family = masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(family)])
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key")
    near = keyed.join(shared, ["t", "key"]).select("t", "fp")

    def points(mask: int) -> Column:
        return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in _dropped(mask)])

    chosen = F.when(F.col("t") == 0, points(family[0]))
    for k in range(1, len(family)):
        chosen = chosen.when(F.col("t") == k, points(family[k]))
    at = near.select("fp", F.explode(chosen).alias("point")).distinct()
    star = at.groupBy("point").agg(F.min("fp").alias("lo"), F.collect_set("fp").alias("all"))
    return star.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints within `radius` bits link, and component_id is the smallest doc_id reachable. Null, empty and blank
    texts share fingerprint zero and link like any other; rows with a null doc_id keep it and take the component's
    smallest known id (null if there is none); repeated rows are returned as often as they come; other columns of
    docs are ignored; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text"), words=words).select("doc_id", "fp"))
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = cut(components(links(prints.select("fp"), radius)))
    of = prints.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = of.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """docs without the near-duplicates: one row of each component, that of its smallest doc_id.

    Of several rows of that id the one with the least fingerprint stays, so texts that share an id and belong to
    different components both stay; null ids come after all others; rows alike in id and fingerprint are one. An empty
    table gives no rows; other columns are untouched, and of rows alike in id and fingerprint any one's are kept.
    """
    marked = cut(fingerprints(docs, out="_weft_fp", words=words))
    prints = marked.groupBy("_weft_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    found = cut(components(links(prints.select(F.col("_weft_fp").alias("fp")), radius)))
    of = prints.join(found, prints._weft_fp == found.node, "left").select(F.coalesce("component", "_weft_fp").alias("root"), "first", "_weft_fp")
    keep = of.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "_weft_fp")).alias("k")).select(F.col("k.doc_id").alias("_weft_id"), F.col("k._weft_fp").alias("_weft_kept"))
    kept = marked.join(keep, marked.doc_id.eqNullSafe(keep._weft_id) & (marked._weft_fp == keep._weft_kept), "left_semi")
    return kept.dropDuplicates(["doc_id", "_weft_fp"]).drop("_weft_fp")
