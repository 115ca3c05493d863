"""Fixity audit of WARC replicas by Merkle trees over records and the ordered ranges of bytes that they fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: log2 of the children of a node.
FAN = 4
#: log2 of the record ids of a segment, which is one WARC file.
SEGMENT = 10


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text; nulls are empty."""
    body, uri = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), uri)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """Rows (page_id, key, record_length, sha256) of pages(page_id, url, html); key is page_id with null as -1."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("key"), text.alias("r")).select("page_id", "key", F.octet_length("r").cast("long").alias("record_length"), F.sha2("r", 256).alias("sha256"))


def _digest(children: Column) -> Column:
    """Of (at, hash) pairs in order: a hash of their hashes and of where each starts in the node's range of bytes."""
    return F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", (x["at"] - children[0]["at"]).cast("string"), x["hash"])), ";"), 256)


def _leaves(records: DataFrame) -> DataFrame:
    """A leaf for each id: its range of bytes (at, bytes) in the segment's file, hash, and its least digest and id.

    The digests of a repeated id are sorted and hashed in two steps, by their first three digits, so that however many
    there are no list outgrows a task.
    """
    some = records.groupBy("key", F.substring("sha256", 1, 3).alias("d"), "sha256").agg(F.count("*").alias("n"), F.sum("record_length").alias("b"), F.min("record_length").alias("record_length"), F.min("page_id").alias("page_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha256", "n"))), lambda x: F.concat_ws("x", x["sha256"], x["n"].cast("string"))), ";")
    kept = [F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("page_id").alias("page_id")]
    parts = some.groupBy("key", "d").agg(F.sha2(listed, 256).alias("h"), F.min(F.struct("sha256", "record_length")).alias("least"), F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("page_id").alias("page_id"))
    got = parts.groupBy("key").agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("d", "h"))), lambda x: x["h"])), 256).alias("hash"), F.min("least").alias("least"), *kept)
    before = Window.partitionBy(F.shiftright("key", SEGMENT)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return got.select("key", (F.sum("b").over(before) - F.col("b")).alias("at"), F.col("b").alias("bytes"), "hash", "least.sha256", "least.record_length", "page_id")


def tree(records: DataFrame, levels: int) -> DataFrame:
    """Rows (level, node, parent, at, bytes, hash, sha256, record_length, page_id); level 0 is the ids in order.

    Within a segment a node is the range of bytes at to at + bytes of its file, and its hash is over its children's
    hashes and places; above, at is 0 and the order is that of the files. The last three columns are of leaves only.
    """
    top = SEGMENT // FAN
    level = cut(_leaves(records)).select(F.lit(0).alias("level"), F.col("key").alias("node"), F.shiftright("key", FAN).alias("parent"), "at", "bytes", "hash", "sha256", "record_length", "page_id")
    out = [level]
    for k in range(1, levels + 1):
        # files have no offsets in each other: above a segment children count by their place alone
        at = F.col("at") if k <= top else F.lit(0).cast("long")
        level = (
            level.groupBy(F.col("parent").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", at.alias("at"), "hash"))).alias("c"), F.sum("bytes").alias("bytes"))
            .select(F.lit(k).alias("level"), F.col("up").alias("node"), F.shiftright("up", FAN).alias("parent"), F.col("c")[0]["at"].alias("at"), "bytes", F.sha2(F.concat(_digest(F.col("c")), F.array_join(F.transform("c", lambda x: x["node"].cast("string")), ",")), 256).alias("hash"),
                    F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("record_length"), F.lit(None).cast("long").alias("page_id"))
        )
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def _stored(t: DataFrame) -> DataFrame:
    """The tree as a table by level, so that the descent reads only the levels and branches that it needs."""
    path = shared_dir(t.sparkSession)
    t.write.partitionBy("level").parquet(path)
    schema = "node long, parent long, at long, bytes long, hash string, sha256 string, record_length long, page_id long, level int"
    return t.sparkSession.read.schema(schema).parquet(path)


def _compared(a: DataFrame, b: DataFrame, level: int, under: DataFrame | None) -> DataFrame:
    """Nodes of a level, below the mismatching ones above, whose hashes differ or that only one tree has."""

    def own(t: DataFrame, name: str) -> DataFrame:
        t = t.where(F.col("level") == level)
        if under is not None:
            t = t.join(under.select(F.col("node").alias("parent")), "parent", "left_semi")
        return t.select("node", F.col("hash").alias(name))

    got = own(a, "ours").join(own(b, "theirs"), "node", "full_outer")
    return got.where("not (ours <=> theirs)")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows (page_id, status, segment, record_offset, record_length, expected_sha256, found_sha256) for each id of
    pages(page_id, url, html) at which the replica differs: 'corrupt', 'missing' from the replica, or 'extra' in it.

    Roots are compared first and only mismatching branches are descended, a level a step; what a leaf says of its place
    comes from the stored trees. A node's hash counts places from its own start, so a lost record doesn't spoil the
    ranges after it. record_offset is the
    record's place in its segment's file, which holds 1,024 consecutive ids in order; it and the length are the
    primary's (the replica's for extra ids). A repeated id is compared as a multiset of records, and reported once
    with its least offset and digest; nulls are empty, a null id counts as -1 and is reported as null; other columns
    are ignored; equal and empty tables give no rows.
    """
    ours, theirs = manifest(primary), manifest(replica)
    low, high = ours.select("key").unionByName(theirs.select("key")).agg(F.min("key"), F.max("key")).first()
    if low is None:
        low = high = 0
    levels = 1
    # ids of both signs end in two roots
    while (high >> (FAN * levels)) - (low >> (FAN * levels)) > 1:
        levels += 1
    a, b = _stored(tree(ours, levels)), _stored(tree(theirs, levels))
    bad = None
    for level in range(levels, -1, -1):
        bad = cut(_compared(a, b, level, bad))
        if level and bad.limit(1).count() == 0:
            break
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("corrupt")
    found = bad.select(F.col("node").alias("key"), status.alias("status"), F.shiftright("node", SEGMENT).alias("segment"))

    def placed(t: DataFrame, tag: str) -> DataFrame:
        leaves = t.where("level = 0").join(bad.select("node"), "node", "left_semi")
        return leaves.select(F.col("node").alias("key"), F.col("at").alias(f"{tag}_offset"), F.col("record_length").alias(f"{tag}_length"), F.col("sha256").alias(f"{tag}_sha256"), F.col("page_id").alias(f"{tag}_id"))

    got = found.join(placed(a, "our"), "key", "left").join(placed(b, "their"), "key", "left")
    return got.select(
        F.coalesce("our_id", "their_id").alias("page_id"), "status", "segment", F.coalesce("our_offset", "their_offset").alias("record_offset"), F.coalesce("our_length", "their_length").alias("record_length"),
        F.col("our_sha256").alias("expected_sha256"), F.col("their_sha256").alias("found_sha256"),
    )


def write_files(pages: DataFrame, path: str) -> None:
    """Write a WARC file for each segment of pages(page_id, url, html) into path, a folder for each: records in the order
    of ids and digests, byte after byte, so that an audit's segment and record_offset say where a record is."""
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.shiftright(key, SEGMENT).alias("segment"), key.alias("key"), text.alias("r"))
    rows = rows.repartition("segment").sortWithinPartitions("segment", "key", F.sha2("r", 256))
    # the writer puts the last line feed and carriage return behind each record
    rows.select("segment", F.expr("substring(r, 1, length(r) - 2)").alias("value")).write.partitionBy("segment").option("lineSep", "\r\n").text(path)


def read_records(spark: SparkSession, path: str, at: DataFrame) -> DataFrame:
    """The bytes of at(segment, record_offset, record_length), which get a column `record`, from files of write_files."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"segment=(-?\d+)", 1).cast("long").alias("segment"), "content")
    return at.join(files, "segment").withColumn("record", F.expr("substring(content, int(record_offset) + 1, int(record_length))")).drop("content")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage for drills: by a digest of the url, first characters changed, records lost and added."""
    d = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    own = pages.select("page_id", "url", "html", d.alias("d"))
    changed = own.withColumn("html", F.when(F.col("d") == "00", F.concat(F.lit("X"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))).where("d <> '01'")
    added = own.where("d = '02'").withColumn("page_id", -F.col("page_id") - 2)
    return changed.unionByName(added).drop("d")
