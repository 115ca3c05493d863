"""Helpers shared by the training-data operators: tables, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's reader, so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if REPO not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, path) if x)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor sees; a temporary one where that is unset and
    Spark is local, as in tests. On a cluster an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("-")[0].split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "") or tempfile.mkdtemp(prefix="weftgraph-")
        _own["dir"] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again. Survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed to the system, and whether it could.

    Its compiler and hundreds of threads free memory outside the heap that malloc keeps otherwise. The command is
    HotSpot's System.trim_native_heap on Linux; another JVM goes on as it is.
    """
    jvm = spark._jvm
    try:
        # by way of the interface, as the server's own class isn't exported
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except (Py4JError, StopIteration):
        return False
    return True


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v): rows (node, component), component the least node reachable.

    Alternates large-star and small-star rounds, each two pre-aggregated minima and two joins, until the edge set
    is a forest of stars. Self loops and repeated edges are allowed; nodes without an edge don't appear. Links stay
    distributed; only a count and a checksum of each round reach the driver.
    """
    big = F.greatest("u", "v")
    small = F.least("u", "v")
    e = cut(edges.where("u <> v").select(big.alias("a"), small.alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least2, "a")
        star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b")))
        e = cut(star.distinct())
        got = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = (got[0], got[1])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def give_back() -> None:
    """Return freed memory to the system, so that reused workers and the driver stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds little besides its input batch; at the end freed memory goes back."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    give_back()


def with_columns(docs: DataFrame, text: str, fields: list[T.StructField], made: Callable[[list], list[pa.Array]], rows: int = 256) -> DataFrame:
    """docs with the given columns, made from the values of `text`; columns of these names are replaced."""
    docs = docs.drop(*[f.name for f in fields])
    at = docs.columns.index(text)
    names = [*docs.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([*part.columns, *made(part.column(at).to_pylist())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
