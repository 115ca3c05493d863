"""Iteration over DataFrames: written-out steps and frontier loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one where that is unset and Spark is local, as in tests.

    On a cluster executors don't see each other's temporary folders, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("-")[0].split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "") or tempfile.mkdtemp(prefix="weftgraph-")
        _own["dir"] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: bounded lineage that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def reach(links: DataFrame, seeds: DataFrame, keys: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Rows (*keys, point, depth): every point at breadth-first distance `depth` from the seeds of its keys.

    links(a, b) is followed from a to b; seeds has the keys and point. Each step joins the frontier alone and drops
    what has been seen, so work follows the edges met, not the paths.
    """
    keys = keys or []
    on = [*keys, "point"]
    if max_depth is None or max_depth > 1:  # every step joins them, so they are made once
        links = cut(links.select("a", "b"))
    layers = [cut(seeds.select(*on).distinct().withColumn("depth", F.lit(0)))]
    seen = layers[0]
    while max_depth is None or len(layers) <= max_depth:
        step = layers[-1].join(links, layers[-1].point == links.a).select(*keys, F.col("b").alias("point")).distinct()
        new = cut(step.join(seen.select(*on), on, "left_anti").withColumn("depth", F.lit(len(layers))))
        if empty(new):
            break
        layers.append(new)
        seen = seen.unionByName(new)
    return seen


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) of edges(u, v): the least node of each connected component, by star contractions."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(star.unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
    raise RuntimeError("components did not settle")
