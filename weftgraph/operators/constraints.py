"""Fixed and hanging constraints on degrees of freedom, anchors and boundary conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loops import reach


def long_form(section: DataFrame) -> DataFrame:
    return section.select("point", "seq", F.posexplode("values").alias("idx", "value"))


def slices(rows: DataFrame) -> DataFrame:
    return rows.groupBy("point", "seq").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("x")).select("point", "seq", F.col("x.value").alias("values"))


def fixed(rows: DataFrame, constraints: DataFrame) -> DataFrame:
    """rows(point, seq, idx, value) with the values of constraints(point, idx, value)."""
    new = constraints.groupBy("point", "idx").agg(F.max("value").alias("new"))
    return rows.join(new, ["point", "idx"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def hanging(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Each hanging value becomes the weighted sum of its sources' old values; terms(point, idx, src_point, src_idx, weight)."""
    old = rows.select(F.col("point").alias("src_point"), F.col("idx").alias("src_idx"), F.col("value").alias("v"))
    new = terms.join(old, ["src_point", "src_idx"]).groupBy("point", "idx").agg(F.sum(F.col("weight") * F.col("v")).alias("new"))
    return rows.join(new, ["point", "idx"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def apply_all(rows: DataFrame, terms: DataFrame, constraints: DataFrame) -> DataFrame:
    """Hanging constraints first, fixed ones second."""
    return fixed(hanging(rows, terms), constraints)


def faults(rows: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints on a point or index that the section doesn't have."""
    return constraints.join(rows.select("point", "idx"), ["point", "idx"], "left_anti")


def from_labels(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """(point, idx, value) of specs(name, value, idx, fixed): constraints on every point of a stratum."""
    return labels.join(specs, ["name", "value"]).select("point", "idx", F.col("fixed").alias("value"))


def dirichlet(rows: DataFrame, stratum: DataFrame, idx: list[int], value: Column) -> DataFrame:
    """Set the listed degrees of freedom on a stratum; value is an expression over point, idx and value."""
    marked = rows.join(stratum.select("point", F.lit(True).alias("_on")), "point", "left")
    return marked.withColumn("value", F.when(F.col("_on") & F.col("idx").isin(idx), value).otherwise(F.col("value"))).drop("_on")


def anchor_terms(anchors: DataFrame, lengths: DataFrame) -> DataFrame:
    """Hanging terms of points anchored to parents(point, parent): equal weights over the parents, index by index."""
    n = anchors.groupBy("point").agg(F.count("*").alias("n"))
    idx = lengths.select("point", F.explode(F.sequence(F.lit(0), F.col("len").cast("int") - 1)).alias("idx"))
    return anchors.join(n, "point").join(idx, "point").select("point", "idx", F.col("parent").alias("src_point"), F.col("idx").alias("src_idx"), (1 / F.col("n")).alias("weight"))


def anchor_closure(arrows: DataFrame, anchors: DataFrame, seeds: DataFrame, upward: bool = False) -> DataFrame:
    """Closure (or star) that also follows anchors from hanging points to parents (or back)."""
    links = arrows.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(anchors.select(F.col("point").alias("a"), F.col("parent").alias("b")))
    return reach(links.select(F.col("b").alias("a"), F.col("a").alias("b")) if upward else links, seeds)
