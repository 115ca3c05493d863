"""Arrow tables: upserts, cones and supports, roles, restriction, orientation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point(kind: int, key: Column) -> Column:
    """Positive ids from keys that start at 0; kinds don't overlap."""
    return (F.lit(kind * 10**12) + key.cast("long") + 1).cast("long")


def upsert(arrows: DataFrame, order: str | None = None) -> DataFrame:
    """One arrow for each (src, dst): the last by `order`, or any if the table has no order. Endpoints must be positive."""
    good = arrows.where("src > 0 and dst > 0")
    if order is None:
        return good.dropDuplicates(["src", "dst"])
    other = [c for c in arrows.columns if c not in ("src", "dst", order)]
    last = good.groupBy("src", "dst").agg(F.max_by(F.struct(order, *other), F.struct(order, *other)).alias("x"))
    return last.select("src", "dst", "x.*").select(*arrows.columns)


def invalid_points(points: DataFrame, column: str = "point") -> DataFrame:
    return points.where(F.col(column).isNull() | (F.col(column) <= 0))


def remove(arrows: DataFrame, gone: DataFrame) -> DataFrame:
    return arrows.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def has(arrows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) with `found`."""
    mark = arrows.select("src", "dst", F.lit(True).alias("found")).distinct()
    return pairs.join(mark, ["src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def cone(arrows: DataFrame, points: DataFrame) -> DataFrame:
    """Outgoing arrows of points(point)."""
    return arrows.join(points.select(F.col("point").alias("src")).distinct(), "src", "left_semi")


def support(arrows: DataFrame, points: DataFrame) -> DataFrame:
    return arrows.join(points.select(F.col("point").alias("dst")).distinct(), "dst", "left_semi")


restrict_base = cone
restrict_cap = support


def cone_degree(arrows: DataFrame) -> DataFrame:
    return arrows.groupBy(F.col("src").alias("point")).agg(F.count("*").alias("degree"))


def support_degree(arrows: DataFrame) -> DataFrame:
    return arrows.groupBy(F.col("dst").alias("point")).agg(F.count("*").alias("degree"))


def roles(arrows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Rows (point, is_base, is_cap): from the arrows, and from points declared with roles."""
    both = arrows.select(F.col("src").alias("point"), F.lit(True).alias("is_base"), F.lit(False).alias("is_cap")).unionByName(arrows.select(F.col("dst").alias("point"), F.lit(False).alias("is_base"), F.lit(True).alias("is_cap")))
    if declared is not None:
        both = both.unionByName(declared.select("point", "is_base", "is_cap"))
    return both.groupBy("point").agg(F.max("is_base").alias("is_base"), F.max("is_cap").alias("is_cap"))


def points(arrows: DataFrame) -> DataFrame:
    return arrows.select(F.col("src").alias("point")).unionByName(arrows.select(F.col("dst").alias("point"))).distinct()


def set_cone(arrows: DataFrame, p: int, chain: DataFrame) -> DataFrame:
    """Replace p's cone by chain, whose columns are those of arrows without src."""
    new = chain.withColumn("src", F.lit(p).cast("long")).select(*arrows.columns)
    return upsert(arrows.where(F.col("src") != p).unionByName(new))


def add_cone(arrows: DataFrame, p: int, chain: DataFrame) -> DataFrame:
    new = chain.withColumn("src", F.lit(p).cast("long")).select(*arrows.columns)
    return upsert(arrows.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1))), "_n").drop("_n")


def set_support(arrows: DataFrame, p: int, chain: DataFrame) -> DataFrame:
    new = chain.withColumn("dst", F.lit(p).cast("long")).select(*arrows.columns)
    return upsert(arrows.where(F.col("dst") != p).unionByName(new))


def add_support(arrows: DataFrame, p: int, chain: DataFrame) -> DataFrame:
    new = chain.withColumn("dst", F.lit(p).cast("long")).select(*arrows.columns)
    return upsert(arrows.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1))), "_n").drop("_n")


def remove_points(arrows: DataFrame, gone: DataFrame) -> DataFrame:
    """Arrows that touch none of the points."""
    g = gone.select("point").distinct()
    return arrows.join(g.withColumnRenamed("point", "src"), "src", "left_anti").join(g.withColumnRenamed("point", "dst"), "dst", "left_anti").select(*arrows.columns)


def frozen(arrows: DataFrame) -> DataFrame:
    """Compressed rows (point, neighbors, offset): cones in order of the source, with running offsets."""
    rows = arrows.groupBy(F.col("src").alias("point")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
    return exclusive_sum(rows.withColumn("n", F.size("neighbors").cast("long")), "n", ["point"], "offset").drop("n")


def exclusive_sum(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """df with the sum of value over the rows before, in the given total order, without gathering rows in one task.

    Rows are dealt to ranges of the first order column; sums inside a range are added to the sums of the ranges
    before, of which there are as many as partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from ..plans.loops import cut

    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    local = ranged.withColumn("_in", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def last_before(df: DataFrame, value: Column, order: list[str], out: str, down: bool = False) -> DataFrame:
    """df with the last value that isn't null of the rows before each row, in the given order or, if down, its reverse.

    Dealt as in exclusive_sum: what a range doesn't tell comes from the ranges before, one row each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..plans.loops import cut

    sort = [F.col(c).desc() if down else F.col(c).asc() for c in order]
    ranged = cut(df.withColumn("_v", value).repartitionByRange(n, *sort).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    end = (F.min_by if down else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    before = ranged.groupBy("_part").agg(end.alias("_t")).withColumn("_before", F.last("_t", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    return local.join(F.broadcast(before), "_part").withColumn(out, F.coalesce("_in", "_before")).drop("_part", "_in", "_before", "_v")


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its row number from 0 in the given total order, by the same two-step sum."""
    return exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, out).drop("_one")


def face_orientation_mismatches(arrows: DataFrame, faces: DataFrame) -> DataFrame:
    """Pairs of supports of a face whose orientations aren't inverse of each other: (face, a, b, orient_a, orient_b)."""
    own = arrows.join(faces.select(F.col("point").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("face"), "src", "orient")
    a, b = own.select("face", F.col("src").alias("a"), F.col("orient").alias("orient_a")), own.select("face", F.col("src").alias("b"), F.col("orient").alias("orient_b"))
    return a.join(b, "face").where("a < b and orient_b <> -orient_a")


def repair_face_orientations(arrows: DataFrame, faces: DataFrame) -> DataFrame:
    """Arrows with later supports of a face set to the inverse of the first one's orientation."""
    first = support(arrows, faces).groupBy("dst").agg(F.min(F.struct("src", "orient")).alias("f"))
    got = arrows.join(first, "dst", "left")
    return got.withColumn("orient", F.when(F.col("f").isNotNull() & (F.col("src") != F.col("f.src")), -F.col("f.orient")).otherwise(F.col("orient"))).select(*arrows.columns)
