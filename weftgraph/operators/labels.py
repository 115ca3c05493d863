"""Labels: (name, point, value) with one value for each point of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from .traverse import closure, star


def upsert(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels with the values of `new` in place of old ones; of several new values the greatest stays."""
    last = new.groupBy("name", "point").agg(F.max("value").alias("value"))
    return labels.join(last, ["name", "point"], "left_anti").select("name", "point", "value").unionByName(last)


def stratum(labels: DataFrame, name: str, value: int) -> DataFrame:
    return labels.where((F.col("name") == name) & (F.col("value") == value)).select("point").distinct()


def values(labels: DataFrame, name: str) -> DataFrame:
    return labels.where(F.col("name") == name).groupBy("value").agg(F.count("*").alias("size"))


def strata_by_value(labels: DataFrame, name: str) -> DataFrame:
    return labels.where(F.col("name") == name).groupBy("value").agg(F.sort_array(F.collect_list("point")).alias("points"))


def in_range(labels: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """(value, point) with low <= value < high; order by both at the output."""
    return labels.where((F.col("name") == name) & (F.col("value") >= low) & (F.col("value") < high)).select("value", "point")


def union(a: DataFrame, b: DataFrame, name: str, value: int) -> DataFrame:
    return stratum(a, name, value).unionByName(stratum(b, name, value)).distinct()


def intersection(a: DataFrame, b: DataFrame, name: str, value: int) -> DataFrame:
    return stratum(a, name, value).join(stratum(b, name, value), "point", "left_semi")


def difference(a: DataFrame, b: DataFrame, name: str, value: int) -> DataFrame:
    return stratum(a, name, value).join(stratum(b, name, value), "point", "left_anti")


def clear_value(labels: DataFrame, name: str, value: int) -> DataFrame:
    return labels.where((F.col("name") != name) | (F.col("value") != value))


def clear_points(labels: DataFrame, gone: DataFrame) -> DataFrame:
    return labels.join(gone.select("point"), "point", "left_anti").select("name", "point", "value")


def filtered_to(labels: DataFrame, kept: DataFrame) -> DataFrame:
    return labels.join(kept.select("point"), "point", "left_semi").select("name", "point", "value")


def remap_value(labels: DataFrame, name: str, old: int, new: int) -> DataFrame:
    return labels.withColumn("value", F.when((F.col("name") == name) & (F.col("value") == old), F.lit(new)).otherwise(F.col("value")))


def propagate(labels: DataFrame, arrows: DataFrame, name: str, value: int, upward: bool = False) -> DataFrame:
    """labels with the value pushed over the closure (or star) of its points; it replaces their other values of the name."""
    walk = star if upward else closure
    met = walk(arrows, stratum(labels, name, value)).select(F.lit(name).alias("name"), "point", F.lit(value).cast("int").alias("value"))
    return upsert(labels, met)


def propagate_all(labels: DataFrame, arrows: DataFrame, upward: bool = False) -> DataFrame:
    """Every value of every name in ascending order, each seeded from what the ones before have left.

    Two keyed passes, whatever the number of values: a point still has its value when its turn comes if no lesser one
    reaches it (the least that does is never replaced before), and of what such points reach the greatest value stays.
    """
    walk = star if upward else closure
    own = cut(labels.select("name", "point", "value"))
    first = walk(arrows, own, keys=["name", "value"]).groupBy("name", "point").agg(F.min("value").alias("least"))
    seeds = cut(own.join(first, ["name", "point"]).where("value = least").select("name", "value", "point"))
    return upsert(own, walk(arrows, seeds, keys=["name", "value"]).select("name", "point", "value"))


def classify_boundary(arrows: DataFrame, cells: DataFrame, points: DataFrame) -> DataFrame:
    """(point, cells, is_boundary): at most one incident cell makes a boundary point."""
    met = star(arrows, points.select(F.col("point").alias("seed"), "point"), keys=["seed"]).join(cells.select("point"), "point", "left_semi")
    n = met.groupBy(F.col("seed").alias("point")).agg(F.countDistinct("point").alias("cells"))
    got = points.select("point").join(n, "point", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return got.withColumn("is_boundary", F.col("cells") <= 1)


#: Names and codes of the coastal vocabulary.
COASTAL = {"free_surface": ("coastal", 1), "bed": ("coastal", 2), "open_boundary": ("coastal", 3), "inflow": ("open_boundary_role", 1), "outflow": ("open_boundary_role", 2), "tidal": ("open_boundary_role", 3), "wet": ("wet_dry", 1), "dry": ("wet_dry", 0)}


def coastal(labels: DataFrame, what: str) -> DataFrame:
    return stratum(labels, *COASTAL[what])


def coastal_faults(labels: DataFrame) -> DataFrame:
    """(fault, point): points on surface and bed at once, open boundary points without a role, wet and dry at once."""
    surface, bed, opened = (coastal(labels, w) for w in ("free_surface", "bed", "open_boundary"))
    role = labels.where("name = 'open_boundary_role'").select("point")
    return (
        surface.join(bed, "point", "left_semi").withColumn("fault", F.lit("surface_and_bed"))
        .unionByName(opened.join(role, "point", "left_anti").withColumn("fault", F.lit("open_boundary_without_role")))
        .unionByName(role.join(opened, "point", "left_anti").withColumn("fault", F.lit("role_without_open_boundary")))
        .unionByName(coastal(labels, "wet").join(coastal(labels, "dry"), "point", "left_semi").withColumn("fault", F.lit("wet_and_dry")))
    )


def extract_submesh(arrows: DataFrame, labels: DataFrame, name: str, value: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closure of a stratum as (arrows, labels, map): ids compacted to 1..n in the old order; map(point, new_id)."""
    from .strata import renumber
    from .topology import dense_index

    kept = cut(closure(arrows, stratum(labels, name, value)).select("point"))
    perm = cut(dense_index(kept, ["point"], "i").select("point", (F.col("i") + 1).alias("new_id")))
    inner = arrows.join(kept.withColumnRenamed("point", "src"), "src", "left_semi").join(kept.withColumnRenamed("point", "dst"), "dst", "left_semi").select(*arrows.columns)
    return renumber(inner, perm, "src", "dst").select(*arrows.columns), renumber(filtered_to(labels, kept), perm, "point").select("name", "point", "value"), perm
