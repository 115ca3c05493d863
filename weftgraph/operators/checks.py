"""Checks give violations as DataFrames; strict() raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import VERTICES
from ..plans.loops import empty
from .generate import Mesh, cell_vertices


class MeshError(ValueError):
    """A check found violations."""


def strict(violations: DataFrame) -> None:
    if not empty(violations):
        raise MeshError("; ".join(str(r.asDict()) for r in violations.limit(5).collect()))


def topology_faults(mesh: Mesh, most_supports: int = 2) -> DataFrame:
    """(check, point): repeated arrows, wrong vertex counts, dangling ends, faces with too many cells."""
    a = mesh.arrows
    twice = a.groupBy("src", "dst").count().where("count > 1").select(F.lit("repeated_arrow").alias("check"), F.col("src").alias("point"))
    want = F.create_map(*[F.lit(x) for kv in VERTICES.items() for x in kv])[F.col("tag")]
    sizes = cell_vertices(mesh).where(want.isNotNull() & (F.size("vertices") != want)).select(F.lit("cone_size").alias("check"), F.col("cell").alias("point"))
    dangling = a.select(F.col("dst").alias("point")).distinct().join(mesh.cell_types.select("point"), "point", "left_anti").select(F.lit("unknown_point").alias("check"), "point")
    bare = mesh.coords.select("point")
    bare = mesh.cell_types.where("tag = 'vertex'").select("point").join(bare, "point", "left_anti").select(F.lit("no_coordinates").alias("check"), "point")
    return reduce(DataFrame.unionByName, [twice, sizes, dangling, bare])


def manifold_faults(face_arrows: DataFrame, most: int = 2) -> DataFrame:
    """Faces with more than two cells, of arrows from cells to faces."""
    return face_arrows.groupBy(F.col("dst").alias("point")).agg(F.countDistinct("src").alias("cells")).where(F.col("cells") > most)


def ownership_faults(ownership: DataFrame, overlap: DataFrame, held: DataFrame) -> DataFrame:
    """(fault, rank, point): held points without an owner, owners that don't hold the point, ghosts without a link to their owner."""
    no_owner = held.select("rank", "point").join(ownership.select("rank", "point"), ["rank", "point"], "left_anti").select(F.lit("no_owner").alias("fault"), "rank", "point")
    unheld = ownership.select("rank", "point", "owner").join(held.select(F.col("rank").alias("owner"), "point"), ["owner", "point"], "left_anti").select(F.lit("owner_without_point").alias("fault"), "rank", "point")
    unlinked = ownership.where("is_ghost").join(overlap.select("rank", "point", F.col("neighbor").alias("owner")), ["rank", "point", "owner"], "left_anti").select(F.lit("ghost_without_link").alias("fault"), "rank", "point")
    return no_owner.unionByName(unheld).unionByName(unlinked)


def summary(mesh: Mesh) -> DataFrame:
    """(tag, count) of cell types, with arrow and label counts as tags of their own."""
    got = mesh.cell_types.groupBy("tag").agg(F.count("*").alias("count")).unionByName(mesh.arrows.agg(F.lit("#arrows").alias("tag"), F.count("*").alias("count")))
    return got.unionByName(mesh.labels.agg(F.lit("#labels").alias("tag"), F.count("*").alias("count"))) if mesh.labels is not None else got


def dot(arrows: DataFrame) -> DataFrame:
    """Lines of a Graphviz digraph's edges."""
    return arrows.select(F.concat(F.lit("  p"), F.col("src"), F.lit(" -> p"), F.col("dst"), F.lit(";")).alias("line"))


def readiness(mesh: Mesh, required: tuple[str, ...] = ("coords", "cell_types")) -> DataFrame:
    """(prerequisite, present) for a solve."""
    spark = mesh.arrows.sparkSession
    rows = [(name, getattr(mesh, name) is not None and not empty(getattr(mesh, name))) for name in required]
    return spark.createDataFrame(rows, "prerequisite string, present boolean")
