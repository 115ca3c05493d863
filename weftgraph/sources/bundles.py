"""Table sets in Parquet: a mesh in a folder, pieces by rank, bundles of meshes that share points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import Mesh

TABLES = ("arrows", "cell_types", "coords", "labels", "periodic")


def write_tables(mesh: Mesh, path: str) -> None:
    for name in TABLES:
        df = getattr(mesh, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, df in mesh.sections.items():
        df.write.mode("overwrite").parquet(f"{path}/sections/name={name}")


def read_tables(spark: SparkSession, path: str, only: tuple[str, ...] = TABLES, sections: str | None = None) -> Mesh:
    """The tables asked for; `sections` is a pattern of section names, which prunes their partitions."""
    got = {}
    for name in TABLES:
        got[name] = None
        if name in only:
            try:
                got[name] = spark.read.parquet(f"{path}/{name}")
            except Exception as e:  # an optional table that wasn't written
                if "PATH_NOT_FOUND" not in str(e) or name in ("arrows", "cell_types", "coords"):
                    raise
    mesh = Mesh(*[got[n] for n in TABLES])
    if sections:
        every = spark.read.parquet(f"{path}/sections").where(F.col("name").rlike(sections))
        mesh.sections = {r["name"]: every.where(F.col("name") == r["name"]).drop("name") for r in every.select("name").distinct().collect()}
    return mesh


def write_pieces(tables: dict[str, DataFrame], path: str, gather: bool = False) -> None:
    """Distributed tables, one partition a rank; gathered into one bundle without ranks if asked."""
    for name, df in tables.items():
        if gather:
            df.drop("rank").distinct().write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").partitionBy("rank").parquet(f"{path}/{name}")


def read_piece(spark: SparkSession, path: str, name: str, rank: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df if rank is None else df.where(F.col("rank") == rank)


def overlap_json(overlap: DataFrame) -> DataFrame:
    """(rank, metadata): each rank's links as one JSON document, sorted."""
    link = F.struct("point", "remote_point")
    by = overlap.groupBy("rank", "neighbor").agg(F.array_sort(F.collect_list(link)).alias("links"))
    return by.groupBy("rank").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("neighbor", "links"))).alias("neighbors"))).alias("metadata"))


def overlap_from_json(metadata: DataFrame) -> DataFrame:
    schema = "neighbors array<struct<neighbor:int,links:array<struct<point:bigint,remote_point:bigint>>>>"
    got = metadata.select("rank", F.explode(F.from_json("metadata", schema)["neighbors"]).alias("x"))
    return got.select("rank", F.explode("x.links").alias("l"), F.col("x.neighbor").alias("neighbor")).select("rank", "l.point", "neighbor", "l.remote_point")


def sync_labels(labels: DataFrame, points: DataFrame) -> DataFrame:
    """labels(mesh_id, name, point, value) merged over meshes, the greatest value winning, for every mesh that has the point."""
    best = labels.groupBy("name", "point").agg(F.max("value").alias("value"))
    return points.select("mesh_id", "point").distinct().join(best, "point").select("mesh_id", "name", "point", "value")


def coordinate_conflicts(coords: DataFrame) -> DataFrame:
    """Points whose coordinates differ in dimension or value between meshes."""
    return coords.groupBy("point").agg(F.countDistinct("xyz").alias("n")).where("n > 1")


def sync_coordinates(coords: DataFrame, points: DataFrame) -> DataFrame:
    one = coords.groupBy("point").agg(F.min_by("xyz", "mesh_id").alias("xyz"))
    return points.select("mesh_id", "point").distinct().join(one, "point").select("mesh_id", "point", "xyz")


def write_provenance(sf: DataFrame, stage: str, path: str) -> None:
    sf.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(path)
