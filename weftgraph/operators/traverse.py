"""Recursive reach: closures, stars, bounded and ordered traversals, oriented closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut, empty, reach


def _down(arrows: DataFrame) -> DataFrame:
    return arrows.select(F.col("src").alias("a"), F.col("dst").alias("b"))


def _up(arrows: DataFrame) -> DataFrame:
    return arrows.select(F.col("dst").alias("a"), F.col("src").alias("b"))


def traverse(arrows: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(*keys, point, depth) with depth the breadth-first distance; direction is down, up or both."""
    links = {"down": _down(arrows), "up": _up(arrows), "both": _down(arrows).unionByName(_up(arrows))}[direction]
    return reach(links, seeds, keys, max_depth)


def closure(arrows: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    return traverse(arrows, seeds, "down", **options)


def star(arrows: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    return traverse(arrows, seeds, "up", **options)


def closure_both(arrows: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    return traverse(arrows, seeds, "both", **options)


def in_chart_order(reached: DataFrame, strata: DataFrame) -> DataFrame:
    """Reached points with height and chart position; order by chart_index at the output."""
    return reached.join(strata.select("point", "height", "chart_index"), "point")


def closure_to_depth(arrows: DataFrame, strata: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The closure's points whose stratum depth is at most `depth`."""
    return closure(arrows, seeds).join(strata.where(F.col("depth") <= depth).select("point"), "point", "left_semi")


def closure_to_height(arrows: DataFrame, strata: DataFrame, seeds: DataFrame, height: int) -> DataFrame:
    return closure(arrows, seeds).join(strata.where(F.col("height") <= height).select("point"), "point", "left_semi")


def link(arrows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, point): points both below and above a seed, without itself, its cone and its support; empty on every DAG."""
    own = seeds.select(F.col("point").alias("seed"), "point")
    down, up = closure(arrows, own, keys=["seed"]), star(arrows, own, keys=["seed"])
    near = arrows.select(F.col("src").alias("seed"), F.col("dst").alias("point")).unionByName(arrows.select(F.col("dst").alias("seed"), F.col("src").alias("point")))
    both = down.select("seed", "point").join(up.select("seed", "point"), ["seed", "point"], "left_semi").where("seed <> point")
    return both.join(near, ["seed", "point"], "left_anti")


def oriented_closure(arrows: DataFrame, seeds: DataFrame, upward: bool = False) -> DataFrame:
    """(point, orient): sums of arrow orientations along the path that arrives first, of those the least parents' one.

    The reference fixes the orientation by its first depth-first visit; here the shortest path and then the least
    predecessor decide, which doesn't depend on row order. Upward steps use the inverse.
    """
    step = arrows.select(F.col("dst").alias("a"), F.col("src").alias("b"), (-F.col("orient")).alias("o")) if upward else arrows.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("orient").alias("o"))
    seen = layer = cut(seeds.select("point").distinct().withColumn("orient", F.lit(0)))
    while True:
        met = layer.join(step, layer.point == step.a).select(F.col("b").alias("point"), F.struct("a", (F.col("orient") + F.col("o")).alias("orient")).alias("x"))
        new = cut(met.groupBy("point").agg(F.min("x")["orient"].alias("orient")).join(seen.select("point"), "point", "left_anti"))
        if empty(new):
            return seen
        layer, seen = new, seen.unionByName(new)
