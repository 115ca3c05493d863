"""Adaptation: quality and metric selection, metric normalisation, transfers along refinement maps, tree forests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.cells import EDGES, choose
from ..plans.loops import cut, empty
from .checks import strict
from .generate import Mesh
from .generate import refine as refine_mesh
from .topology import points


def select(df: DataFrame, refine: Column, coarsen: Column) -> DataFrame:
    """df with `action`: refine is decided first."""
    return df.withColumn("action", F.when(refine, "refine").when(coarsen, "coarsen").otherwise("keep"))


def select_by_quality(quality: DataFrame, least_angle: float = 20.0, most_ratio: float = 5.0, fine_angle: float = 50.0, fine_ratio: float = 1.5) -> DataFrame:
    bad = (F.col("min_angle") < least_angle) | (F.col("aspect_ratio") > most_ratio)
    good = (F.col("min_angle") > fine_angle) & (F.col("aspect_ratio") < fine_ratio)
    return select(quality, bad, good)


def select_by_fvm(diagnostics: DataFrame, refine: tuple = (75.0, 4.0, 1e-8), coarsen: tuple = (35.0, 1.5, 1e-4)) -> DataFrame:
    """diagnostics(non_orthogonality, skewness, length) with action: limits of angle, skewness and least length."""
    a, k, h = F.col("non_orthogonality"), F.col("skewness"), F.col("length")
    return select(diagnostics, (a > refine[0]) | (k > refine[1]) | (h < refine[2]), (a <= coarsen[0]) & (k <= coarsen[1]) & (h >= coarsen[2]))


def coarsen(cones: DataFrame) -> DataFrame:
    """Arrows of the coarse topology from cones(coarse, dst); see coarsen_faults for what it takes to be one."""
    return cones.select(F.col("coarse").alias("src"), "dst").distinct()


def coarsen_faults(arrows: DataFrame, merged: DataFrame, cones: DataFrame) -> DataFrame:
    """(coarse, point, fault): points of merged(coarse, fine) and cones(coarse, dst) that the fine topology lacks."""
    known = points(arrows)
    rows = merged.select("coarse", F.col("fine").alias("point"), F.lit("fine").alias("fault")).unionByName(cones.select("coarse", F.col("dst").alias("point"), F.lit("cone").alias("fault")))
    return rows.distinct().join(known, "point", "left_anti").select("coarse", "point", "fault")


def adapt_topology(mesh: Mesh, indicator: DataFrame, refine_above: float, coarsen_below: float, plan=None) -> tuple[str, Mesh, DataFrame | None]:
    """(action, mesh, map) by indicator(cell, value): if any cell is above the first limit those are refined, else what
    is below the second is coarsened by plan(cells) -> (merged(coarse, fine), cones(coarse, dst)), else nothing is done.

    The map has coarse and fine. A plan that names unknown points is an error.
    """
    marked = cut(indicator.select(F.col("cell").alias("point"), F.when(F.col("value") > refine_above, "refine").when(F.col("value") < coarsen_below, "coarsen").alias("action")))
    up = marked.where("action = 'refine'").select("point")
    if not empty(up):
        return "refined", *refine_mesh(mesh, up)
    down = marked.where("action = 'coarsen'").select("point")
    if plan is None or empty(down):
        return "unchanged", mesh, None
    merged, cones = plan(down)
    if empty(merged):
        return "unchanged", mesh, None
    strict(coarsen_faults(mesh.arrows, merged, cones))
    return "coarsened", Mesh(coarsen(cones), mesh.cell_types, mesh.coords, mesh.labels), merged


#: Places of a symmetric tensor's entries in the packed six doubles.
PACKED = {2: [[0, 1], [1, 2]], 3: [[0, 1, 2], [1, 3, 4], [2, 4, 5]]}


def metric_length(metric: Column, e: Column, dim: int) -> Column:
    """Length of an edge vector in a packed metric."""
    terms = [F.get(metric, F.lit(PACKED[dim][i][j])) * V.at(e, i) * V.at(e, j) for i in range(dim) for j in range(dim)]
    return F.sqrt(F.greatest(F.lit(0.0), sum(terms[1:], terms[0])))


def select_by_metric(cells: DataFrame, dim: int, high: float = 1.2, low: float = 0.8) -> DataFrame:
    """cells(cell, tag, pts, metric) with longest_edge in the metric and action."""
    p = lambda k: F.get("pts", F.lit(k))
    longest = choose(F.col("tag"), EDGES, lambda _, es: F.array_max(F.array(*[metric_length(F.col("metric"), V.sub(p(b), p(a)), dim) for a, b in es])))
    got = cells.withColumn("longest_edge", longest)
    return select(got, F.col("longest_edge") > high, F.col("longest_edge") < low)


def normalize_metric(metrics: DataFrame, dim: int, target: float | None = None, least: float = 1e-12, most: float = 1e12, gradation: float | None = None) -> DataFrame:
    """metrics(point, metric) with the diagonal clamped, scaled so that the sum of root determinants of the diagonal is
    `target`, and bounded by gradation squared times the least magnitude of all."""
    diag = [PACKED[dim][k][k] for k in range(dim)]
    clamped = F.transform("metric", lambda x, i: F.when(i.isin(diag), F.least(F.lit(most), F.greatest(F.lit(least), x))).otherwise(x))
    got = metrics.withColumn("metric", clamped)
    if target is not None:
        root = F.sqrt(F.abs(V.at(F.col("metric"), diag[0])))
        for k in diag[1:]:
            root = root * F.sqrt(F.abs(V.at(F.col("metric"), k)))
        total = got.agg(F.sum(root)).first()[0]
        if total:
            got = got.withColumn("metric", V.scale(F.col("metric"), F.lit((target / total) ** (2 / dim))))
    if gradation is not None:
        size = F.array_max(F.array(*[V.at(F.col("metric"), k) for k in diag]))
        low = got.agg(F.min(size)).first()[0]
        if low:
            got = got.withColumn("_s", size).withColumn("metric", F.when(F.col("_s") > low * gradation**2, V.scale(F.col("metric"), F.lit(low * gradation**2) / F.col("_s"))).otherwise(F.col("metric"))).drop("_s")
    return got


def transfer_refinement(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of coarse points repeated for their fine ones; mapping(coarse, fine)."""
    rest = [c for c in values.columns if c != "point"]
    return mapping.join(values.withColumnRenamed("point", "coarse"), "coarse").select(F.col("fine").alias("point"), *rest)


def transfer_coarsening(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """(point, idx, value): means of fine values over the coarse points they merge into."""
    return mapping.join(values.withColumnRenamed("point", "fine"), "fine").groupBy(F.col("coarse").alias("point"), "idx").agg(F.avg("value").alias("value"))


def transfer_ownership(owners: DataFrame, mapping: DataFrame) -> DataFrame:
    """A new point's owner is the least of its sources' owners."""
    return mapping.join(owners.withColumnRenamed("point", "coarse"), "coarse").groupBy(F.col("fine").alias("point")).agg(F.min("owner").alias("owner"))


def transfer_labels(values: DataFrame, source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Rows of values(point, ...) copied to the points of target that have the same value of a label as theirs in source."""
    from_ = source.where(F.col("name") == name).select("point", F.col("value").alias("_v"))
    to = target.where(F.col("name") == name).select(F.col("point").alias("_to"), F.col("value").alias("_v"))
    rest = [c for c in values.columns if c != "point"]
    return values.join(from_, "point").join(to, "_v").select(F.col("_to").alias("point"), *rest)


def transfer_label_faults(values: DataFrame, source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """(value, fault): label values on several source points, wanted but on none, or on a point without data."""
    s, t = (x.where(F.col("name") == name).select("point", "value") for x in (source, target))
    twice = s.groupBy("value").count().where("count > 1").select("value", F.lit("duplicate").alias("fault"))
    lost = t.select("value").distinct().join(s, "value", "left_anti").select("value", F.lit("missing").alias("fault"))
    bare = s.join(t, "value", "left_semi").join(values.select("point"), "point", "left_anti").select("value", F.lit("no_data").alias("fault"))
    return twice.unionByName(lost).unionByName(bare)


def children(leaves: DataFrame, dim: int) -> DataFrame:
    """The 2^dim children of each of leaves(level, coords)."""
    offsets = F.array(*[F.array(*[F.lit(k >> d & 1).cast("long") for d in range(dim)]) for k in range(1 << dim)])
    return leaves.select((F.col("level") + 1).alias("level"), F.explode(F.transform(offsets, lambda o: F.zip_with("coords", o, lambda c, x: c * 2 + x))).alias("coords"))


def parent(coords: Column) -> Column:
    return F.transform(coords, lambda c: F.shiftright(c, 1))


def refine_by_indicator(leaves: DataFrame, dim: int, threshold: float) -> DataFrame:
    """leaves(level, coords, value): those above the threshold are split."""
    kept = leaves.where(F.col("value") <= threshold).select("level", "coords")
    return kept.unionByName(children(leaves.where(F.col("value") > threshold), dim))


def coarsen_by_indicator(leaves: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Complete sets of siblings all below the threshold become their parent."""
    up = leaves.where("level > 0").groupBy("level", parent(F.col("coords")).alias("up")).agg(F.count("*").alias("n"), F.max("value").alias("m")).where((F.col("n") == 1 << dim) & (F.col("m") < threshold))
    gone = leaves.withColumn("up", parent(F.col("coords"))).join(up.select("level", "up"), ["level", "up"], "left_semi").select("level", "coords")
    return leaves.select("level", "coords").join(gone, ["level", "coords"], "left_anti").unionByName(up.select((F.col("level") - 1).alias("level"), F.col("up").alias("coords")))


def conforming(leaves: DataFrame, dim: int) -> DataFrame:
    """Leaves split until face neighbours have equal levels, which makes every connected forest uniform."""
    now = cut(leaves.select("level", "coords"))
    while True:
        top = now.agg(F.max("level")).first()[0]
        low = now.where(F.col("level") < (top or 0))
        if empty(low):
            return now
        now = cut(now.where(F.col("level") == top).unionByName(children(low, dim)))


def forest_mesh(leaves: DataFrame, dim: int) -> DataFrame:
    """(level, coords, slot, vertex): corners of uniform leaves as integer places, in the cell's vertex order."""
    ring = [(0,), (1,)] if dim == 1 else [(0, 0), (1, 0), (1, 1), (0, 1)]
    corners = ring if dim < 3 else [(*c, z) for z in (0, 1) for c in ring]
    offsets = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in corners])
    return leaves.select("level", "coords", F.posexplode(F.transform(offsets, lambda o: F.zip_with("coords", o, lambda c, x: c + x))).alias("slot", "vertex"))
