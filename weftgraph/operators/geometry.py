"""Cell measures, quality, face metrics, point location and field transfer."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.cells import EDGES, FACES, choose
from .topology import last_before


def _p(pts: Column, k: int) -> Column:
    return F.get(pts, F.lit(k))


def _triangle(a: Column, b: Column, c: Column) -> Column:
    return V.norm(V.cross(V.sub(b, a), V.sub(c, a))) / 2


def _tetrahedron(a: Column, b: Column, c: Column, d: Column) -> Column:
    return V.dot(V.cross(V.sub(b, a), V.sub(c, a)), V.sub(d, a)) / 6


#: Tetrahedra that fill each solid.
TETRAHEDRA = {
    "tetrahedron": [(0, 1, 2, 3)],
    "pyramid": [(0, 1, 2, 4), (0, 2, 3, 4)],
    "prism": [(0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)],
    "hexahedron": [(0, 1, 3, 4), (1, 2, 3, 6), (1, 3, 4, 6), (1, 4, 5, 6), (3, 4, 6, 7)],
}


def measure(tag: Column, pts: Column) -> Column:
    """Length, area or volume of a cell, unsigned."""
    solids = choose(tag, TETRAHEDRA, lambda _, ts: sum((F.abs(_tetrahedron(*(_p(pts, i) for i in t))) for t in ts), F.lit(0.0)))
    return (
        F.when(tag == "segment", V.norm(V.sub(_p(pts, 1), _p(pts, 0))))
        .when(tag == "triangle", _triangle(_p(pts, 0), _p(pts, 1), _p(pts, 2)))
        .when(tag == "quadrilateral", _triangle(_p(pts, 0), _p(pts, 1), _p(pts, 2)) + _triangle(_p(pts, 0), _p(pts, 2), _p(pts, 3)))
        .otherwise(solids)
    )


def signed_measure(tag: Column, pts: Column) -> Column:
    """Signed area of plane cells and signed volume of tetrahedra, positive in the reference order."""
    ring = F.transform(F.sequence(F.lit(0), F.size(pts) - 1), lambda i: F.struct(F.get(pts, i).alias("a"), F.get(pts, (i + 1) % F.size(pts)).alias("b")))
    shoelace = V.total(F.transform(ring, lambda e: V.at(e["a"], 0) * V.at(e["b"], 1) - V.at(e["a"], 1) * V.at(e["b"], 0))) / 2
    return F.when(tag.isin("triangle", "quadrilateral"), shoelace).when(tag == "tetrahedron", _tetrahedron(*(_p(pts, i) for i in range(4)))).otherwise(measure(tag, pts))


def edge_lengths(tag: Column, pts: Column) -> Column:
    return choose(tag, EDGES, lambda _, es: F.array(*[V.norm(V.sub(_p(pts, b), _p(pts, a))) for a, b in es]))


def face_angles(tag: Column, pts: Column) -> Column:
    """Angles in degrees at the corners of all faces."""

    def corner(a: int, b: int, c: int) -> Column:
        u, v = V.sub(_p(pts, a), _p(pts, b)), V.sub(_p(pts, c), _p(pts, b))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(u, v) / (V.norm(u) * V.norm(v))))))

    def corners(faces) -> Column:
        return F.array(*[corner(f[k - 1], f[k], f[(k + 1) % len(f)]) for f in faces for k in range(len(f))])

    return choose(tag, FACES, lambda _, fs: corners(fs))


def quality(cells: DataFrame) -> DataFrame:
    """(cell, tag, aspect_ratio, min_angle, signed_measure, measure) of cells(cell, tag, pts)."""
    tag, pts = F.col("tag"), F.col("pts")
    e = edge_lengths(tag, pts)
    return cells.withColumn("e", e).select("cell", "tag", (F.array_max("e") / F.array_min("e")).alias("aspect_ratio"), F.array_min(face_angles(tag, pts)).alias("min_angle"), signed_measure(tag, pts).alias("signed_measure"), measure(tag, pts).alias("measure"))


def geometry_faults(cells: DataFrame, least_angle: float = 1.0, most_ratio: float = 100.0) -> DataFrame:
    return quality(cells).where((F.col("signed_measure") <= 0) | (F.col("min_angle") < least_angle) | (F.col("aspect_ratio") > most_ratio))


def normals(faces: DataFrame) -> DataFrame:
    """(face, normal) of faces(face, pts): unit normals of plane polygons, or of segments in the plane."""
    pts = F.col("pts")
    flat = F.array(V.at(V.sub(_p(pts, 1), _p(pts, 0)), 1), -V.at(V.sub(_p(pts, 1), _p(pts, 0)), 0))
    n = F.when(F.size(pts) == 2, flat).otherwise(V.cross(V.sub(_p(pts, 1), _p(pts, 0)), V.sub(_p(pts, 2), _p(pts, 0))))
    return faces.withColumn("_n", n).select("face", V.scale(F.col("_n"), 1 / V.norm(F.col("_n"))).alias("normal"))


def face_metrics(faces: DataFrame, supports: DataFrame, cell_pts: DataFrame) -> DataFrame:
    """(face, owner, neighbor, centroid, area_vector, area, distance, non_orthogonality, skewness).

    faces(face, pts), supports(face, cell); the owner is the least cell and the area vector points out of it. A
    boundary face has no neighbor, and its distance is from the owner's centre to its own.
    """
    cells = supports.groupBy("face").agg(F.array_sort(F.collect_list("cell")).alias("c")).select("face", F.get("c", F.lit(0)).alias("owner"), F.get("c", F.lit(1)).alias("neighbor"))
    centre = cell_pts.select("cell", V.mean(F.col("pts")).alias("x"))
    pts = F.col("pts")
    edge = V.sub(_p(pts, 1), _p(pts, 0))
    flat = F.array(V.at(edge, 1), -V.at(edge, 0))
    solid = V.scale(V.cross(V.sub(_p(pts, 2), _p(pts, 0)), V.sub(F.coalesce(_p(pts, 3), _p(pts, 2)), _p(pts, 1))), 0.5)
    triangle = V.scale(V.cross(edge, V.sub(_p(pts, 2), _p(pts, 0))), 0.5)
    area = F.when(F.size(pts) == 2, flat).when(F.size(pts) == 3, triangle).otherwise(solid)
    got = faces.join(cells, "face").join(centre.select(F.col("cell").alias("owner"), F.col("x").alias("xo")), "owner").join(centre.select(F.col("cell").alias("neighbor"), F.col("x").alias("xn")), "neighbor", "left")
    got = got.withColumn("centroid", V.mean(pts)).withColumn("_s", area).withColumn("_out", V.sub(F.col("centroid"), F.col("xo")))
    got = got.withColumn("area_vector", F.when(V.dot(F.col("_s"), F.col("_out")) < 0, V.scale(F.col("_s"), -1.0)).otherwise(F.col("_s"))).withColumn("d", V.sub(F.coalesce("xn", "centroid"), F.col("xo")))
    got = got.withColumn("area", V.norm(F.col("area_vector"))).withColumn("distance", V.norm(F.col("d")))
    cosine = V.dot(F.col("d"), F.col("area_vector")) / (F.col("area") * F.col("distance"))
    # the line between the centres meets the face's plane at this share of its length
    share = V.dot(F.col("_out"), F.col("area_vector")) / V.dot(F.col("d"), F.col("area_vector"))
    hit = V.add(F.col("xo"), V.scale(F.col("d"), share))
    return got.select("face", "owner", "neighbor", "centroid", "area_vector", "area", "distance", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("non_orthogonality"), (V.norm(V.sub(F.col("centroid"), hit)) / F.col("distance")).alias("skewness"))


def boxes(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(cell, tag, pts, low, high): bounding boxes, inflated by tolerance."""
    dim = F.sequence(F.lit(0), F.size(F.get("pts", F.lit(0))) - 1)
    side = lambda agg: F.transform(dim, lambda k: agg(F.transform("pts", lambda p: F.get(p, k))))
    return cells.withColumn("low", F.transform(side(F.array_min), lambda x: x - tolerance)).withColumn("high", F.transform(side(F.array_max), lambda x: x + tolerance))


def _inside(tag: Column, pts: Column, x: Column, tolerance: float) -> Column:
    """Whether x lies in a cell, by measures: the parts that x spans with the faces fill it exactly."""
    ring = F.transform(F.sequence(F.lit(0), F.size(pts) - 1), lambda i: F.struct(F.get(pts, i).alias("a"), F.get(pts, (i + 1) % F.size(pts)).alias("b")))
    fan = V.total(F.transform(ring, lambda e: _triangle(x, e["a"], e["b"])))

    def solid(_, fs) -> Column:
        tri = [(f[0], f[k], f[k + 1]) for f in fs for k in range(1, len(f) - 1)]
        return sum((F.abs(_tetrahedron(*(_p(pts, i) for i in t), x)) for t in tri), F.lit(0.0))

    got = F.when(tag == "segment", V.norm(V.sub(x, _p(pts, 0))) + V.norm(V.sub(x, _p(pts, 1)))).when(tag.isin("triangle", "quadrilateral"), fan).otherwise(choose(tag, {k: v for k, v in FACES.items() if k not in ("triangle", "quadrilateral")}, solid))
    return got <= measure(tag, pts) * (1 + 1e-9) + tolerance


def locate(cells: DataFrame, queries: DataFrame, size: float, tolerance: float = 1e-9) -> DataFrame:
    """(query, cell): the least cell of cells(cell, tag, pts) that holds each point of queries(query, x); null outside all.

    Both sides go to the grid buckets of edge `size` that they touch and meet there by an equi-join, so no pair far
    apart is looked at.
    """
    box = boxes(cells, tolerance)

    def cells_of(k: int) -> Column:
        return F.when(F.size("low") > k, F.sequence(F.floor(F.get("low", F.lit(k)) / size), F.floor(F.get("high", F.lit(k)) / size))).otherwise(F.array(F.lit(0).cast("long")))

    for k, name in enumerate(("bx", "by", "bz")):
        box = box.withColumn(name, F.explode(cells_of(k)))
    q = queries
    for k, name in enumerate(("bx", "by", "bz")):
        q = q.withColumn(name, F.floor(V.at(F.col("x"), k) / size))
    met = q.join(box, ["bx", "by", "bz"]).where(_inside(F.col("tag"), F.col("pts"), F.col("x"), tolerance))
    found = met.groupBy("query").agg(F.min("cell").alias("cell"))
    return queries.select("query").join(found, "query", "left")


def wrapped(x: Column, low: list[float], period: list[float | None]) -> Column:
    """A point brought into a periodic box."""
    return F.array(*[F.get(x, F.lit(k)) if p is None else F.lit(a) + F.pmod(F.get(x, F.lit(k)) - a, F.lit(p)) for k, (a, p) in enumerate(zip(low, period, strict=True))])


def _nearest_on_line(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """nearest in one dimension: targets and the sources' positions are sorted together, so each target meets the
    positions on its two sides and no others. Positions beyond these whose distance rounds to the same number are
    looked for where there are any."""
    from ..plans.loops import cut, empty

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    first = F.get("x", F.lit(0)).cast("double")
    spots = cut(sources.select(first.alias("x"), "source").where(finite(F.col("x"))).groupBy("x").agg(F.min("source").alias("source")))
    if empty(spots):
        return targets.select("target", F.lit(None).cast("long").alias("source"), F.lit(None).cast("double").alias("distance")).distinct()
    spots = cut(last_before(spots, F.col("x"), ["x"], "below"))
    follows = spots.select(F.col("below").alias("x"), F.col("x").alias("nx"), F.col("source").alias("next"))
    spots = spots.join(follows, "x", "left").join(follows.select(F.col("x").alias("nx"), F.col("nx").alias("above")), "nx", "left")
    spots = cut(spots.select("x", F.struct("x", "source", "below").alias("low"), F.struct(F.col("nx").alias("x"), F.col("next").alias("source"), "above").alias("high")))
    least = F.broadcast(spots.agg(F.min_by(F.struct(F.col("low.x").alias("x"), F.col("low.source").alias("source"), F.col("high.x").alias("above")), "x").alias("lowest"), F.min("low.source").alias("least")))
    at = targets.select("target", first.alias("x"))

    rows = spots.select("x", F.lit(None).cast(at.schema["target"].dataType).alias("target"), F.struct("low", "high").alias("spot"), F.lit(0).alias("kind"))
    rows = rows.unionByName(at.where(finite(F.col("x"))).select("x", "target", F.lit(None).cast(rows.schema["spot"].dataType).alias("spot"), F.lit(1).alias("kind")))
    met = last_before(rows, F.col("spot"), ["x", "kind", "target"], "by").where("kind = 1").crossJoin(least)
    met = met.select("target", "x", F.col("by.low").alias("low"), F.when(F.col("by").isNull(), F.col("lowest")).otherwise(F.col("by.high")).alias("high"))
    off = lambda c: F.abs(F.col("x") - F.col(c))
    met = met.withColumn("distance", F.least(off("low.x"), off("high.x")))
    is_low, is_high = off("low.x") == F.col("distance"), off("high.x") == F.col("distance")
    more = (is_low & (off("low.below") == F.col("distance"))) | (is_high & (off("high.above") == F.col("distance")))
    met = cut(met.select("target", "x", F.least(F.when(is_low, F.col("low.source")), F.when(is_high, F.col("high.source"))).alias("source"), "distance", F.coalesce(more, F.lit(False)).alias("more")))
    found = met.where("not more").select("target", "source", "distance")
    rounded = met.where("more").select("x", "distance").distinct()
    if not empty(rounded):
        same = rounded.crossJoin(spots.select(F.col("low.x").alias("s"), F.col("low.source").alias("source"))).where(F.abs(F.col("x") - F.col("s")) == F.col("distance"))
        found = found.unionByName(met.where("more").select("target", "x").join(same.groupBy("x").agg(F.min("source").alias("source"), F.min("distance").alias("distance")), "x").select("target", "source", "distance"))
    # from a place that isn't known, or is at infinity, all are as far
    found = found.unionByName(at.where(~finite(F.col("x"))).crossJoin(least).select("target", F.col("least").alias("source"), F.abs("x").alias("distance")))
    best = F.min(F.struct(F.col("distance").isNull().alias("unknown"), "distance", "source"))
    return found.groupBy("target").agg(best.alias("m")).select("target", F.col("m.source").alias("source"), F.col("m.distance").alias("distance"))


def nearest(sources: DataFrame, targets: DataFrame, size: float, rings: int = 64) -> DataFrame:
    """(target, source, distance): the nearest of sources(source, x) to each of targets(target, x), the least id of equals.

    On a line both sides are sorted together. In more dimensions sources at one place are one, and grid buckets are
    searched ring by ring; a target is done when its best is nearer than the next ring, and what is left after `rings`
    doublings of the ring is an error.
    """
    from ..plans.loops import cut, empty

    dim = sources.select(F.max(F.size("x"))).first()[0] or 1
    if dim == 1:
        return _nearest_on_line(sources, targets)
    sources = cut(sources.groupBy("x").agg(F.min("source").alias("source")))
    names = [f"b{k}" for k in range(dim)]

    def at(df: DataFrame, step: float) -> DataFrame:
        return df.withColumns({n: F.floor(F.get("x", F.lit(k)) / step) for k, n in enumerate(names)})

    left, done, step = cut(targets), None, size
    if empty(sources):
        return targets.select("target", F.lit(None).cast("long").alias("source"), F.lit(None).cast("double").alias("distance"))
    for _ in range(rings):
        near = at(left, step)
        for n in names:
            near = near.withColumn(n, F.explode(F.array(*[F.col(n) + d for d in (-1, 0, 1)])))
        pairs = near.withColumnRenamed("x", "tx").join(at(sources, step), names).withColumn("distance", V.norm(V.sub(F.col("tx"), F.col("x"))))
        best = pairs.groupBy("target").agg(F.min(F.struct("distance", "source")).alias("m")).select("target", F.col("m.source").alias("source"), F.col("m.distance").alias("distance")).where(F.col("distance") <= step)
        best = cut(best)
        done = best if done is None else done.unionByName(best)
        left = cut(left.join(best.select("target"), "target", "left_anti"))
        if empty(left):
            return done
        step *= 2
    raise RuntimeError("points too far apart for the bucket size")


def barycentric(pts: Column, x: Column) -> Column:
    """Weights of a triangle's vertices at x, in the plane."""
    a, b, c = (_p(pts, k) for k in range(3))
    area = lambda p, q, r: (V.at(q, 0) - V.at(p, 0)) * (V.at(r, 1) - V.at(p, 1)) - (V.at(r, 0) - V.at(p, 0)) * (V.at(q, 1) - V.at(p, 1))
    t = area(a, b, c)
    return F.array(area(x, b, c) / t, area(a, x, c) / t, area(a, b, x) / t)


def interpolate_at(located: DataFrame, cells: DataFrame, values: DataFrame) -> DataFrame:
    """(query, value): shape-function interpolation of vertex values in located triangles; located(query, cell, x), cells(cell, vertices, pts)."""
    w = located.join(cells, "cell").select("query", F.posexplode(barycentric(F.col("pts"), F.col("x"))).alias("k", "w"), "vertices")
    return w.select("query", "w", F.get("vertices", F.col("k")).alias("point")).join(values.select("point", "value"), "point").groupBy("query").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


