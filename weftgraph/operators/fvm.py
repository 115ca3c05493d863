"""Finite volumes: face loops, convective and diffusive fluxes, gradients, boundary branches, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def face_loops(supports: DataFrame) -> DataFrame:
    """(face, owner, neighbor, kind): one support makes a boundary face, two an internal one, others are faults."""
    got = supports.groupBy("face").agg(F.array_sort(F.collect_set("cell")).alias("c"))
    kind = F.when(F.size("c") == 1, "boundary").when(F.size("c") == 2, "internal").otherwise("fault")
    return got.select("face", F.get("c", F.lit(0)).alias("owner"), F.get("c", F.lit(1)).alias("neighbor"), kind.alias("kind"))


def joined(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """faces(face, owner, neighbor, ...) with the values phi of both cells as phi_o and phi_n."""
    return faces.join(cells.select(F.col("cell").alias("owner"), F.col("phi").alias("phi_o")), "owner").join(cells.select(F.col("cell").alias("neighbor"), F.col("phi").alias("phi_n")), "neighbor", "left")


def limiter(family: str, r: Column) -> Column:
    """Slope limiters of the ratio of consecutive gradients."""
    zero, one, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    if family == "none":
        return one
    if family == "minmod":
        return F.greatest(zero, F.least(one, r))
    if family == "van_leer":
        return F.when(r > 0, 2 * r / (1 + r)).otherwise(zero)
    if family == "superbee":
        return F.greatest(zero, F.least(2 * r, one), F.least(r, two))
    if family == "van_albada":
        return F.when(r > 0, (r * r + r) / (r * r + 1)).otherwise(zero)
    raise ValueError(family)


def face_value(scheme: str, mass: Column, phi_o: Column, phi_n: Column) -> Column:
    if scheme == "upwind":
        return F.when(mass >= 0, phi_o).otherwise(phi_n)
    if scheme == "central":
        return (phi_o + phi_n) / 2
    raise ValueError(scheme)


def convective(faces: DataFrame, scheme: str = "upwind") -> DataFrame:
    """faces(mass_flux, phi_o, phi_n, phi_b) with flux out of the owner; a missing neighbor takes the boundary value, else the owner's."""
    other = F.coalesce("phi_n", "phi_b", "phi_o") if "phi_b" in faces.columns else F.coalesce("phi_n", "phi_o")
    return faces.withColumn("flux", F.col("mass_flux") * face_value(scheme, F.col("mass_flux"), F.col("phi_o"), other))


def diffusive(faces: DataFrame, gamma: float, correction: str = "ignore") -> DataFrame:
    """faces(area, distance, phi_o, phi_n, non_orthogonality) with flux -gamma (phi_n - phi_o) area / distance.

    The non-orthogonal part is ignored, returned in `deferred`, or added to the flux.
    """
    other = F.coalesce("phi_n", "phi_b", "phi_o") if "phi_b" in faces.columns else F.coalesce("phi_n", "phi_o")
    straight = -F.lit(gamma) * (other - F.col("phi_o")) * F.col("area") / F.col("distance")
    extra = straight * (1 / F.cos(F.radians("non_orthogonality")) - 1)
    return faces.withColumn("flux", straight + extra if correction == "add" else straight).withColumn("deferred", extra if correction == "defer" else F.lit(0.0))


def residual(faces: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(cell, residual): fluxes added to owners and taken from neighbors, with partial sums before the shuffle."""
    signed = F.array(F.struct(F.col("owner").alias("cell"), F.col("flux").alias("v")), F.struct(F.col("neighbor").alias("cell"), (-F.col("flux")).alias("v")))
    rows = faces.select(F.explode(signed).alias("x")).select("x.cell", "x.v").where("cell is not null")
    if sources is not None:
        rows = rows.unionByName(sources.select("cell", F.col("source").alias("v")))
    return rows.groupBy("cell").agg(F.sum("v").alias("residual"))


#: Fixed value: the least divisor in a mixed condition.
TINY = 1e-14


def _by_branch(conditions: dict[str, tuple], form) -> Column:
    """form(kind, parameters) by a face's branch; null for others."""
    out = F.when(F.lit(False), F.lit(0.0))
    for branch, (kind, *p) in sorted(conditions.items()):
        out = out.when(F.col("branch") == branch, form(kind, p))
    return out


def _border_value(kind: str, p: list[float]) -> Column:
    phi = F.col("phi_o")
    if kind == "dirichlet":
        return F.lit(float(p[0]))
    if kind == "neumann":
        return phi
    alpha, beta, gamma = p
    return phi if abs(alpha) < TINY else (gamma - beta * phi) / alpha


def _border_slope(kind: str, p: list[float]) -> Column:
    phi = F.col("phi_o")
    if kind == "dirichlet":
        return (F.lit(float(p[0])) - phi) / F.greatest("distance", F.lit(TINY))
    if kind == "neumann":
        return F.lit(float(p[0]))
    alpha, beta, gamma = p
    return (gamma - alpha * phi) / max(beta, TINY)


def system_faults(faces: DataFrame, convective: dict[str, tuple], diffusive: dict[str, tuple]) -> DataFrame:
    """(face, fault) of what assemble_system can't take: faces(face, owner, neighbor, area, distance, branch)."""
    both = sorted(set(convective) & set(diffusive))
    border = F.col("neighbor").isNull()
    tests = {
        "no_metric": F.col("area").isNull() | F.col("distance").isNull(),
        "no_cell": F.col("phi_o").isNull() | (~border & F.col("phi_n").isNull()),
        "no_branch": border & F.col("branch").isNull(),
        "unsupported_branch": border & F.col("branch").isNotNull() & ~F.col("branch").isin(both),
        "branch_inside": ~border & F.col("branch").isNotNull(),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return faces.select("face", F.explode(found).alias("fault"))


def assemble_system(faces: DataFrame, convective: dict[str, tuple], diffusive: dict[str, tuple], gamma: float, scheme: str = "upwind", strict: bool = True) -> DataFrame:
    """(cell, convective, diffusive, residual, source) of faces(face, owner, neighbor, mass_flux, phi_o, phi_n, area, distance, branch).

    Conditions by branch are ("dirichlet", value), ("neumann", gradient) or ("robin", alpha, beta, gamma), for the
    convected value and for the normal gradient. A boundary face without one is an error, or adds nothing if not strict.
    """
    border = F.col("neighbor").isNull()
    lost = F.raise_error(F.concat(F.lit("no condition on face "), F.coalesce(F.col("face").cast("string"), F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    other = F.when(border, F.coalesce(_by_branch(convective, _border_value), lost)).otherwise(F.col("phi_n"))
    slope = F.when(border, F.coalesce(_by_branch(diffusive, _border_slope), lost)).otherwise((F.col("phi_n") - F.col("phi_o")) / F.col("distance"))
    mixed = _by_branch(diffusive, lambda kind, p: F.lit(p[2] / max(p[1], TINY)) if kind == "robin" else F.lit(0.0))
    flux = faces.select("owner", "neighbor", (F.col("mass_flux") * face_value(scheme, F.col("mass_flux"), F.col("phi_o"), other)).alias("c"), (-F.lit(gamma) * slope * F.col("area")).alias("d"), F.when(border, F.lit(gamma) * mixed * F.col("area")).alias("s"))
    side = lambda end, sign: F.struct(F.col(end).alias("cell"), (sign * F.col("c")).alias("c"), (sign * F.col("d")).alias("d"), (F.col("s") if sign > 0 else F.lit(0.0)).alias("s"))
    rows = flux.select(F.explode(F.array(side("owner", 1.0), side("neighbor", -1.0))).alias("x")).select("x.*").where("cell is not null")
    got = rows.groupBy("cell").agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(n) for k, n in (("c", "convective"), ("d", "diffusive"), ("s", "source"))])
    return got.select("cell", "convective", "diffusive", (F.col("convective") + F.col("diffusive")).alias("residual"), "source")


def gradients(faces: DataFrame, volumes: DataFrame) -> DataFrame:
    """(cell, gradient) by Green and Gauss: mean face values times area vectors, over the volume; one component a row."""
    mean = (F.col("phi_o") + F.coalesce("phi_n", "phi_o")) / 2
    own = faces.select(F.explode(F.array(F.struct(F.col("owner").alias("cell"), F.lit(1.0).alias("s")), F.struct(F.col("neighbor").alias("cell"), F.lit(-1.0).alias("s")))).alias("x"), mean.alias("m"), "area_vector")
    rows = own.select("x.cell", F.posexplode(F.transform("area_vector", lambda a: a * F.col("m") * F.col("x.s"))).alias("axis", "v")).where("cell is not null")
    return rows.groupBy("cell", "axis").agg(F.sum("v").alias("v")).join(volumes.select("cell", "volume"), "cell").select("cell", "axis", (F.col("v") / F.col("volume")).alias("gradient"))


def least_squares(faces: DataFrame, centres: DataFrame) -> DataFrame:
    """(cell, gx, gy) in the plane by inverse-distance weighted least squares over the neighbours."""
    pairs = faces.where("neighbor is not null").select(F.explode(F.array(F.struct(F.col("owner").alias("cell"), F.col("neighbor").alias("o"), (F.col("phi_n") - F.col("phi_o")).alias("d")), F.struct(F.col("neighbor").alias("cell"), F.col("owner").alias("o"), (F.col("phi_o") - F.col("phi_n")).alias("d")))).alias("p")).select("p.*")
    c = centres.select("cell", F.col("x").alias("xc"))
    got = pairs.join(c, "cell").join(c.select(F.col("cell").alias("o"), F.col("xc").alias("xo")), "o").withColumn("r", V.sub(F.col("xo"), F.col("xc")))
    x, y, w, d = V.at(F.col("r"), 0), V.at(F.col("r"), 1), 1 / V.dot(F.col("r"), F.col("r")), F.col("d")
    s = got.groupBy("cell").agg(F.sum(w * x * x).alias("a"), F.sum(w * x * y).alias("b"), F.sum(w * y * y).alias("c"), F.sum(w * x * d).alias("p"), F.sum(w * y * d).alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return s.select("cell", F.when(det != 0, (F.col("c") * F.col("p") - F.col("b") * F.col("q")) / det).alias("gx"), F.when(det != 0, (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det).alias("gy"))


def cells_from_faces(faces: DataFrame, values: DataFrame) -> DataFrame:
    """(cell, phi): mean of the values(face, value) of a cell's faces."""
    own = faces.select("face", F.explode(F.array("owner", "neighbor")).alias("cell")).where("cell is not null")
    return own.join(values, "face").groupBy("cell").agg(F.avg("value").alias("phi"))


def active(faces: DataFrame, labels: DataFrame, closed: str | None = None) -> DataFrame:
    """faces with `active`: false next to a dry cell on the boundary or, among faces labelled `closed`, anywhere."""
    dry = labels.where("name = 'wet_dry' and value = 0").select("point")
    d = dry.withColumn("dry", F.lit(True))
    got = faces.join(d.select(F.col("point").alias("owner"), F.col("dry").alias("do")), "owner", "left").join(d.select(F.col("point").alias("neighbor"), F.col("dry").alias("dn")), "neighbor", "left")
    marked = got.withColumn("_m", F.col("neighbor").isNull())
    if closed:
        named = labels.where(F.col("name") == closed).select(F.col("point").alias("face"), F.lit(True).alias("_c"))
        marked = marked.join(named, "face", "left").withColumn("_m", F.col("_m") | F.coalesce("_c", F.lit(False))).drop("_c")
    return marked.withColumn("active", ~(F.col("_m") & (F.coalesce("do", F.lit(False)) | F.coalesce("dn", F.lit(False))))).drop("do", "dn", "_m")


def boundary_branch(faces: DataFrame, labels: DataFrame, codes: dict[int, str], name: str = "bc", strict: bool = False) -> DataFrame:
    """(face, branch) of boundary faces by label code; an unknown code is 'unsupported', or an error of `strict`."""
    code = labels.where(F.col("name") == name).select(F.col("point").alias("face"), "value")
    branch = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])[F.col("value")]
    got = faces.where("neighbor is null").join(code, "face", "left").select("face", F.coalesce(branch, F.lit("unsupported")).alias("branch"))
    return got.withColumn("branch", F.when(F.col("branch") == "unsupported", F.raise_error(F.lit("unsupported boundary code"))).otherwise(F.col("branch"))) if strict else got


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """(metric, count, max, mean, p95): the 95th percentile is the value at round(0.95 (n - 1)), halves up, in order.

    Exact order statistics by a two-step dense index, so no column is gathered in one task.
    """
    from .topology import dense_index

    out = None
    for c in columns:
        v = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
        ranked = dense_index(v, ["v"], "i")
        agg = ranked.agg(F.count("*").alias("count"), F.max("v").alias("max"), F.avg("v").alias("mean"))
        n = agg.first()["count"]
        at = int(0.95 * (n - 1) + 0.5) if n else 0
        p = ranked.where(F.col("i") == at).agg(F.min("v").alias("p95"))
        one = agg.crossJoin(F.broadcast(p)).select(F.lit(c).alias("metric"), "count", "max", "mean", "p95")
        out = one if out is None else out.unionByName(one)
    return out


def cell_diagnostics(metrics: DataFrame) -> DataFrame:
    """(cell, non_orthogonality, skewness, boundary_faces): maxima over a cell's faces."""
    own = metrics.select(F.explode(F.array("owner", "neighbor")).alias("cell"), "non_orthogonality", "skewness", F.col("neighbor").isNull().alias("b")).where("cell is not null")
    return own.groupBy("cell").agg(F.max("non_orthogonality").alias("non_orthogonality"), F.max("skewness").alias("skewness"), F.sum(F.col("b").cast("int")).alias("boundary_faces"))


def readiness(metrics: DataFrame, most_angle: float = 70.0, most_skew: float = 4.0) -> DataFrame:
    """(check, violations) of thresholds on face metrics."""
    return metrics.agg(F.sum((F.col("non_orthogonality") > most_angle).cast("long")).alias("a"), F.sum((F.col("skewness") > most_skew).cast("long")).alias("s"), F.sum((F.col("area") <= 0).cast("long")).alias("z")).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(0)).alias("violations")) for n, c in (("non_orthogonality", "a"), ("skewness", "s"), ("degenerate_faces", "z"))])).alias("x")
    ).select("x.*")
