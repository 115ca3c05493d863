"""Reference elements: quadrature, Lagrange bases, element matrices and their assembly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import DIMENSION

#: Cell types on the unit cube, and on the unit simplex.
CUBES, SIMPLICES = ("segment", "quadrilateral", "hexahedron"), ("segment", "triangle", "tetrahedron")


def gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre rule on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def quadrature(tag: str, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights exact for the degree: products of Gauss rules, collapsed towards corners for simplices, prisms and pyramids."""
    dim = DIMENSION[tag]
    n = max(1, degree // 2 + 1)
    if tag in ("triangle", "tetrahedron", "prism", "pyramid"):
        n += 1
    x, w = gauss(n)
    grid = np.stack(np.meshgrid(*[x] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
    weight = np.prod(np.stack(np.meshgrid(*[w] * dim, indexing="ij"), axis=-1).reshape(-1, dim), axis=1)
    if tag == "triangle" or tag == "prism":
        s = 1 - grid[:, 0]
        out = grid.copy()
        out[:, 1] = grid[:, 1] * s
        return out, weight * s
    if tag == "tetrahedron":
        a = 1 - grid[:, 0]
        b = a * (1 - grid[:, 1])
        return np.stack([grid[:, 0], grid[:, 1] * a, grid[:, 2] * b], axis=1), weight * a * b
    if tag == "pyramid":
        s = 1 - grid[:, 2]
        return np.stack([0.5 + (grid[:, 0] - 0.5) * s, 0.5 + (grid[:, 1] - 0.5) * s, grid[:, 2]], axis=1), weight * s * s
    return grid, weight


def nodes(tag: str, order: int = 1) -> np.ndarray:
    """Reference places of a Lagrange basis; for order 1 in the order of the cell's vertices."""
    if order == 1:
        return np.array({"segment": [[0], [1]], "triangle": [[0, 0], [1, 0], [0, 1]], "quadrilateral": [[0, 0], [1, 0], [1, 1], [0, 1]], "tetrahedron": [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]],
                         "hexahedron": [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]], "prism": [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [0, 1, 1]]}[tag], float)
    return _powers(tag, order) / order


def _powers(tag: str, order: int) -> np.ndarray:
    dim = DIMENSION[tag]
    grid = np.stack(np.meshgrid(*[np.arange(order + 1)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
    if tag in ("triangle", "tetrahedron"):
        grid = grid[grid.sum(1) <= order]
    elif tag == "prism":
        grid = grid[grid[:, :2].sum(1) <= order]
    return grid


def tabulate(tag: str, order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (points, nodes) and gradients (points, nodes, dim) of the Lagrange basis, by inverting its Vandermonde matrix.

    A pyramid has its base's bilinear basis fading towards the apex, of order 1 only.
    """
    if tag == "pyramid":
        if order != 1:
            raise ValueError("a pyramid has a basis of order 1 only")
        base, slope = tabulate("quadrilateral", 1, at[:, :2])
        up = at[:, 2:]
        values = np.concatenate([base * (1 - up), up], axis=1)
        grads = np.zeros((len(at), 5, 3))
        grads[:, :4, :2], grads[:, :4, 2], grads[:, 4, 2] = slope * (1 - up)[..., None], -base, 1.0
        return values, grads
    exps, where = _powers(tag, order), nodes(tag, order)
    if len(exps) != len(where):
        raise ValueError(f"{tag} has no Lagrange basis of order {order}")
    mono = lambda x: np.prod(x[:, None, :] ** exps[None], axis=2)
    inv = np.linalg.inv(mono(where))
    grads = []
    for d in range(exps.shape[1]):
        low = exps.copy()
        low[:, d] = np.maximum(low[:, d] - 1, 0)
        grads.append((np.prod(at[:, None, :] ** low[None], axis=2) * exps[:, d]) @ inv)
    return mono(at) @ inv, np.stack(grads, axis=2)


def table(spark: SparkSession, tag: str, order: int = 1, degree: int = 2) -> DataFrame:
    """(q, weight, x, node, value, grad): a tabulation small enough to broadcast by construction."""
    x, w = quadrature(tag, degree)
    v, g = tabulate(tag, order, x)
    rows = [(q, float(w[q]), x[q].tolist(), k, float(v[q, k]), g[q, k].tolist()) for q in range(len(w)) for k in range(v.shape[1])]
    return spark.createDataFrame(rows, "q int, weight double, x array<double>, node int, value double, grad array<double>")


def element_matrices(cells: DataFrame, tag: str, degree: int = 2, load: float = 1.0) -> DataFrame:
    """(cell, row, col, stiffness, mass, load) by local nodes, for first-order cells(cell, tag, pts) of one type.

    Cells go through numpy in Arrow batches: a batch's Jacobians are one array, and each cell's matrices come out as
    long rows, ready for a grouped sum. A degenerate cell has no volume, so its entries are zero; surfaces in space are
    measured as they lie.
    """
    from collections.abc import Iterator

    import pandas as pd

    x, w = quadrature(tag, degree)
    v, g = tabulate(tag, 1, x)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if pdf.empty:
                continue
            pts = np.array([[list(p) for p in c] for c in pdf["pts"]], float)
            jac = np.einsum("cnd,qnr->cqdr", pts, g)
            square = np.einsum("cqdr,cqds->cqrs", jac, jac)  # cells of a surface or line have fewer columns than rows
            det = np.sqrt(np.maximum(np.linalg.det(square), 0.0))
            grad = np.einsum("qnr,cqrd->cqnd", g, np.linalg.pinv(jac))
            stiff = np.einsum("q,cq,cqnd,cqmd->cnm", w, det, grad, grad)
            mass = np.einsum("q,cq,qn,qm->cnm", w, det, v, v)
            rhs = load * np.einsum("q,cq,qn->cn", w, det, v)
            n = v.shape[1]
            row, col = np.divmod(np.arange(n * n), n)
            c = len(pdf)
            yield pd.DataFrame({"cell": np.repeat(pdf["cell"].to_numpy(), n * n), "row": np.tile(row, c), "col": np.tile(col, c), "stiffness": stiff.ravel(), "mass": mass.ravel(), "load": np.where(np.tile(row == col, c), np.repeat(rhs, n, axis=1).ravel(), 0.0)})

    return cells.where(F.col("tag") == tag).select("cell", "pts").mapInPandas(run, "cell long, row int, col int, stiffness double, mass double, load double")


def integrate(tag: str, f, degree: int = 2) -> float:
    """Integral over the reference cell of f(points): numpy over one quadrature rule."""
    x, w = quadrature(tag, degree)
    return float(np.sum(w * np.asarray(f(x), float)))


#: What each cell type can be used for: finite elements of order one, finite volumes.
CAPABILITY = {tag: (True, True) for tag in ("segment", "triangle", "quadrilateral", "tetrahedron", "hexahedron", "prism", "pyramid")} | {"polygon": (False, True), "polyhedron": (False, True), "vertex": (False, False)}


def unsupported(cell_types: DataFrame, method: str = "finite_volume") -> DataFrame:
    """(point, tag) of cells whose type the method can't use; vertices don't count."""
    k = ("finite_element", "finite_volume").index(method)
    good = [t for t, c in CAPABILITY.items() if c[k]] + ["vertex", *(["simplex"] if k else [])]
    return cell_types.where(~F.col("tag").isin(good)).select("point", "tag")


def assemble(matrices: DataFrame, cells: DataFrame, value: str = "stiffness") -> DataFrame:
    """(row, col, value) by global vertices; cells(cell, vertices)."""
    got = matrices.join(cells.select("cell", "vertices"), "cell")
    return got.select(F.get("vertices", F.col("row")).alias("row"), F.get("vertices", F.col("col")).alias("col"), F.col(value).alias("value")).groupBy("row", "col").agg(F.sum("value").alias("value"))


def redistribute(residual: DataFrame, terms: DataFrame) -> DataFrame:
    """(point, value): residuals of hanging points(point, value) go to their parents by weight; terms(point, src_point, weight)."""
    kept = residual.join(terms.select("point").distinct(), "point", "left_anti")
    moved = residual.join(terms, "point").select(F.col("src_point").alias("point"), (F.col("weight") * F.col("value")).alias("value"))
    return kept.unionByName(moved).groupBy("point").agg(F.sum("value").alias("value"))


def metadata_for(cells: DataFrame, by_label: DataFrame, by_type: DataFrame) -> DataFrame:
    """(cell, basis, quadrature): a cell's label decides before its type; by_label(name, value, ...), by_type(tag, ...)."""
    own = cells.join(F.broadcast(by_label), ["name", "value"], "left") if "name" in cells.columns else cells.withColumn("basis", F.lit(None).cast("string")).withColumn("quadrature", F.lit(None).cast("string"))
    typed = by_type.select("tag", F.col("basis").alias("b2"), F.col("quadrature").alias("q2"))
    return own.join(F.broadcast(typed), "tag", "left").select("cell", F.coalesce("basis", "b2").alias("basis"), F.coalesce("quadrature", "q2").alias("quadrature"))
