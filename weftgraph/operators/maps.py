"""Maps between reference and physical places of first-order cells, for rows with columns tag and pts.

Rows go through numpy in Arrow batches, by cell type. A row with a null, an unknown type, a wrong number of vertices or
a degenerate Jacobian gets null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import DIMENSION, VERTICES
from .fem import tabulate

#: The limits of the Newton iteration that inverts a cell's map.
START, STEPS, TOLERANCE = 0.5, 20, 1e-10
DEGENERATE = 1e-12


def _array(values) -> np.ndarray:
    return np.array([np.stack([np.asarray(p, float) for p in v]) if np.ndim(v[0]) else np.asarray(v, float) for v in values])


def _batched(tag: pd.Series, pts: pd.Series, extra: list[pd.Series], widths: list[bool], form: Callable[..., np.ndarray]) -> pd.Series:
    """form(tag, pts, *extra) for rows of one type and dimension at a time; an extra of width true has the reference's size."""
    out: list = [None] * len(tag)
    groups: dict[tuple, list[int]] = {}
    for i, (t, p) in enumerate(zip(tag, pts, strict=True)):
        rest = [e.iloc[i] for e in extra]
        if p is None or t not in VERTICES or t == "vertex" or len(p) != VERTICES[t] or any(x is None for x in (*p, *rest)):
            continue
        dim = len(p[0])
        if any(len(x) != dim for x in p) or any(len(x) != (DIMENSION[t] if w else dim) for x, w in zip(rest, widths, strict=True)):
            continue
        groups.setdefault((t, dim), []).append(i)
    for (t, _), rows in groups.items():
        got = form(t, _array(pts.iloc[rows]), *[_array(e.iloc[rows]) for e in extra])
        for i, g in zip(rows, got, strict=True):
            out[i] = None if np.isnan(g).any() else g.ravel().tolist()
    return pd.Series(out, dtype=object)


def _place(tag: str, pts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.einsum("cn,cnd->cd", tabulate(tag, 1, at)[0], pts)


def _jacobian(tag: str, pts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.einsum("cnd,cnr->cdr", pts, tabulate(tag, 1, at)[1])


def _push(tag: str, pts: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("cdr,cr->cd", _jacobian(tag, pts, at), v)


def _pull(tag: str, pts: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least squares: the reference vector whose image is nearest to v; nan where the columns are dependent."""
    jac = _jacobian(tag, pts, at)
    square, rhs = np.einsum("cdr,cds->crs", jac, jac), np.einsum("cdr,cd->cr", jac, v)
    good = np.abs(np.linalg.det(square)) > DEGENERATE
    out = np.full(rhs.shape, np.nan)
    if good.any():
        out[good] = np.linalg.solve(square[good], rhs[good][..., None])[..., 0]
    return out


def _invert(tag: str, pts: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.full((len(x), DIMENSION[tag]), START)
    live = np.arange(len(x))
    for _ in range(STEPS):
        off = _place(tag, pts[live], at[live]) - x[live]
        far = np.linalg.norm(off, axis=1) > TOLERANCE
        live, off = live[far], off[far]
        if not len(live):
            break
        at[live] -= _pull(tag, pts[live], at[live], off)
    return at


def _udf(form: Callable[..., np.ndarray], widths: list[bool]):
    if len(widths) == 1:
        def run(tag: pd.Series, pts: pd.Series, a: pd.Series) -> pd.Series:
            return _batched(tag, pts, [a], widths, form)
    else:
        def run(tag: pd.Series, pts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return _batched(tag, pts, [a, b], widths, form)
    return F.pandas_udf(run, "array<double>")


def reference_to_physical(rows: DataFrame, at: str | Column = "at", out: str = "x") -> DataFrame:
    """rows with `out`, the place whose reference coordinates are `at`."""
    return rows.withColumn(out, _udf(_place, [True])("tag", "pts", at))


def jacobian(rows: DataFrame, at: str | Column = "at", out: str = "jacobian") -> DataFrame:
    """rows with the map's derivatives at `at`, row by row: a row for each coordinate, a column for each reference one."""
    return rows.withColumn(out, _udf(_jacobian, [True])("tag", "pts", at))


def push_forward(rows: DataFrame, vector: str | Column, at: str | Column = "at", out: str = "pushed") -> DataFrame:
    """rows with the image of a reference vector."""
    return rows.withColumn(out, _udf(_push, [True, True])("tag", "pts", at, vector))


def pull_back(rows: DataFrame, vector: str | Column, at: str | Column = "at", out: str = "pulled") -> DataFrame:
    """rows with the reference vector whose image is nearest to a physical one."""
    return rows.withColumn(out, _udf(_pull, [True, False])("tag", "pts", at, vector))


def physical_to_reference(rows: DataFrame, x: str | Column = "x", out: str = "at") -> DataFrame:
    """rows with the reference place of `x` by Newton steps; what isn't there after STEPS steps stays where it got to."""
    return rows.withColumn(out, _udf(_invert, [False])("tag", "pts", x))


def shape_values(rows: DataFrame, at: str | Column = "at", out: str = "weights") -> DataFrame:
    """rows with the weights of the cell's vertices at a reference place, for interpolating in cells of every type."""
    return rows.withColumn(out, _udf(lambda tag, _, a: tabulate(tag, 1, a)[0], [True])("tag", "pts", at))


def interpolate_at(located: DataFrame, cells: DataFrame, values: DataFrame) -> DataFrame:
    """(query, value): vertex values interpolated at located(query, cell, x), in cells(cell, tag, vertices, pts) of any type."""
    placed = shape_values(physical_to_reference(located.join(cells, "cell")))
    w = placed.select("query", "vertices", F.posexplode("weights").alias("k", "w")).select("query", "w", F.get("vertices", F.col("k")).alias("point"))
    return w.join(values.select("point", "value"), "point").groupBy("query").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def localized(rows: DataFrame, period: list[float | None]) -> DataFrame:
    """rows with each vertex moved by whole periods to its image nearest to the first one, as a cell across a seam needs it."""

    def moved(v: Column) -> Column:
        first = F.get("pts", F.lit(0))
        axes = [(F.get(v, F.lit(k)), F.get(first, F.lit(k)), p) for k, p in enumerate(period)]
        return F.array(*[a if p is None else a - p * F.round((a - o) / p) for a, o, p in axes])

    return rows.withColumn("pts", F.transform("pts", moved))
