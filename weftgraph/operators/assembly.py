"""Closure indices, global patterns, element assembly and sparse algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topology import exclusive_sum
from .traverse import closure


def closure_index(arrows: DataFrame, cells: DataFrame, atlas: DataFrame) -> DataFrame:
    """(cell, point, place, offset, len): each cell's closure by id, with running offsets; points without a span are left out."""
    met = closure(arrows, cells.select(F.col("point").alias("cell"), "point"), keys=["cell"]).join(atlas.select("point", F.col("len").cast("long").alias("len")), "point")
    order = Window.partitionBy("cell").orderBy("point")
    return met.select("cell", "point", (F.row_number().over(order) - 1).alias("place"), F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "len")


def closure_values(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, slot, point, idx, value): a section's values in closure order."""
    return index.join(rows.select("point", "idx", "value"), "point").select("cell", (F.col("offset") + F.col("idx")).alias("slot"), "point", "idx", "value")


def permuted(values: DataFrame, perms: DataFrame) -> DataFrame:
    """values with idx moved by perms(point, perm): value i comes from place perm[i]."""
    p = perms.select("point", F.posexplode("perm").alias("to", "idx"))
    return values.join(p, ["point", "idx"], "left").withColumn("idx", F.coalesce("to", "idx")).drop("to")


def set_closure(rows: DataFrame, updates: DataFrame, add: bool = False) -> DataFrame:
    """rows(point, seq, idx, value) with updates(point, idx, value) written, or added."""
    new = updates.groupBy("point", "idx").agg((F.sum("value") if add else F.max("value")).alias("new"))
    value = F.col("value") + F.coalesce("new", F.lit(0.0)) if add else F.coalesce("new", "value")
    return rows.join(new, ["point", "idx"], "left").withColumn("value", value).drop("new")


def pattern(cell_dofs: DataFrame) -> DataFrame:
    """(row, col): all pairs of degrees of freedom that share a cell, from cell_dofs(cell, dof)."""
    return cell_dofs.select("cell", F.col("dof").alias("row")).join(cell_dofs.select("cell", F.col("dof").alias("col")), "cell").select("row", "col").distinct()


def csr(pattern_: DataFrame) -> DataFrame:
    """(row, cols, row_ptr) of a pattern."""
    rows = pattern_.groupBy("row").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    return exclusive_sum(rows.withColumn("n", F.size("cols").cast("long")), "n", ["row"], "row_ptr").drop("n")


def assemble_vector(element: DataFrame) -> DataFrame:
    return element.groupBy("dof").agg(F.sum("value").alias("value"))


def assemble_matrix(element: DataFrame) -> DataFrame:
    return element.groupBy("row", "col").agg(F.sum("value").alias("value"))


def assemble_shared(local: DataFrame, owners: DataFrame, constraints: DataFrame | None = None, reducer=F.sum) -> DataFrame:
    """(rank, point, idx, value): shared values of local(rank, point, idx, value) reduced over ranks, constrained, and
    given back to every rank that holds the point."""
    total = local.groupBy("point", "idx").agg(reducer("value").alias("value"))
    if constraints is not None:
        total = total.join(constraints.select("point", "idx", F.col("value").alias("new")), ["point", "idx"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")
    return local.select("rank", "point", "idx").join(total, ["point", "idx"]).join(owners.select("point", "owner").distinct(), "point").select("rank", "point", "idx", "value")


def spmv(matrix: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """(row, value) of alpha A x + beta y for matrix(row, col, value) and vectors (idx, value); partial sums come first."""
    ax = matrix.join(x.select(F.col("idx").alias("col"), F.col("value").alias("xv")), "col").groupBy("row").agg((F.lit(alpha) * F.sum(F.col("value") * F.col("xv"))).alias("value"))
    if y is None:
        return ax
    by = y.select(F.col("idx").alias("row"), (F.lit(beta) * F.col("value")).alias("value"))
    return ax.unionByName(by).groupBy("row").agg(F.sum("value").alias("value"))


def reductions(x: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(sum, l2_norm, max_abs) of a vector, with dot if another is given."""
    aggs = [F.sum("value").alias("sum"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2_norm"), F.max(F.abs("value")).alias("max_abs")]
    if other is not None:
        x = x.join(other.select("idx", F.col("value").alias("other")), "idx", "left")
        aggs.append(F.sum(F.col("value") * F.coalesce("other", F.lit(0.0))).alias("dot"))
    return x.agg(*aggs)


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return x.select("idx", (F.lit(a) * F.col("value")).alias("value")).unionByName(y.select("idx", "value")).groupBy("idx").agg(F.sum("value").alias("value"))
