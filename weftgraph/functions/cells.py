"""Cell types: dimension, vertices and templates, as Columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension of each cell type; polygon, simplex and polyhedron carry a parameter.
DIMENSION = {"vertex": 0, "segment": 1, "triangle": 2, "quadrilateral": 2, "tetrahedron": 3, "hexahedron": 3, "prism": 3, "pyramid": 3, "polygon": 2, "polyhedron": 3}
VERTICES = {"vertex": 1, "segment": 2, "triangle": 3, "quadrilateral": 4, "tetrahedron": 4, "hexahedron": 8, "prism": 6, "pyramid": 5}
#: Edges and faces of each type by places of its vertices.
EDGES = {
    "segment": [(0, 1)],
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "quadrilateral": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "tetrahedron": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    "hexahedron": [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
    "prism": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    "pyramid": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
}
FACES = {
    "triangle": [(0, 1, 2)],
    "quadrilateral": [(0, 1, 2, 3)],
    "tetrahedron": [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)],
    "hexahedron": [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
    "prism": [(0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    "pyramid": [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}


def dimension(tag: Column, param: Column | None = None) -> Column:
    out = F.when(tag == "simplex", param) if param is not None else F.when(F.lit(False), F.lit(0))
    for name, dim in DIMENSION.items():
        out = out.when(tag == name, F.lit(dim))
    return out.cast("int")


def choose(tag: Column, table: dict, form) -> Column:
    """Expression by cell type: form(name, entry) for each entry of the table; null for other types."""
    out = None
    for name, entry in table.items():
        value = form(name, entry)
        out = F.when(tag == name, value) if out is None else out.when(tag == name, value)
    return out
