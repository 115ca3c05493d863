"""Mesh files as tables: Gmsh 2.2 and 4.1 text, PLY, Fluent, legacy VTK, Exodus text, XDMF inline.

A file is one record: Spark reads it whole from any store and an Arrow function parses it to rows of one wide schema,
from which the tables of a mesh are selected. HDF5-based forms need a library that may be absent, see hdf5_tables().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import VERTICES
from ..operators.generate import Mesh, cell_vertices
from ..operators.topology import dense_index
from ..plans.loops import cut

WIDE = "kind string, a long, b long, slot int, tag string, param int, value int, xyz array<double>, file string"

#: Gmsh element types.
GMSH = {1: "segment", 2: "triangle", 3: "quadrilateral", 4: "tetrahedron", 5: "hexahedron", 6: "prism", 7: "pyramid", 15: "vertex", 8: "segment", 9: "triangle", 10: "quadrilateral", 11: "tetrahedron", 12: "hexahedron", 13: "prism", 14: "pyramid", 16: "quadrilateral", 17: "hexahedron", 18: "prism", 19: "pyramid", 20: "triangle", 21: "triangle", 22: "triangle", 23: "triangle"}
#: Node counts of Gmsh element types of higher order.
GMSH_NODES = {8: 3, 9: 6, 10: 9, 11: 10, 12: 27, 13: 18, 14: 14, 16: 8, 17: 20, 18: 15, 19: 13, 20: 9, 21: 10, 22: 12, 23: 15}
#: VTK cell types.
VTK = {1: "vertex", 3: "segment", 5: "triangle", 9: "quadrilateral", 10: "tetrahedron", 12: "hexahedron", 13: "prism", 14: "pyramid", 7: "polygon"}


class Rows(list):
    """Rows of the wide schema under construction."""

    def coord(self, p: int, xyz: list[float]) -> None:
        self.append(("coord", p, None, None, None, None, None, [float(x) for x in xyz]))

    def cell(self, c: int, tag: str, nodes: list[int], param: int | None = None) -> None:
        self.append(("type", c, None, None, tag, param, None, None))
        for k, n in enumerate(nodes):
            self.append(("arrow", c, n, k, None, None, None, None))

    def label(self, name: str, p: int, value: int) -> None:
        self.append(("label", p, None, None, name, None, value, None))


def polygon(n: int) -> tuple[str, int | None]:
    return {2: ("segment", None), 3: ("triangle", None), 4: ("quadrilateral", None)}.get(n, ("polygon", n))


def _lines(text: str) -> list[str]:
    return [x for x in (line.split("#")[0].strip() for line in text.splitlines()) if x]


def gmsh(text: str) -> Rows:
    """Versions 2.x and 4.x in text form. Node and element ids are apart in the file; elements that share an id with a node are moved past the nodes."""
    out, blocks = Rows(), {}
    for m in re.finditer(r"\$(\w+)\s*\n(.*?)\$End\1", text, re.S):
        blocks[m[1]] = m[2].split("\n")
    version = float(blocks["MeshFormat"][0].split()[0])
    if blocks["MeshFormat"][0].split()[1] != "0":
        raise ValueError("binary Gmsh files aren't read")
    nodes: dict[int, list[float]] = {}
    elements = []
    if version < 4:
        for line in blocks["Nodes"][1 : int(blocks["Nodes"][0]) + 1]:
            w = line.split()
            nodes[int(w[0])] = [float(x) for x in w[1:4]]
        for line in blocks["Elements"][1 : int(blocks["Elements"][0]) + 1]:
            w = [int(x) for x in line.split()]
            elements.append((w[0], w[1], w[3 : 3 + w[2]], w[3 + w[2] :], None))
    else:
        rows = iter(blocks["Nodes"])
        for _ in range(int(next(rows).split()[0])):
            count = int(next(rows).split()[3])
            tags = [int(next(rows)) for _ in range(count)]
            for t in tags:
                nodes[t] = [float(x) for x in next(rows).split()[:3]]
        rows = iter(blocks["Elements"])
        for _ in range(int(next(rows).split()[0])):
            _, entity, kind, count = (int(x) for x in next(rows).split())
            for _ in range(count):
                w = [int(x) for x in next(rows).split()]
                elements.append((w[0], kind, [], w[1:], entity))
    for p, xyz in nodes.items():
        out.coord(p, xyz)
        out.append(("type", p, None, None, "vertex", None, None, None))
    shift = max(nodes, default=0) if any(e[0] in nodes for e in elements) else 0
    for e, kind, tags, ids, entity in elements:
        if kind not in GMSH:
            raise ValueError(f"unknown Gmsh element type {kind}")
        tag = GMSH[kind]
        if kind in GMSH_NODES and len(ids) != GMSH_NODES[kind]:
            raise ValueError("wrong number of nodes")
        if tag == "vertex":
            continue
        # nodes of higher order follow the vertices
        out.cell(e + shift, tag, ids[: VERTICES[tag]])
        for name, v in zip(("gmsh:physical", "gmsh:entity"), tags, strict=False):
            out.label(name, e + shift, v)
        for k, v in enumerate(tags[2:]):
            out.label(f"gmsh:tag{k + 2}", e + shift, v)
        if entity is not None:
            out.label("gmsh:entity", e + shift, entity)
    return out


def ply(text: str) -> Rows:
    """Text PLY: vertices 1.. in order, faces after them."""
    out, lines = Rows(), [x for x in text.splitlines() if x.strip()]
    if lines[0].strip() != "ply" or not any(x.startswith("format ascii") for x in lines):
        raise ValueError("not a text PLY file")
    end = lines.index("end_header")
    counts, props, now = {}, {}, ""
    for w in (x.split() for x in lines[1:end]):
        if w[0] == "element":
            now = w[1]
            counts[now], props[now] = int(w[2]), []
        elif w[0] == "property":
            props[now].append(w[-1])
    at, n = end + 1, counts["vertex"]
    place = [props["vertex"].index(c) for c in "xyz" if c in props["vertex"]]
    for k in range(n):
        w = lines[at + k].split()
        out.coord(k + 1, [float(w[p]) for p in place])
        out.append(("type", k + 1, None, None, "vertex", None, None, None))
    for k in range(counts.get("face", 0)):
        w = [int(x) for x in lines[at + n + k].split()]
        tag, param = polygon(w[0])
        out.cell(n + 1 + k, tag, [i + 1 for i in w[1 : 1 + w[0]]], param)
    return out


def fluent(text: str) -> Rows:
    """The compact dialect (vertices, v, cells, cell, label), or the s-expression subset of sections 10 and 12."""
    out = Rows()
    points: list[list[float]] = []
    cells: list[list[int]] = []
    labels: list[tuple[str, int, list[int]]] = []
    lines = _lines(text)
    if any(x.startswith("(") for x in lines):
        number = lambda w: float(int(w, 16)) if re.fullmatch(r"0x[0-9a-fA-F]+", w) else float(w)
        for m in re.finditer(r"\((10|12) \(([^()]*)\)\s*\((.*?)\)\s*\)", "\n".join(lines), re.S):
            if m[2].split()[0] == "0":
                continue
            for row in (x.split() for x in m[3].strip().splitlines() if x.strip()):
                if m[1] == "10":
                    points.append([number(w) for w in row] + [0.0] * (3 - len(row)))
                else:
                    cells.append([int(w, 16) for w in row])
    else:
        for w in (x.split() for x in lines):
            if w[0] == "v":
                points.append([float(x) for x in w[1:]])
            elif w[0] == "cell":
                cells.append([int(x) for x in w[1:]])
            elif w[0] == "label":
                labels.append((w[1], int(w[2]), [int(x) for x in w[3:]]))
    for k, p in enumerate(points):
        out.coord(k + 1, p)
        out.append(("type", k + 1, None, None, "vertex", None, None, None))
    for k, c in enumerate(cells):
        tag, param = polygon(len(c))
        out.cell(len(points) + 1 + k, tag, c, param)
    for name, value, at in labels:
        for p in at:
            out.label(name, p, value)
    return out


def exodus(text: str) -> Rows:
    """The text dialect: DIM, NODES, ELEMENTS, LABELS, END."""
    out, lines, k, dim = Rows(), _lines(text), 0, 3
    if lines[0] != "EXODUS":
        raise ValueError("not an Exodus text file")
    rows: dict[str, list[list[str]]] = {}
    while k < len(lines):
        w = lines[k].split()
        k += 1
        if w[0] == "DIM":
            dim = int(w[1])
        elif w[0] in ("NODES", "ELEMENTS", "LABELS"):
            rows[w[0]] = [x.split() for x in lines[k : k + int(w[1])]]
            k += int(w[1])
    for w in rows.get("NODES", []):
        out.coord(int(w[0]), [float(x) for x in w[1 : 1 + dim]])
        out.append(("type", int(w[0]), None, None, "vertex", None, None, None))
    for w in rows.get("ELEMENTS", []):
        out.cell(int(w[0]), w[1].lower(), [int(x) for x in w[3 : 3 + int(w[2])]])
    for w in rows.get("LABELS", []):
        out.label(w[1], int(w[0]), int(w[2]))
    return out


def vtk(text: str) -> Rows:
    """Legacy text VTK, unstructured grids, with label fields named `label:NAME:ids` and `label:NAME:values` of this package's writer."""
    out, w, k = Rows(), text.split("\n", 2)[2].split(), 0
    points: list[list[float]] = []
    cells: list[list[int]] = []
    kinds: list[int] = []
    fields: dict[str, list[str]] = {}
    while k < len(w):
        if w[k] == "POINTS":
            n = int(w[k + 1])
            flat = [float(x) for x in w[k + 3 : k + 3 + 3 * n]]
            points = [flat[3 * i : 3 * i + 3] for i in range(n)]
            k += 3 + 3 * n
        elif w[k] == "CELLS":
            n, k = int(w[k + 1]), k + 3
            for _ in range(n):
                m = int(w[k])
                cells.append([int(x) for x in w[k + 1 : k + 1 + m]])
                k += m + 1
        elif w[k] == "CELL_TYPES":
            n = int(w[k + 1])
            kinds = [int(x) for x in w[k + 2 : k + 2 + n]]
            k += 2 + n
        elif w[k] == "FIELD":
            n, k = int(w[k + 2]), k + 3
            for _ in range(n):
                size = int(w[k + 1]) * int(w[k + 2])
                fields[w[k]] = w[k + 4 : k + 4 + size]
                k += 4 + size
        else:
            k += 1
    ids = [int(x) for x in fields.get("point_ids", range(1, len(points) + 1))]
    cell_ids = [int(x) for x in fields.get("cell_ids", range(len(points) + 1, len(points) + len(cells) + 1))]
    for p, xyz in zip(ids, points, strict=True):
        out.coord(p, xyz)
        out.append(("type", p, None, None, "vertex", None, None, None))
    for c, kind, nodes in zip(cell_ids, kinds, cells, strict=True):
        tag = VTK[kind]
        out.cell(c, tag, [ids[i] for i in nodes], len(nodes) if tag == "polygon" else None)
    for name in fields:
        if name.startswith("label:") and name.endswith(":ids"):
            for p, v in zip(fields[name], fields[name[:-4] + ":values"], strict=True):
                out.label(name[6:-4], int(p), int(v))
    return out


def xdmf(text: str) -> Rows:
    """XDMF with inline data items, one topology type."""
    import xml.etree.ElementTree as ET

    out, grid = Rows(), ET.fromstring(text).find(".//Grid")
    items = {}
    for part in ("Geometry", "Topology"):
        item = grid.find(f"{part}/DataItem")
        if item.get("Format", "XML") != "XML":
            raise ValueError("only inline data items are read")
        items[part] = (item.text.split(), [int(x) for x in item.get("Dimensions").split()])
    flat, (n, d) = items["Geometry"]
    for k in range(n):
        out.coord(k + 1, [float(x) for x in flat[d * k : d * k + d]])
        out.append(("type", k + 1, None, None, "vertex", None, None, None))
    tag = {"polyline": "segment", "wedge": "prism"}.get(kind := grid.find("Topology").get("TopologyType").lower(), kind)
    flat, (m, d) = items["Topology"]
    for k in range(m):
        out.cell(n + 1 + k, tag, [int(x) + 1 for x in flat[d * k : d * k + d]])
    return out


PARSERS: dict[str, Callable[[str], Rows]] = {"gmsh": gmsh, "ply": ply, "fluent": fluent, "exodus": exodus, "vtk": vtk, "xdmf": xdmf}


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of the wide schema for every file that the path names."""
    parse = PARSERS[kind]
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for text, name in zip(pdf["value"], pdf["file"], strict=True):
                out = pd.DataFrame([(*r, name) for r in parse(text)], columns=[c.split()[0] for c in WIDE.split(", ")])
                for c in ("a", "b", "slot", "param", "value"):
                    out[c] = out[c].astype("Int64")
                yield out

    return files.mapInPandas(run, WIDE)


def read_mesh(spark: SparkSession, path: str, kind: str) -> Mesh:
    rows = cut(read_rows(spark, path, kind))
    arrows = rows.where("kind = 'arrow'").select(F.col("a").alias("src"), F.col("b").alias("dst"), "slot", F.lit(0).alias("orient"))
    types = rows.where("kind = 'type'").select(F.col("a").alias("point"), "tag", "param")
    coords = rows.where("kind = 'coord'").select(F.col("a").alias("point"), "xyz")
    return Mesh(arrows, types, coords, rows.where("kind = 'label'").select(F.col("tag").alias("name"), F.col("a").alias("point"), "value"))


def _numbers(xyz) -> F.Column:
    return F.array_join(F.transform(F.concat(xyz, F.array_repeat(F.lit(0.0), 3 - F.size(xyz))), lambda x: x.cast("string")), " ")


def gmsh_lines(mesh: Mesh) -> DataFrame:
    """(part, n, line): a Gmsh 2.2 file in order of part and n."""
    spark = mesh.arrows.sparkSession
    kinds = F.create_map(*[F.lit(x) for k, t in GMSH.items() if k < 8 or k == 15 for x in (t, k)])
    cells = cell_vertices(mesh)
    if mesh.labels is not None:
        tags = mesh.labels.where("name in ('gmsh:physical', 'gmsh:entity')").groupBy("point").pivot("name", ["gmsh:physical", "gmsh:entity"]).agg(F.max("value"))
        cells = cells.join(tags.withColumnRenamed("point", "cell"), "cell", "left")
    else:
        cells = cells.withColumn("gmsh:physical", F.lit(0)).withColumn("gmsh:entity", F.lit(0))
    body = F.concat_ws(" ", F.col("cell").cast("string"), kinds[F.col("tag")].cast("string"), F.lit("2"), F.coalesce(F.col("gmsh:physical"), F.lit(0)).cast("string"), F.coalesce(F.col("gmsh:entity"), F.lit(0)).cast("string"), F.array_join(F.transform("vertices", lambda v: v.cast("string")), " "))
    nodes = mesh.coords.select(F.lit(2).alias("part"), F.col("point").alias("n"), F.concat_ws(" ", F.col("point").cast("string"), _numbers(F.col("xyz"))).alias("line"))
    elements = cells.select(F.lit(4).alias("part"), F.col("cell").alias("n"), body.alias("line"))
    head = spark.createDataFrame([(0, 0, "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes"), (3, 0, "$EndNodes\n$Elements"), (5, 0, "$EndElements")], "part int, n long, line string")
    count = mesh.coords.agg(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.count("*").cast("string").alias("line")).unionByName(cells.agg(F.lit(3).alias("part"), F.lit(1).cast("long").alias("n"), F.count("*").cast("string").alias("line")))
    return head.unionByName(count).unionByName(nodes).unionByName(elements)


def vtk_lines(mesh: Mesh) -> DataFrame:
    """(part, n, line): a legacy VTK file with ids and labels as fields."""
    from ..operators.topology import dense_index

    spark = mesh.arrows.sparkSession
    kinds = F.create_map(*[F.lit(x) for k, t in VTK.items() for x in (t, k)])
    points = cut(dense_index(mesh.coords, ["point"], "i"))
    cells = cell_vertices(mesh)
    flat = cells.select("cell", "tag", F.posexplode("vertices").alias("k", "point")).join(points.select("point", "i"), "point").groupBy("cell", "tag").agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("x"))
    flat = cut(flat.select("cell", "tag", F.col("x.i").alias("places")))
    n, m = points.count(), flat.count()
    size = flat.agg(F.sum(F.size("places") + 1)).first()[0] or 0
    row = lambda df, part, order, line: df.select(F.lit(part).alias("part"), F.col(order).cast("long").alias("n"), line.alias("line"))
    names = [r["name"] for r in mesh.labels.select("name").distinct().collect()] if mesh.labels is not None else []
    parts = [
        row(points, 2, "point", _numbers(F.col("xyz"))), row(flat, 4, "cell", F.concat_ws(" ", F.size("places").cast("string"), F.array_join(F.transform("places", lambda x: x.cast("string")), " "))),
        row(flat, 6, "cell", kinds[F.col("tag")].cast("string")), row(points, 8, "point", F.col("point").cast("string")), row(flat, 10, "cell", F.col("cell").cast("string")),
    ]
    heads = [(0, "# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID"), (1, f"POINTS {n} double"), (3, f"CELLS {m} {size}"), (5, f"CELL_TYPES {m}"), (7, f"FIELD FieldData {2 + 2 * len(names)}\npoint_ids 1 {n} long"), (9, f"cell_ids 1 {m} long")]
    for k, name in enumerate(sorted(names)):
        own = mesh.labels.where(F.col("name") == name)
        c = own.count()
        heads += [(11 + 4 * k, f"label:{name}:ids 1 {c} long"), (13 + 4 * k, f"label:{name}:values 1 {c} int")]
        parts += [row(own, 12 + 4 * k, "point", F.col("point").cast("string")), row(own, 14 + 4 * k, "point", F.col("value").cast("string"))]
    out = spark.createDataFrame([(p, 0, x) for p, x in heads], "part int, n long, line string")
    for p in parts:
        out = out.unionByName(p)
    return out


def exodus_lines(mesh: Mesh, dim: int = 3) -> DataFrame:
    spark = mesh.arrows.sparkSession
    cells = cell_vertices(mesh)
    nodes = mesh.coords.select(F.lit(2).alias("part"), F.col("point").alias("n"), F.concat_ws(" ", F.col("point").cast("string"), F.array_join(F.transform("xyz", lambda x: x.cast("string")), " ")).alias("line"))
    elements = cells.select(F.lit(4).alias("part"), F.col("cell").alias("n"), F.concat_ws(" ", F.col("cell").cast("string"), F.initcap("tag"), F.size("vertices").cast("string"), F.array_join(F.transform("vertices", lambda x: x.cast("string")), " ")).alias("line"))
    labels = mesh.labels.select(F.lit(6).alias("part"), F.col("point").alias("n"), F.concat_ws(" ", F.col("point").cast("string"), "name", F.col("value").cast("string")).alias("line")) if mesh.labels is not None else None
    count = lambda df: df.count() if df is not None else 0
    out = spark.createDataFrame([(0, 0, f"EXODUS\nDIM {dim}"), (1, 0, f"NODES {count(nodes)}"), (3, 0, f"ELEMENTS {count(elements)}"), (5, 0, f"LABELS {count(labels)}"), (7, 0, "END")], "part int, n long, line string")
    out = out.unionByName(nodes).unionByName(elements)
    return out.unionByName(labels) if labels is not None else out


def xdmf_lines(mesh: Mesh) -> DataFrame:
    """(part, n, line): XDMF with inline items, for cells of one type; places follow the points' order."""
    spark = mesh.arrows.sparkSession
    cells = cut(cell_vertices(mesh))
    tags = [r["tag"] for r in cells.select("tag").distinct().limit(2).collect()]
    if len(tags) > 1:
        raise ValueError("an inline XDMF topology has one type")
    tag = tags[0] if tags else "triangle"
    kind = {"segment": "Polyline", "prism": "Wedge"}.get(tag, tag.capitalize())
    at = cut(dense_index(mesh.coords.select("point", "xyz"), ["point"], "i"))
    n, m, d = at.count(), cells.count(), VERTICES[tag]
    corners = cells.select("cell", F.posexplode("vertices").alias("slot", "point")).join(at.select("point", "i"), "point").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("slot", "i"))).alias("x"))
    head = f'<Xdmf Version="3.0">\n<Domain>\n<Grid Name="mesh" GridType="Uniform">\n<Geometry GeometryType="XYZ">\n<DataItem Format="XML" Dimensions="{n} 3">'
    middle = f'</DataItem>\n</Geometry>\n<Topology TopologyType="{kind}" NumberOfElements="{m}" NodesPerElement="{d}">\n<DataItem Format="XML" Dimensions="{m} {d}">'
    fixed = spark.createDataFrame([(0, 0, head), (2, 0, middle), (4, 0, "</DataItem>\n</Topology>\n</Grid>\n</Domain>\n</Xdmf>")], "part int, n long, line string")
    places = at.select(F.lit(1).alias("part"), F.col("i").alias("n"), _numbers(F.col("xyz")).alias("line"))
    rows = corners.select(F.lit(3).alias("part"), F.col("cell").alias("n"), F.array_join(F.transform("x.i", lambda i: i.cast("string")), " ").alias("line"))
    return fixed.unionByName(places).unionByName(rows)


WRITERS = {"gmsh": gmsh_lines, "vtk": vtk_lines, "exodus": exodus_lines, "xdmf": xdmf_lines}


def write_mesh(mesh: Mesh, path: str, kind: str, one_file: bool = True, **options) -> None:
    """Text files in order; one file by default, else range-sorted parts that give the file when joined by name."""
    lines = WRITERS[kind](mesh, **options)
    ordered = lines.coalesce(1).sortWithinPartitions("part", "n") if one_file else lines.repartitionByRange("part", "n").sortWithinPartitions("part", "n")
    ordered.select("line").write.text(path)


def hdf5_tables(path: str, groups: list[str]):
    """Datasets of an HDF5 file as numpy arrays, where h5py is installed; compact, CGNS and Exodus II layouts start here."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("HDF5 files need h5py") from e
    with h5py.File(path) as f:
        return {g: f[g][()] for g in groups}
