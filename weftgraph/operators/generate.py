"""Structured meshes, extrusion, interpolation of edges and faces, template refinement, coordinate transforms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import EDGES, FACES, VERTICES
from .topology import dense_index


@dataclass
class Mesh:
    """A set of tables: arrows(src, dst, slot, orient), cell_types(point, tag, param), coords(point, xyz), labels, periodic, sections by name."""

    arrows: DataFrame
    cell_types: DataFrame
    coords: DataFrame
    labels: DataFrame | None = None
    periodic: DataFrame | None = None
    sections: dict[str, DataFrame] = field(default_factory=dict)


def _box(spark: SparkSession, shape: list[int], low: list[float], high: list[float], corners: list[tuple], tag: str, periodic: list[bool]) -> Mesh:
    """Vertices of an n-d grid get ids 1.. in row-major order, cells follow; corners are offsets of a cell's vertices."""
    dim = len(shape)
    size = [n + 1 for n in shape]
    total, cells = 1, 1
    for s, n in zip(size, shape, strict=True):
        total, cells = total * s, cells * n

    def places(ids, extent):
        out, rest = [], ids
        for s in reversed(extent):
            out.append(F.pmod(rest, F.lit(s)))
            rest = F.floor(rest / s).cast("long")
        return out[::-1]

    def joined(at, extent):
        got = F.lit(0).cast("long")
        for x, s in zip(at, extent, strict=True):
            got = got * s + x
        return got

    v = spark.range(total)
    at = places(F.col("id"), size)
    xyz = F.array(*[F.lit(a) + (F.lit(b) - F.lit(a)) * x / n for a, b, x, n in zip(low, high, at, shape, strict=True)])
    coords = v.select((F.col("id") + 1).alias("point"), xyz.cast("array<double>").alias("xyz"))
    c = spark.range(cells)
    base = places(F.col("id"), shape)
    corner = [joined([x + d for x, d in zip(base, off, strict=True)], size) + 1 for off in corners]
    arrows = c.select((F.col("id") + total + 1).alias("src"), F.posexplode(F.array(*corner)).alias("slot", "dst")).select("src", "dst", "slot", F.lit(0).alias("orient"))
    types = coords.select("point", F.lit("vertex").alias("tag"), F.lit(None).cast("int").alias("param")).unionByName(c.select((F.col("id") + total + 1).alias("point"), F.lit(tag).alias("tag"), F.lit(None).cast("int").alias("param")))
    labels, pairs = [], []
    for k, axis in enumerate("xyz"[:dim]):
        for name, value in ((f"{axis}_min", 0), (f"{axis}_max", shape[k])):
            labels.append(v.where(at[k] == value).select(F.lit(name).alias("name"), (F.col("id") + 1).alias("point"), F.lit(1).alias("value")))
        if periodic[k]:
            first = [F.lit(0).cast("long") if j == k else x for j, x in enumerate(at)]
            pairs.append(v.where(at[k] == shape[k]).select((F.col("id") + 1).alias("slave"), (joined(first, size) + 1).alias("master")))
    every = labels[0]
    for x in labels[1:]:
        every = every.unionByName(x)
    same = None
    for x in pairs:
        same = x if same is None else same.unionByName(x)
    return Mesh(arrows, types, coords, every, same)


def interval_mesh(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, periodic: bool = False) -> Mesh:
    return _box(spark, [n], [low], [high], [(0,), (1,)], "segment", [periodic])


def quad_mesh(spark: SparkSession, nx: int, ny: int, low=(0.0, 0.0), high=(1.0, 1.0), periodic=(False, False)) -> Mesh:
    return _box(spark, [nx, ny], list(low), list(high), [(0, 0), (1, 0), (1, 1), (0, 1)], "quadrilateral", list(periodic))


def hex_mesh(spark: SparkSession, nx: int, ny: int, nz: int, low=(0.0,) * 3, high=(1.0,) * 3, periodic=(False,) * 3) -> Mesh:
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return _box(spark, [nx, ny, nz], list(low), list(high), [(*c, z) for z in (0, 1) for c in ring], "hexahedron", list(periodic))


def triangulated(mesh: Mesh) -> Mesh:
    """Each quadrilateral as the triangles (0, 1, 2) and (0, 2, 3); the first keeps the cell's id, the second doubles past the greatest."""
    spark = mesh.arrows.sparkSession
    top = mesh.cell_types.agg(F.max("point")).first()[0] or 0
    half = spark.createDataFrame([(h, s, k) for h, t in enumerate([(0, 1, 2), (0, 2, 3)]) for k, s in enumerate(t)], "half int, slot int, new int")
    quads = mesh.cell_types.where("tag = 'quadrilateral'").select(F.col("point").alias("src"))
    arrows = mesh.arrows.join(quads, "src", "left_semi").join(F.broadcast(half), "slot").select((F.col("src") + F.col("half") * top).alias("src"), "dst", F.col("new").alias("slot"), "orient")
    kept = mesh.arrows.join(quads, "src", "left_anti").select("src", "dst", "slot", "orient")
    twice = mesh.cell_types.where("tag = 'quadrilateral'").select(F.explode(F.array("point", F.col("point") + top)).alias("point"), F.lit("triangle").alias("tag"), "param")
    return Mesh(kept.unionByName(arrows), mesh.cell_types.where("tag <> 'quadrilateral'").select("point", "tag", "param").unionByName(twice), mesh.coords, mesh.labels, mesh.periodic)


def cell_vertices(mesh: Mesh) -> DataFrame:
    """(cell, tag, vertices): ordered vertex ids of each typed cell above a vertex."""
    typed = mesh.cell_types.where("tag <> 'vertex'").select(F.col("point").alias("src"), "tag")
    got = mesh.arrows.join(typed, "src").groupBy("src", "tag").agg(F.array_sort(F.collect_list(F.struct("slot", "dst"))).alias("x"))
    return got.select(F.col("src").alias("cell"), "tag", F.col("x.dst").alias("vertices"))


def cell_coordinates(mesh: Mesh) -> DataFrame:
    """(cell, tag, pts): ordered vertex coordinates."""
    typed = mesh.cell_types.where("tag <> 'vertex'").select(F.col("point").alias("src"), "tag")
    got = mesh.arrows.join(typed, "src").join(mesh.coords.withColumnRenamed("point", "dst"), "dst").groupBy("src", "tag").agg(F.array_sort(F.collect_list(F.struct("slot", "xyz"))).alias("x"))
    return got.select(F.col("src").alias("cell"), "tag", F.col("x.xyz").alias("pts"))


def _parts(cells: DataFrame, table: dict) -> DataFrame:
    """(cell, slot, nodes): the sub-entities of each cell by its type's template."""
    spark = cells.sparkSession
    rows = [(tag, k, list(t)) for tag, ts in table.items() for k, t in enumerate(ts)]
    template = spark.createDataFrame(rows, "tag string, slot int, places array<int>")
    return cells.join(F.broadcast(template), "tag").select("cell", "slot", F.transform("places", lambda i: F.get("vertices", i)).alias("nodes"))


def interpolate(mesh: Mesh, what: str = "edges") -> tuple[DataFrame, DataFrame]:
    """Unique edges or faces from cell-vertex arrows: entities(point, nodes) and arrows(src, dst, slot, orient).

    Ids follow the greatest point in order of the sorted nodes; an entity's node order is that of its first cell, and a
    cell that meets it in another order has orientation -1.
    """
    top = mesh.cell_types.agg(F.max("point")).first()[0] or 0
    parts = _parts(cell_vertices(mesh), EDGES if what == "edges" else FACES).withColumn("key", F.array_sort("nodes"))
    first = parts.groupBy("key").agg(F.min(F.struct("cell", "slot", "nodes"))["nodes"].alias("nodes"))
    entities = dense_index(first, ["key"], "i").select((F.col("i") + top + 1).alias("point"), "key", "nodes")
    arrows = parts.select("cell", "slot", "key", F.col("nodes").alias("met")).join(entities, "key").select(F.col("cell").alias("src"), F.col("point").alias("dst"), "slot", F.when(F.col("met") == F.col("nodes"), 0).otherwise(-1).alias("orient"))
    return entities.select("point", "nodes"), arrows


def _between(tag: str, a: int, b: int) -> tuple[str, int]:
    """The template's name for the midpoint of two corners of a quadrilateral or hexahedron."""
    if a == b:
        return "v", a
    for k, e in enumerate(EDGES[tag]):
        if {a, b} == set(e):
            return "e", k
    for k, f in enumerate(FACES[tag]):
        if tag == "hexahedron" and {a, b} <= set(f):
            return "f", k
    return "m", 0


#: Children of a cell that has one at each corner: slot j of child k is the midpoint of corners k and j.
_CORNERED = {tag: [[_between(tag, k, j) for j in range(VERTICES[tag])] for k in range(VERTICES[tag])] for tag in ("quadrilateral", "hexahedron")}
#: Children of a triangle; a node is a vertex v or an edge's midpoint e.
_TRIANGLE = [[("v", 0), ("e", 0), ("e", 2)], [("v", 1), ("e", 1), ("e", 0)], [("v", 2), ("e", 2), ("e", 1)], [("e", 0), ("e", 1), ("e", 2)]]
#: Children of a tetrahedron; the inner four share the diagonal of edges 0 and 5, in the order of positive volume.
_TETRAHEDRON = [
    [("v", 0), ("e", 0), ("e", 2), ("e", 3)], [("v", 1), ("e", 1), ("e", 0), ("e", 4)], [("v", 2), ("e", 2), ("e", 1), ("e", 5)], [("v", 3), ("e", 3), ("e", 5), ("e", 4)],
    [("e", 0), ("e", 1), ("e", 5), ("e", 4)], [("e", 0), ("e", 4), ("e", 5), ("e", 3)], [("e", 0), ("e", 3), ("e", 5), ("e", 2)], [("e", 0), ("e", 2), ("e", 5), ("e", 1)],
]
#: Children by type: a node is a vertex v, an edge's midpoint e, a face's centre f or the cell's own m. A prism is split
#: as its triangles are, a pyramid as its base is, with the apex kept.
SUBDIVISION = {
    "segment": [[("v", 0), ("e", 0)], [("e", 0), ("v", 1)]],
    "triangle": _TRIANGLE,
    "quadrilateral": _CORNERED["quadrilateral"],
    "tetrahedron": _TETRAHEDRON,
    "hexahedron": _CORNERED["hexahedron"],
    "prism": [[*t, *((kind, k + 3) for kind, k in t)] for t in _TRIANGLE],
    "pyramid": [[*(("f", 0) if kind == "m" else (kind, k) for kind, k in q), ("v", 4)] for q in _CORNERED["quadrilateral"]],
}


def refine(mesh: Mesh, only: DataFrame | None = None) -> tuple[Mesh, DataFrame]:
    """Template subdivision of every cell, or of those in only(point), with shared midpoints made once.

    Returns the mesh and map(coarse, fine). Vertices keep their ids; midpoints, centres and children follow the greatest.
    Where cells are left whole, sections["hanging"] has terms(point, idx, src_point, src_idx, weight) of the midpoints
    that lie on their edges and faces; a later refinement of those cells takes the same points. A type without a
    template is an error.
    """
    from ..plans.loops import cut

    spark = mesh.arrows.sparkSession
    top = mesh.cell_types.agg(F.max("point")).first()[0] or 0
    every = cell_vertices(mesh)
    whole = None
    if only is not None:
        chosen = only.select(F.col("point").alias("cell")).distinct()
        whole = cut(every.join(chosen, "cell", "left_anti"))
        every = every.join(chosen, "cell", "left_semi")
    cells = cut(every)
    other = [r["tag"] for r in cells.where(~F.col("tag").isin(list(SUBDIVISION))).select("tag").distinct().collect()]
    if other:
        raise ValueError(f"no refinement of {sorted(other)}")
    known = mesh.sections.get("hanging")

    def parts(of: DataFrame) -> DataFrame:
        """(cell, k, kind, key): the edges, and the faces of solids, by their sorted nodes."""
        solid = {tag: FACES[tag] for tag in ("tetrahedron", "hexahedron", "prism", "pyramid")}
        both = [_parts(of, table).select("cell", F.col("slot").alias("k"), F.lit(kind).alias("kind"), F.array_sort("nodes").alias("key")) for kind, table in (("e", EDGES), ("f", solid))]
        return both[0].unionByName(both[1])

    rows = [(tag, child, slot, kind, k) for tag, kids in SUBDIVISION.items() for child, nodes in enumerate(kids) for slot, (kind, k) in enumerate(nodes)]
    template = F.broadcast(spark.createDataFrame(rows, "tag string, child int, slot int, kind string, k int"))
    used = template.select("tag", "kind", "k").distinct()
    met = parts(cells.join(F.broadcast(spark.createDataFrame([(t,) for t in SUBDIVISION], "tag string")), "tag", "left_semi"))
    met = met.join(cells.select("cell", "tag"), "cell").join(F.broadcast(used), ["tag", "kind", "k"], "left_semi").select("cell", "k", "kind", "key")
    inner = cells.join(F.broadcast(used.where("kind = 'm'").select("tag")), "tag", "left_semi").select("cell", F.lit(0).alias("k"), F.lit("m").alias("kind"), F.array("cell").alias("key"))
    met = cut(met.unionByName(inner))
    need = met.select("kind", "key").distinct()
    if known is not None:
        old = cut(known.groupBy("point").agg(F.array_sort(F.collect_list("src_point")).alias("key")).select(F.when(F.size("key") == 2, "e").otherwise("f").alias("kind"), "key", F.col("point").alias("id")))
        need = need.join(old.select("kind", "key"), ["kind", "key"], "left_anti")
    made = cut(dense_index(need, ["kind", "key"], "i").select("kind", "key", (F.col("i") + top + 1).alias("id")))
    base = top + made.count()
    mids = made if known is None else made.unionByName(old)
    corner = cells.select("cell", F.posexplode("vertices").alias("k", "node")).select("cell", "k", F.lit("v").alias("kind"), "node")
    nodes = corner.unionByName(met.join(mids, ["kind", "key"]).select("cell", "k", "kind", F.col("id").alias("node")))
    wide = cells.select("cell", "tag").join(template, "tag").join(nodes, ["cell", "kind", "k"])
    number = cut(dense_index(cells.select("cell", "tag").join(F.broadcast(template.select("tag", "child").distinct()), "tag"), ["cell", "child"], "i").select("cell", "child", "tag", (F.col("i") + base + 1).alias("fine")))
    arrows = wide.drop("tag").join(number, ["cell", "child"]).select(F.col("fine").alias("src"), F.col("node").alias("dst"), "slot", F.lit(0).alias("orient"))
    ends = made.where("kind <> 'm'").select("id", F.explode("key").alias("n")).unionByName(made.where("kind = 'm'").select("id", F.get("key", F.lit(0)).alias("cell")).join(cells, "cell").select("id", F.explode("vertices").alias("n")))
    xyz = mesh.coords.select(F.col("point").alias("n"), "xyz")
    means = ends.join(xyz, "n").select("id", F.posexplode("xyz").alias("axis", "v")).groupBy("id", "axis").agg(F.avg("v").alias("v")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("axis", "v"))).alias("x"))
    coords = mesh.coords.select("point", "xyz").unionByName(means.select(F.col("id").alias("point"), F.col("x.v").alias("xyz")))
    none = F.lit(None).cast("int").alias("param")
    types = mesh.cell_types.where("tag = 'vertex'").select("point", "tag", "param").unionByName(made.select(F.col("id").alias("point"), F.lit("vertex").alias("tag"), none)).unionByName(number.select(F.col("fine").alias("point"), "tag", none))
    sections = {}
    if whole is not None:
        kept = whole.select(F.col("cell").alias("point"))
        arrows = mesh.arrows.join(kept.withColumnRenamed("point", "src"), "src", "left_semi").select("src", "dst", "slot", "orient").unionByName(arrows)
        types = mesh.cell_types.where("tag <> 'vertex'").join(kept, "point", "left_semi").select("point", "tag", "param").unionByName(types)
        at = parts(whole).select("kind", "key").distinct().join(mids, ["kind", "key"]).where("kind <> 'm'")
        sections["hanging"] = cut(at.select(F.col("id").alias("point"), F.lit(0).alias("idx"), F.explode("key").alias("src_point"), F.lit(0).alias("src_idx"), (1 / F.size("key")).alias("weight")))
    return Mesh(arrows, types, coords, mesh.labels, sections=sections), number.select(F.col("cell").alias("coarse"), "fine")


def full_topology(mesh: Mesh) -> Mesh:
    """Cells over faces over edges over vertices, from cell-vertex arrows; new faces and edges get types.

    In the plane cells stand on edges. The arrows' orientations compare an entity's node order with its first cell's.
    """
    flat = "tag in ('triangle', 'quadrilateral')"
    edges, cell_edges = interpolate(mesh, "edges")
    none, whole = F.lit(None).cast("int").alias("param"), mesh.cell_types.select(F.col("point").alias("src"), "tag")
    ends = edges.select(F.col("point").alias("src"), F.posexplode("nodes").alias("slot", "dst")).select("src", "dst", "slot", F.lit(0).alias("orient"))
    out = ends.unionByName(cell_edges.join(whole.where(flat), "src", "left_semi"))
    types = mesh.cell_types.select("point", "tag", "param").unionByName(edges.select("point", F.lit("segment").alias("tag"), none))
    solid = Mesh(mesh.arrows.join(whole.where(f"not {flat}"), "src", "left_semi"), types, mesh.coords)
    faces, cell_faces = interpolate(solid, "faces")
    kind = F.when(F.size("nodes") == 3, "triangle").otherwise("quadrilateral")
    ring = _parts(faces.select(F.col("point").alias("cell"), kind.alias("tag"), F.col("nodes").alias("vertices")), EDGES).withColumn("key", F.array_sort("nodes"))
    sides = ring.join(edges.select(F.col("point").alias("dst"), F.array_sort("nodes").alias("key"), F.col("nodes").alias("own")), "key")
    out = out.unionByName(cell_faces).unionByName(sides.select(F.col("cell").alias("src"), "dst", "slot", F.when(F.col("nodes") == F.col("own"), 0).otherwise(-1).alias("orient")))
    return Mesh(out, types.unionByName(faces.select("point", kind.alias("tag"), none)), mesh.coords, mesh.labels, mesh.periodic, mesh.sections)


def refine_full(mesh: Mesh, only: DataFrame | None = None) -> tuple[Mesh, DataFrame]:
    """As refine, with faces and edges of the refined cells."""
    fine, mapping = refine(mesh, only)
    return full_topology(fine), mapping


#: What a cell becomes between two layers.
EXTRUDED = {"segment": "quadrilateral", "triangle": "prism", "quadrilateral": "hexahedron"}


def extrude(mesh: Mesh, levels: list[float]) -> Mesh:
    """Layers of cells over a surface: vertex and cell ids repeat with a stride, the last coordinate is each level's height."""
    spark = mesh.arrows.sparkSession
    stride = mesh.cell_types.agg(F.max("point")).first()[0] or 0
    n = len(levels)
    other = [r["tag"] for r in mesh.cell_types.where(~F.col("tag").isin("vertex", *EXTRUDED)).select("tag").distinct().collect()]
    if other:
        raise ValueError(f"no extrusion of {sorted(other)}")
    level = F.broadcast(spark.createDataFrame(list(enumerate(levels)), "layer int, z double"))
    coords = mesh.coords.join(level).select((F.col("point") + F.col("layer") * stride).alias("point"), F.concat("xyz", F.array("z")).alias("xyz"))
    cells = cell_vertices(mesh).where(F.col("tag").isin(list(EXTRUDED))).join(F.broadcast(spark.range(n - 1).withColumnRenamed("id", "layer")))
    up = F.transform("vertices", lambda v: v + (F.col("layer") + 1) * stride)
    down = F.transform("vertices", lambda v: v + F.col("layer") * stride)
    ring = F.when(F.col("tag") == "segment", F.concat(down, F.reverse(up))).otherwise(F.concat(down, up))
    made = cells.select((F.col("cell") + (F.col("layer") + n) * stride).alias("src"), "tag", ring.alias("v"))
    arrows = made.select("src", F.posexplode("v").alias("slot", "dst")).select("src", "dst", "slot", F.lit(0).alias("orient"))
    tag = F.create_map(*[F.lit(x) for kv in EXTRUDED.items() for x in kv])[F.col("tag")]
    none = F.lit(None).cast("int").alias("param")
    types = coords.select("point", F.lit("vertex").alias("tag"), none).unionByName(made.select(F.col("src").alias("point"), tag.alias("tag"), none))
    labels = mesh.labels.join(level).select("name", (F.col("point") + F.col("layer") * stride).alias("point"), "value") if mesh.labels is not None else None
    return Mesh(arrows, types, coords, labels)


def transform(mesh: Mesh, xyz) -> Mesh:
    """Every coordinate replaced by an expression over the array column xyz."""
    return Mesh(mesh.arrows, mesh.cell_types, mesh.coords.withColumn("xyz", xyz(F.col("xyz"))), mesh.labels, mesh.periodic, mesh.sections)


def reference_cell(spark: SparkSession, tag: str) -> Mesh:
    """One cell with its vertices at the reference places."""
    #: Reference vertices.
    places = {
        "segment": [(0,), (1,)],
        "triangle": [(0, 0), (1, 0), (0, 1)],
        "quadrilateral": [(0, 0), (1, 0), (1, 1), (0, 1)],
        "tetrahedron": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)],
        "hexahedron": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
        "prism": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)],
        "pyramid": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)],
    }[tag]
    n = len(places)
    coords = spark.createDataFrame([(k + 1, [float(x) for x in p]) for k, p in enumerate(places)], "point long, xyz array<double>")
    arrows = spark.createDataFrame([(n + 1, k + 1, k, 0) for k in range(n)], "src long, dst long, slot int, orient int")
    types = spark.createDataFrame([*[(k + 1, "vertex", None) for k in range(n)], (n + 1, tag, None)], "point long, tag string, param int")
    return Mesh(arrows, types, coords)


def shell(spark: SparkSession, around: int, along: int, kind: str = "cylinder", radius: float = 1.0, height: float = 1.0) -> Mesh:
    """Quadrilaterals over a cylinder's or sphere's surface; the seam's vertices coincide and are listed as periodic."""
    flat = quad_mesh(spark, around, along, periodic=(True, False))
    turn, up = F.get("xyz", F.lit(0)) * (2 * 3.141592653589793), F.get("xyz", F.lit(1))
    if kind == "cylinder":
        xyz = F.array(radius * F.cos(turn), radius * F.sin(turn), up * height)
    else:
        tilt = (up - 0.5) * 3.141592653589793
        xyz = F.array(radius * F.cos(tilt) * F.cos(turn), radius * F.cos(tilt) * F.sin(turn), radius * F.sin(tilt))
    return transform(flat, lambda _: xyz)
