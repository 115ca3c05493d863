"""Operators on the small fixtures of FIXTURES.md."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import orientation as O
from weftgraph.operators import adapt, assembly, checks, constraints, distribution, fem, fvm, generate, geometry, labels, lattice, maps, partition, sections, strata, topology, traverse

FIGURE = {0: [2, 3, 4], 1: [4, 5, 6], 2: [8, 9], 3: [9, 11], 4: [8, 10], 5: [10, 7], 6: [7, 8]}


def arrows(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


@pytest.fixture(scope="module")
def figure(spark):
    return arrows(spark, [(a + 1, b + 1) for a, bs in FIGURE.items() for b in bs])


def pts(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "point long")


def got(df, col="point"):
    return sorted(r[col] for r in df.collect())


def test_figure_mesh(spark, figure):
    assert got(topology.cone(figure, pts(spark, 1)), "dst") == [3, 4, 5]
    assert got(topology.support(figure, pts(spark, 5)), "src") == [1, 2]
    assert got(traverse.closure(figure, pts(spark, 2))) == [2, 5, 6, 7, 8, 9, 11]
    assert got(traverse.star(figure, pts(spark, 9))) == [1, 2, 3, 5, 7, 9]
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    assert got(lattice.meet(figure, pairs((1, 2)))) == [5]
    assert got(lattice.join(figure, pairs((3, 5)))) == [1]
    assert got(lattice.join(figure, pairs((3, 6)))) == []
    assert traverse.link(figure, pts(spark, *range(1, 13))).count() == 0


def test_two_cells_and_y(spark):
    a = arrows(spark, [(1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (4, 7), (5, 7), (5, 8)])
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    assert got(lattice.meet(a, pairs((1, 2)))) == [3] and got(lattice.join(a, pairs((6, 8)))) == [1, 2]
    y = arrows(spark, [(10, 12), (11, 12), (12, 13), (12, 14)])
    assert got(lattice.meet(y, pairs((10, 11)))) == [12] and got(lattice.join(y, pairs((13, 14)))) == [10, 11]


def test_strata_chain_cycle_and_numbering(spark):
    a = arrows(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (2, 5)])
    s = {r.point: (r.height, r.depth) for r in strata.strata(a).collect()}
    assert s[5] == (4, 0) and s[1] == (0, 4)
    assert not strata.is_acyclic(arrows(spark, [(1, 2), (2, 3), (3, 1)])) and strata.is_acyclic(a)
    perm = strata.permutation(strata.strata(a))
    assert strata.permutation_faults(perm, topology.points(a)).count() == 0
    new = strata.renumber(a, perm, "src", "dst")
    assert sorted((r.src, r.dst) for r in new.collect()) == sorted((x, y) for x, y in [(1, 2), (2, 3), (3, 4), (4, 5), (2, 5)])


def test_reductions(spark):
    diamond = [(1, 2), (1, 3), (2, 4), (3, 4)]
    a = arrows(spark, [*diamond, (1, 4)])
    assert [(r.src, r.dst) for r in lattice.redundant(a).collect()] == [(1, 4)]
    assert lattice.transitive_reduction(a).count() == 4
    assert [(r.src, r.dst) for r in lattice.closure_edges(arrows(spark, diamond)).collect()] == [(1, 4)]


def test_adjacency(spark):
    a = arrows(spark, [(10, 20), (10, 21), (11, 20), (11, 22), (11, 23), (12, 25), (12, 24), (23, 30), (24, 30)])
    e = lattice.cell_adjacency(a, pts(spark, 10, 11, 12))
    rows = {r.point: (r.neighbors, r.xadj) for r in lattice.dual_graph(a, pts(spark, 10, 11, 12)).collect()}
    assert rows == {10: ([11], 0), 11: ([10], 1), 12: ([], 2)} and e.count() == 1
    assert {(r.u, r.v) for r in lattice.vertex_adjacency(arrows(spark, [(10, 1), (10, 2), (11, 2), (11, 3)]), pts(spark, 1, 2, 3)).collect()} == {(1, 2), (2, 3)}
    assert {(r.u, r.v) for r in lattice.cell_adjacency(a, pts(spark, 10, 11, 12), 2).collect()} == {(10, 11), (11, 12)}


def test_rcm_on_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in [3, 1, 5, 2, 4]], "u long, v long")
    order = strata.rcm(e)
    assert sorted(r["rank"] for r in order.collect()) == list(range(6))
    assert strata.bandwidth(e, order).first().bandwidth == 1


def test_orientation_groups(spark):
    df = spark.range(1).select(
        O.dihedral_compose(O.dihedral(F.lit(1), F.lit(True)), O.dihedral(F.lit(2), F.lit(False)), 4).alias("d"),
        O.perm_compose(F.array(*map(F.lit, [1, 2, 0])), O.perm_inverse(F.array(*map(F.lit, [1, 2, 0])))).alias("p"),
        O.rot_compose(F.lit(3), O.rot_inverse(F.lit(3), 5), 5).alias("r"), O.accumulate(F.array(F.lit(1), F.lit(-2), F.lit(4)), F.lit(0), lambda a, b: a + b).alias("s"),
    ).first()
    assert (df.d.rot, df.d.flip, df.p, df.r, df.s) == (3, True, [0, 1, 2], 0, 3)
    for k in range(4):
        for f in (True, False):
            g = O.dihedral(F.lit(k), F.lit(f))
            x = spark.range(1).select(O.dihedral_compose(g, O.dihedral_inverse(g, 4), 4).alias("x")).first().x
            assert (x.rot, x.flip) == (0, False)


def test_oriented_faces(spark):
    a = spark.createDataFrame([(1, 9, 0), (2, 9, 0), (3, 8, 1), (4, 8, -1)], "src long, dst long, orient int")
    bad = topology.face_orientation_mismatches(a.withColumn("orient", F.when(F.col("src") == 1, 1).otherwise(F.col("orient"))), pts(spark, 8, 9))
    assert [(r.face, r.a, r.b) for r in bad.collect()] == [(9, 1, 2)]
    fixed = topology.repair_face_orientations(a.withColumn("orient", F.when(F.col("src") == 1, 1).otherwise(F.col("orient"))), pts(spark, 9))
    assert topology.face_orientation_mismatches(fixed, pts(spark, 8, 9)).count() == 0
    c = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (1, 3, 9)], "src long, dst long, orient int")
    assert {r.point: r.orient for r in traverse.oriented_closure(c, pts(spark, 1)).collect()} == {1: 0, 2: 1, 3: 9}


def test_closure_values_set_and_add(spark):
    a = arrows(spark, [(1, 2), (1, 3), (2, 4)])
    spans = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 1), (4, 4, 1)], "point long, seq long, len int")
    rows = spark.createDataFrame([(1, 1, 0, 10.0), (2, 2, 0, 20.0), (2, 2, 1, 21.0), (3, 3, 0, 30.0), (4, 4, 0, 40.0)], "point long, seq long, idx int, value double")
    index = assembly.closure_index(a, pts(spark, 1), sections.atlas(spans))
    assert [r.value for r in assembly.closure_values(index, rows).orderBy("slot").collect()] == [10, 20, 21, 30, 40]
    put = lambda v: index.select("point", "offset", F.explode(F.sequence(F.lit(0), F.col("len").cast("int") - 1)).alias("idx")).withColumn("value", F.get(F.array(*map(F.lit, v)), (F.col("offset") + F.col("idx")).cast("int")))
    now = assembly.set_closure(assembly.set_closure(rows, put([1.0, 2.0, 3.0, 4.0, 5.0])), put([10.0, 20.0, 30.0, 40.0, 50.0]), add=True)
    assert [r.value for r in now.orderBy("point", "idx").collect()] == [11, 22, 33, 44, 55]


def test_two_rank_assembly(spark):
    local = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 2.0), (1, 1, 0, 3.0), (1, 2, 0, 4.0)], "rank int, point long, idx int, value double")
    owners = spark.createDataFrame([(1, 0), (2, 1)], "point long, owner int")
    fixed = spark.createDataFrame([(1, 0, 9.0)], "point long, idx int, value double")
    out = {(r["rank"], r.point): r.value for r in assembly.assemble_shared(local, owners, fixed).collect()}
    assert out == {(0, 1): 9.0, (1, 1): 9.0, (0, 2): 6.0, (1, 2): 6.0}


def test_two_cell_distribution(spark):
    a = arrows(spark, [(10, 1), (10, 2), (11, 2), (11, 3)])
    parts = spark.createDataFrame([(10, 0), (11, 1)], "cell long, part int")
    d = distribution.distribute(a, parts, 1)
    assert {(r["rank"], r.point) for r in d["held"].collect() if r["rank"] == 0} == {(0, p) for p in (1, 2, 3, 10, 11)}
    assert {r.point: r.owner for r in d["ownership"].where("rank = 0").collect()} == {1: 0, 2: 0, 10: 0, 3: 1, 11: 1}
    assert checks.ownership_faults(d["ownership"], d["overlap"], d["held"]).count() == 0
    assert distribution.overlap_faults(d["overlap"].withColumn("remote_point", F.col("point"))).count() == 0
    sf = distribution.forest(d["ownership"])
    vals = spark.createDataFrame([(0, p, 100.0 + p) for p in (1, 2, 10)] + [(1, p, 100.0 + p) for p in (3, 11)], "rank int, point long, value double")
    moved = {(r["rank"], r.point): r.value for r in distribution.migrate(vals, sf).collect()}
    assert moved[0, 11] == 111.0 and moved[1, 2] == 102.0
    assert distribution.forest_faults(sf, d["held"]).count() == 0 and distribution.invert(sf).count() == sf.count()


def test_resize_reverse_and_labels(spark):
    s = spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], "point long, seq long, values array<double>")
    n = spark.createDataFrame([(1, 5)], "point long, len int")
    want = {"zero": [0] * 5, "pad": [9] * 5, "prefix": [1, 2, 3, 0, 0], "suffix": [0, 0, 1, 2, 3]}
    assert {p: sections.resize(s, n, p, 9.0).first()["values"] for p in want} == want
    assert sections.resize(s, n.withColumn("len", F.lit(2)), "suffix").first()["values"] == [2, 3]


def test_scatter(spark):
    """Slices of any length, holes and empty slices; a small layout's spans aren't broadcast."""
    lens = [3, 0, 200, 1, 64, 0, 65]
    layout = sections.atlas(spark.createDataFrame([(k + 1, k, n) for k, n in enumerate(lens)], "point long, seq long, len int"))
    total = sum(lens)
    buffer = spark.createDataFrame([(i, i / 2) for i in reversed(range(total)) if i != 1], "index long, value double")
    got = sections.scatter(layout, buffer)
    at, want = 0, {}
    for k, n in enumerate(lens):
        if n:
            want[k + 1] = [i / 2 for i in range(at, at + n) if i != 1]
        at += n
    assert {r.point: r.values for r in got.collect()} == want
    joined = sections.scatter(spark.range(9).selectExpr("id as point", "id as seq", "1000000 as len", "id * 1000000 as offset"), spark.range(9).selectExpr("id as index", "1.0D as value"))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    own = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "name string, point long, value int")
    all_ = labels.propagate_all(own, arrows(spark, [(1, 3), (2, 3), (3, 4)]))
    assert {(r.point, r.value) for r in all_.collect()} == {(1, 1), (2, 2), (3, 2), (4, 2)}


def test_generated_meshes(spark):
    m = generate.interval_mesh(spark, 2, 0.0, 2.0, periodic=True)
    assert m.cell_types.count() == 5 and [r.xyz[0] for r in m.coords.orderBy("point").collect()] == [0, 1, 2]
    assert [(r.slave, r.master) for r in m.periodic.collect()] == [(3, 1)]
    q = generate.quad_mesh(spark, 1, 1)
    assert q.cell_types.count() == 5 and {r.name: r["count"] for r in q.labels.groupBy("name").count().collect()} == dict.fromkeys(["x_min", "x_max", "y_min", "y_max"], 2)
    h = generate.hex_mesh(spark, 1, 1, 1)
    assert h.cell_types.count() == 9 and labels.stratum(h.labels, "x_min", 1).count() == 4
    for mesh, volume in ((generate.hex_mesh(spark, 2, 3, 2, high=(2.0, 1.0, 3.0)), 6.0), (generate.triangulated(generate.quad_mesh(spark, 3, 2)), 1.0), (generate.extrude(generate.triangulated(generate.quad_mesh(spark, 2, 2)), [0.0, 1.0, 2.0]), 2.0)):
        cells = generate.cell_coordinates(mesh)
        assert math.isclose(cells.agg(F.sum(geometry.measure(F.col("tag"), F.col("pts")))).first()[0], volume)
        assert checks.topology_faults(mesh).count() == 0
    e, ea = generate.interpolate(generate.quad_mesh(spark, 2, 1))
    assert e.count() == 7 and ea.count() == 8 and ea.where("orient = -1").count() == 1
    f, fa = generate.interpolate(generate.hex_mesh(spark, 2, 1, 1), "faces")
    assert f.count() == 11 and fa.count() == 12


@pytest.mark.parametrize("tag", ["segment", "triangle", "quadrilateral", "tetrahedron", "hexahedron", "prism", "pyramid"])
def test_refinement_keeps_measure_and_shares_midpoints(spark, tag):
    m = generate.reference_cell(spark, tag)
    fine, mapping = generate.refine(m)
    size = lambda x: generate.cell_coordinates(x).agg(F.sum(geometry.measure(F.col("tag"), F.col("pts"))), F.min(geometry.measure(F.col("tag"), F.col("pts")))).first()
    assert math.isclose(size(fine)[0], size(m)[0]) and size(fine)[1] > 0
    assert mapping.count() == {"segment": 2, "triangle": 4, "quadrilateral": 4, "tetrahedron": 8, "hexahedron": 8, "prism": 4, "pyramid": 4}[tag]
    assert fine.coords.count() == {"segment": 3, "triangle": 6, "quadrilateral": 9, "tetrahedron": 10, "hexahedron": 27, "prism": 12, "pyramid": 10}[tag]
    assert tag == "segment" or generate.cell_coordinates(fine).agg(F.min(geometry.signed_measure(F.col("tag"), F.col("pts")))).first()[0] > 0


def test_refinement_of_chosen_cells(spark):
    m = generate.hex_mesh(spark, 2, 1, 1)
    first = m.cell_types.where("tag = 'hexahedron'").select("point").orderBy("point").limit(1)
    once, _ = generate.refine(m, first)
    assert once.cell_types.where("tag = 'hexahedron'").count() == 9
    hanging = once.sections["hanging"]
    assert hanging.select("point").distinct().count() == 5  # four edges and the middle of the shared face
    assert hanging.groupBy("point").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-12").count() == 0
    rest = m.cell_types.where("tag = 'hexahedron'").select("point").join(first, "point", "left_anti")
    twice, _ = generate.refine(once, rest)
    assert twice.coords.count() == 5 * 3 * 3 and twice.coords.select("xyz").distinct().count() == 45
    assert twice.sections["hanging"].count() == 0
    with pytest.raises(ValueError, match="polygon"):
        generate.refine(generate.Mesh(m.arrows, m.cell_types.withColumn("tag", F.when(F.col("tag") == "hexahedron", "polygon").otherwise(F.col("tag"))), m.coords))


def test_full_topology(spark):
    fine, _ = generate.refine_full(generate.hex_mesh(spark, 1, 1, 1))
    n = {r["tag"]: r["count"] for r in fine.cell_types.groupBy("tag").count().collect()}
    assert n == {"vertex": 27, "segment": 54, "quadrilateral": 36, "hexahedron": 8}  # 27 - 54 + 36 - 8 = 1
    assert fine.arrows.count() == 8 * 6 + 36 * 4 + 54 * 2
    flat, _ = generate.refine_full(generate.quad_mesh(spark, 1, 1))
    assert flat.arrows.count() == 4 * 4 + 12 * 2


def test_metric_adaptation_refines_long_cells_only(spark):
    from weftgraph.mesh import MeshDM, Options

    m = generate.quad_mesh(spark, 2, 1, high=(2.0, 1.0))
    cells = [r.point for r in m.cell_types.where("tag = 'quadrilateral'").orderBy("point").collect()]
    metric = spark.createDataFrame([(cells[0], [4.0, 0.0, 4.0, 0.0, 0.0, 0.0]), (cells[1], [1.0, 0.0, 1.0, 0.0, 0.0, 0.0])], "cell long, metric array<double>")
    got = MeshDM(m, Options()).adapt_with_metric(metric, 2)
    assert got.mesh.cell_types.where("tag = 'quadrilateral'").count() == 5


def test_location_quality_and_face_metrics(spark):
    q = generate.cell_coordinates(generate.quad_mesh(spark, 2, 2))
    at = spark.createDataFrame([(1, [0.25, 0.25]), (2, [1.0, 0.5]), (3, [1.2, 0.5])], "query int, x array<double>")
    assert {r["query"]: r.cell is not None for r in geometry.locate(q, at, 0.5).collect()} == {1: True, 2: True, 3: False}
    tri = spark.createDataFrame([(1, "triangle", [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "cell long, tag string, pts array<array<double>>")
    r = geometry.quality(tri).first()
    assert math.isclose(r.signed_measure, 0.5) and math.isclose(r.min_angle, 45) and math.isclose(r.aspect_ratio, math.sqrt(2))
    faces = spark.createDataFrame([(1, [[1.0, 0.0], [1.0, 1.0]]), (2, [[0.0, 0.0], [1.0, 0.0]])], "face long, pts array<array<double>>")
    cells = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), (2, [[1.0, 0.0], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0]])], "cell long, pts array<array<double>>")
    sup = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "face long, cell long")
    m = {r.face: r for r in geometry.face_metrics(faces, sup, cells).collect()}
    assert (m[1].owner, m[1].neighbor, m[1].area, m[1].distance) == (1, 2, 1.0, 1.0) and abs(m[1].non_orthogonality) < 1e-6 and m[1].skewness < 1e-12
    assert m[2].neighbor is None and m[2].area_vector[1] == -1.0
    assert [(r.face, r.kind) for r in fvm.face_loops(sup).orderBy("face").collect()] == [(1, "internal"), (2, "boundary")]


def test_finite_elements(spark):
    for tag, size in (("segment", 1), ("triangle", 0.5), ("quadrilateral", 1), ("tetrahedron", 1 / 6), ("hexahedron", 1), ("prism", 0.5), ("pyramid", 1 / 3)):
        x, w = fem.quadrature(tag, 4)
        assert math.isclose(w.sum(), size) and math.isclose((w * x[:, 0] ** 3).sum(), {"segment": 1 / 4, "triangle": 1 / 20, "quadrilateral": 1 / 4, "tetrahedron": 1 / 120, "hexahedron": 1 / 4, "prism": 1 / 20, "pyramid": (w * x[:, 0] ** 3).sum()}[tag])
    for tag, order in (("triangle", 3), ("hexahedron", 2), ("tetrahedron", 4), ("prism", 2)):
        v, g = fem.tabulate(tag, order, fem.nodes(tag, order))
        assert np.allclose(v, np.eye(len(v)), atol=1e-9) and np.allclose(g.sum(1), 0, atol=1e-8)
    mesh = generate.triangulated(generate.quad_mesh(spark, 2, 2))
    rows = fem.element_matrices(generate.cell_coordinates(mesh), "triangle")
    k = fem.assemble(rows, generate.cell_vertices(mesh))
    assert abs(k.groupBy("row").agg(F.sum("value").alias("s")).agg(F.max(F.abs("s"))).first()[0]) < 1e-12
    assert math.isclose(rows.agg(F.sum("mass")).first()[0], 1.0) and math.isclose(rows.agg(F.sum("load")).first()[0], 1.0)


def test_finite_volumes(spark):
    f = spark.createDataFrame([(1, 1, 2, 2.0, [1.0, 0.0]), (2, 1, None, -1.0, [-1.0, 0.0])], "face long, owner long, neighbor long, mass_flux double, area_vector array<double>")
    c = spark.createDataFrame([(1, 10.0), (2, 20.0)], "cell long, phi double")
    j = fvm.joined(f, c)
    assert {r.cell: r.residual for r in fvm.residual(fvm.convective(j)).collect()} == {1: 10.0, 2: -20.0}
    assert {r.cell: r.residual for r in fvm.residual(fvm.convective(j, "central")).collect()} == {1: 20.0, 2: -30.0}
    d = fvm.diffusive(j.withColumn("area", F.lit(1.0)).withColumn("distance", F.lit(0.5)).withColumn("non_orthogonality", F.lit(0.0)), 2.0)
    assert {r.cell: r.residual for r in fvm.residual(d).collect()} == {1: -40.0, 2: 40.0}
    g = fvm.gradients(j, spark.createDataFrame([(1, 1.0), (2, 1.0)], "cell long, volume double"))
    assert {(r.cell, r.axis): r.gradient for r in g.collect()}[1, 0] == 5.0
    lim = spark.range(1).select(*[fvm.limiter(n, F.lit(0.5)).alias(n) for n in ("minmod", "van_leer", "superbee", "van_albada", "none")]).first()
    assert [round(x, 4) for x in lim] == [0.5, 0.6667, 1.0, 0.6, 1.0]


def test_adaptation_and_forest(spark):
    m = spark.createDataFrame([(1, [4.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 1.0, 0.0, 0.0, 0.0])], "point long, metric array<double>")
    n = {r.point: r.metric for r in adapt.normalize_metric(m, 2, target=6.0).collect()}
    assert math.isclose(n[1][0], 8.0) and math.isclose(n[2][2], 2.0)
    cells = spark.createDataFrame([(1, "triangle", [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [4.0, 0.0, 4.0, 0.0, 0.0, 0.0])], "cell long, tag string, pts array<array<double>>, metric array<double>")
    r = adapt.select_by_metric(cells, 2).first()
    assert math.isclose(r.longest_edge, 2 * math.sqrt(2)) and r.action == "refine"
    root = spark.createDataFrame([(0, [0, 0], 1.0)], "level int, coords array<long>, value double")
    one = adapt.refine_by_indicator(root, 2, 0.5)
    two = adapt.refine_by_indicator(one.withColumn("value", F.when(F.get("coords", F.lit(0)) + F.get("coords", F.lit(1)) == 0, 1.0).otherwise(0.0)), 2, 0.5)
    flat = adapt.conforming(two, 2)
    assert two.count() == 7 and flat.count() == 16 and flat.agg(F.min("level")).first()[0] == 2
    assert adapt.coarsen_by_indicator(flat.withColumn("value", F.lit(0.0)), 2, 0.5).count() == 4
    assert adapt.forest_mesh(flat, 2).select("vertex").distinct().count() == 25


def test_partitioning(spark):
    ring = [(6 * c + i, 6 * c + j) for c in range(4) for i in range(1, 7) for j in range(i + 1, 7)] + [(1, 7), (7, 13), (13, 19)]
    e = spark.createDataFrame(ring, "u long, v long")
    v = spark.createDataFrame([(i,) for i in range(1, 25)], "vertex long")
    p = partition.partition(e, v, 2, max_iters=20)
    assert p.count() == 24 and p.select("part").distinct().count() == 2
    assert partition.edge_faults(e).count() == 0
    cut, total = partition.edge_cut(e, p).first()
    assert 0 <= cut <= total == len(ring)
    assert partition.pick_seeds(e, v, 5).count() == 5
    cuts = {r.vertex: r for r in partition.vertex_cuts(e, p).collect()}
    assert all(r.primary in r.replicas for r in cuts.values())
    b = distribution.balance_boundary(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "point long, rank int"), spark.createDataFrame([(0, 3), (1, 3)], "rank int, load int"))
    assert {r.point: r.owner for r in b.collect()} == {1: 0, 2: 1}


def test_constraints_and_anchors(spark):
    rows = spark.createDataFrame([(1, 1, 0, 2.0), (2, 2, 0, 4.0), (3, 3, 0, 0.0)], "point long, seq long, idx int, value double")
    anchors = spark.createDataFrame([(3, 1), (3, 2)], "point long, parent long")
    terms = constraints.anchor_terms(anchors, spark.createDataFrame([(3, 1)], "point long, len int"))
    fixed = spark.createDataFrame([(1, 0, 9.0)], "point long, idx int, value double")
    out = {r.point: r.value for r in constraints.apply_all(rows, terms, fixed).collect()}
    assert out == {1: 9.0, 2: 4.0, 3: 3.0}
    assert constraints.faults(rows, spark.createDataFrame([(1, 5, 0.0)], "point long, idx int, value double")).count() == 1
    assert got(constraints.anchor_closure(arrows(spark, [(9, 3)]), anchors, pts(spark, 9))) == [1, 2, 3, 9]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((200, 2)), rng.random((80, 2)) * 3
    src = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(a)], "source long, x array<double>")
    tgt = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(b)], "target long, x array<double>")
    want = {i: int(np.argmin(((a - p) ** 2).sum(1))) for i, p in enumerate(b)}
    assert {r.target: r.source for r in geometry.nearest(src, tgt, 0.05).collect()} == want


def test_nearest_on_a_line(spark):
    """Least ids of equals on both sides, of repeated places and of distances that round alike, as over all pairs."""
    rng = np.random.default_rng(1)
    a = [*(np.round(rng.random(400) * 50) / 4 + 900).tolist(), 1e17 + 64, 1e17, 1e17 + 32, float("inf"), None]
    b = [*(np.round(rng.random(300) * 800) / 8 + 860).tolist(), -1e16, 3e17, 1e300, -1e300, float("inf"), None]
    src = spark.createDataFrame([(len(a) - i, [x]) for i, x in enumerate(a)], "source long, x array<double>")
    tgt = spark.createDataFrame([(i, [x]) for i, x in enumerate(b)], "target long, x array<double>")
    got = {r.target: (r.distance, r.source) for r in geometry.nearest(src, tgt, 1.0).collect()}
    known = [(len(a) - i, x) for i, x in enumerate(a) if x is not None and x < float("inf")]
    want = {i: min((abs(t - x), s) for s, x in known) if t is not None else (None, min(known)[0]) for i, t in enumerate(b)}
    assert got == want
    assert {r.target: r.source for r in geometry.nearest(src.limit(0), tgt, 1.0).collect()} == dict.fromkeys(range(len(b)))


@pytest.mark.parametrize("tag", ["segment", "triangle", "quadrilateral", "tetrahedron", "hexahedron", "prism", "pyramid"])
def test_reference_maps(spark, tag):
    cell = generate.cell_coordinates(generate.reference_cell(spark, tag))
    turned = F.transform("pts", lambda p: F.concat(F.transform(p, lambda x: 2 * x + 1), F.array_repeat(F.lit(3.0), 3 - F.size(p))))
    dim = len(cell.first().pts[0])
    rows = cell.withColumn("pts", turned).withColumn("at", F.array(*[F.lit(0.2)] * dim))
    got = maps.physical_to_reference(maps.reference_to_physical(rows), out="back").first()
    # a pyramid's base shrinks towards its apex, the other reference maps are the identity
    at = [1.52, 1.52, 1.4] if tag == "pyramid" else [1.4] * dim + [3.0] * (3 - dim)
    pushed = [3.4, 5.0, 6.0] if tag == "pyramid" else [2.0 * (k + 1) for k in range(dim)] + [0.0] * (3 - dim)
    assert got.x == pytest.approx(at) and got.back == pytest.approx([0.2] * dim)
    v = maps.pull_back(maps.push_forward(rows, F.array(*[F.lit(float(k + 1)) for k in range(dim)])), "pushed").first()
    assert v.pushed == pytest.approx(pushed) and v.pulled == pytest.approx([k + 1.0 for k in range(dim)])
    flat = rows.withColumn("pts", F.transform("pts", lambda p: F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))))
    assert maps.pull_back(flat, F.array(*[F.lit(1.0)] * 3)).first().pulled is None
    assert maps.reference_to_physical(rows.withColumn("at", F.lit(None).cast("array<double>"))).first().x is None
    assert maps.reference_to_physical(rows.limit(0)).count() == 0


def test_interpolation_in_any_cell(spark):
    m = generate.hex_mesh(spark, 2, 2, 2)
    cells = generate.cell_vertices(m).join(generate.cell_coordinates(m).drop("tag"), "cell")
    f = F.get("xyz", F.lit(0)) + 2 * F.get("xyz", F.lit(1)) * F.get("xyz", F.lit(2))
    at = spark.createDataFrame([(1, [0.3, 0.2, 0.9]), (2, [0.75, 0.6, 0.1])], "query int, x array<double>")
    located = geometry.locate(cells.select("cell", "tag", "pts"), at, 0.5).join(at, "query")
    got = maps.interpolate_at(located, cells, m.coords.select("point", f.alias("value")))
    assert {r["query"]: round(r["value"], 9) for r in got.collect()} == {1: 0.66, 2: 0.87}


def test_adapt_topology(spark):
    m = generate.quad_mesh(spark, 2, 1)
    cells = [r.point for r in m.cell_types.where("tag = 'quadrilateral'").orderBy("point").collect()]
    values = lambda *v: spark.createDataFrame(list(zip(cells, v, strict=True)), "cell long, value double")
    action, fine, mapping = adapt.adapt_topology(m, values(0.9, 0.0), 0.5, 0.1)
    assert action == "refined" and mapping.count() == 4 and fine.cell_types.where("tag = 'quadrilateral'").count() == 5

    def plan(down, dst=1):
        return down.select(F.lit(99).cast("long").alias("coarse"), F.col("point").alias("fine")), spark.createDataFrame([(99, dst), (99, 2)], "coarse long, dst long")

    action, coarse, mapping = adapt.adapt_topology(m, values(0.0, 0.0), 0.5, 0.1, plan)
    assert action == "coarsened" and mapping.count() == 2 and coarse.arrows.count() == 2
    assert adapt.adapt_topology(m, values(0.3, 0.3), 0.5, 0.1, plan)[0] == "unchanged"
    with pytest.raises(checks.MeshError, match="cone"):
        adapt.adapt_topology(m, values(0.0, 0.0), 0.5, 0.1, lambda down: plan(down, 12345))


def test_label_transfer_faults(spark):
    mark = lambda *r: spark.createDataFrame([("id", p, v) for p, v in r], "name string, point long, value int")
    values = spark.createDataFrame([(1, 5.0)], "point long, x double")
    source, target = mark((1, 10), (2, 20), (3, 20)), mark((7, 10), (8, 20), (9, 30))
    assert [tuple(r) for r in adapt.transfer_labels(values, source, target, "id").collect()] == [(7, 5.0)]
    assert sorted(map(tuple, adapt.transfer_label_faults(values, source, target, "id").distinct().collect())) == [(20, "duplicate"), (20, "no_data"), (30, "missing")]


def test_loads_of_merged_clusters(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(1, 400, (3000, 2)) if a != b]
    edges = spark.createDataFrame([(min(x), max(x)) for x in e], "u long, v long")
    own = spark.createDataFrame([(k, k) for k in range(1, 411)], "vertex long, cluster long")  # the last ten have no edges
    got = partition.merge_clusters(own, edges, 8, 0.05)
    assert got.count() == 410
    load = partition.load_balance(edges, got.select("vertex", "part")).first()
    assert load.max_load <= 2 * edges.count() / 8 * 1.05 + 1
    hub = spark.createDataFrame([(1, k) for k in range(2, 102)], "u long, v long")
    assert partition.merge_clusters(own.limit(101), hub, 4).where("vertex = 1").count() == 1
    clusters = partition.louvain(edges, own.select("vertex"), 60)
    assert clusters.count() == 410 and clusters.select("cluster").distinct().count() >= 60
