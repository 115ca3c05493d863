import pytest
from pyspark.sql import functions as F

from weftgraph.mesh import MeshDM, Options
from weftgraph.operators import checks, generate, labels
from weftgraph.sources import bundles, formats

FILES = {
    "gmsh": "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n1\n10 2 2 5 9 1 2 3\n$EndElements\n",
    "ply": "ply\nformat ascii 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n2 0 0\n3 0 1 2\n4 1 4 2 3\n",
    "fluent": "# quad\nvertices 4\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\ncells 1\ncell 1 2 3 4\nlabel fluent:bc 7 1 4\n",
    "exodus": "EXODUS\nDIM 2\nNODES 3\n1 0 0\n2 1 0\n3 0 1\nELEMENTS 1\n10 Triangle 3 1 2 3\nLABELS 2\n10 exodus:material 7\n10 exodus:region 42\nEND\n",
    "xdmf": '<Xdmf><Domain><Grid><Topology TopologyType="Triangle"><DataItem Dimensions="1 3">0 1 2</DataItem></Topology><Geometry><DataItem Dimensions="3 2">0 0 1 0 0 1</DataItem></Geometry></Grid></Domain></Xdmf>',
}
GMSH4 = "$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 3 1 3\n2 1 0 3\n1\n2\n3\n0 0 0\n1 0 0\n0 1 0\n$EndNodes\n$Elements\n1 1 1 1\n2 6 2 1\n1 1 2 3\n$EndElements\n"


def read(spark, tmp_path, kind, text):
    (tmp_path / f"m.{kind}").write_text(text)
    return formats.read_mesh(spark, str(tmp_path / f"m.{kind}"), kind)


def cells(mesh):
    return sorted((r.cell, r.tag, tuple(r.vertices)) for r in generate.cell_vertices(mesh).collect())


def test_fixture_files(spark, tmp_path):
    m = read(spark, tmp_path, "gmsh", FILES["gmsh"])
    assert cells(m) == [(10, "triangle", (1, 2, 3))] and {(r.name, r.value) for r in m.labels.collect()} == {("gmsh:physical", 5), ("gmsh:entity", 9)}
    m = read(spark, tmp_path, "ply", FILES["ply"])
    assert cells(m) == [(6, "triangle", (1, 2, 3)), (7, "quadrilateral", (2, 5, 3, 4))] and m.coords.count() == 5
    m = read(spark, tmp_path, "fluent", FILES["fluent"])
    assert cells(m) == [(5, "quadrilateral", (1, 2, 3, 4))] and labels.stratum(m.labels, "fluent:bc", 7).count() == 2
    m = read(spark, tmp_path, "exodus", FILES["exodus"])
    assert cells(m) == [(10, "triangle", (1, 2, 3))] and {(r.name, r.value) for r in m.labels.collect()} == {("exodus:material", 7), ("exodus:region", 42)}
    assert cells(read(spark, tmp_path, "xdmf", FILES["xdmf"])) == [(4, "triangle", (1, 2, 3))]


def test_gmsh4_ids_and_bad_files(spark, tmp_path):
    m = read(spark, tmp_path, "gmsh", GMSH4)
    assert cells(m) == [(4, "triangle", (1, 2, 3))] and [(r.name, r.value) for r in m.labels.collect()] == [("gmsh:entity", 6)]
    with pytest.raises(ValueError):
        formats.gmsh(FILES["gmsh"].replace("2.2 0 8", "2.2 1 8"))
    with pytest.raises(ValueError):
        formats.ply("solid")


@pytest.mark.parametrize("kind", ["gmsh", "vtk", "exodus"])
def test_written_files_read_back(spark, tmp_path, kind):
    m = generate.quad_mesh(spark, 3, 2)
    m.labels = m.labels.where("name = 'x_min'").unionByName(spark.createDataFrame([("gmsh:physical", 13, 4)], "name string, point long, value int"))
    formats.write_mesh(m, str(tmp_path / "out"), kind)
    back = formats.read_mesh(spark, str(tmp_path / "out"), kind)
    assert cells(back) == cells(m)
    xyz = lambda x: sorted((r.point, tuple((r.xyz + [0.0])[:3])) for r in x.coords.collect())
    assert xyz(back) == xyz(m)
    if kind != "gmsh":
        assert sorted(map(tuple, back.labels.collect())) == sorted(map(tuple, m.labels.collect()))


def test_table_sets_pieces_and_bundles(spark, tmp_path):
    m = generate.quad_mesh(spark, 2, 2)
    m.sections = {"temperature": spark.createDataFrame([(1, 1, [1.0])], "point long, seq long, values array<double>"), "pressure": spark.createDataFrame([(2, 1, [2.0])], "point long, seq long, values array<double>")}
    bundles.write_tables(m, str(tmp_path / "t"))
    back = bundles.read_tables(spark, str(tmp_path / "t"), sections="^temp")
    assert cells(back) == cells(m) and list(back.sections) == ["temperature"] and back.periodic is None
    dm = MeshDM(m)
    parts = dm.cells.select(F.col("point").alias("cell"), (F.col("point") % 2).cast("int").alias("part"))
    d = dm.distribute(parts, 1)
    bundles.write_pieces(d, str(tmp_path / "p"))
    assert bundles.read_piece(spark, str(tmp_path / "p"), "held", 1).count() == d["held"].where("rank = 1").count()
    o = d["overlap"].withColumn("remote_point", F.col("point"))
    assert sorted(map(tuple, bundles.overlap_from_json(bundles.overlap_json(o)).collect())) == sorted(map(tuple, o.select("rank", "point", "neighbor", "remote_point").collect()))
    own = spark.createDataFrame([(0, "a", 1, 3), (1, "a", 1, 5)], "mesh_id int, name string, point long, value int")
    at = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "mesh_id int, point long")
    assert {(r.mesh_id, r.value) for r in bundles.sync_labels(own, at).collect()} == {(0, 5), (1, 5), (2, 5)}


def test_facade(spark):
    dm = MeshDM(generate.quad_mesh(spark, 2, 1), Options.parse({"dm.refine": "1", "dm.check_topology": "true", "dm.reorder": "vertex_first", "other": "x"}))
    up = dm.setup()
    assert up.cells.count() == 8 and up.mesh.coords.count() == 15 and checks.topology_faults(up.mesh).count() == 0
    flat = up.section_from_depth({0: 2, 1: 0})
    assert flat.agg(F.sum("len")).first()[0] == 30
    assert up.preallocation(flat).agg(F.max("nnz")).first()[0] == 18
    sub, perm = dm.submesh("x_min", 1)
    assert perm.count() == 2
    assert dm.label_boundary().where("name = 'boundary' and value = 2").count() == 2
    m = up.cells.sparkSession.createDataFrame([(7, [100.0, 0.0, 100.0, 0.0, 0.0, 0.0]), (8, [1.0, 0.0, 1.0, 0.0, 0.0, 0.0])], "cell long, metric array<double>")
    assert dm.adapt_with_metric(m, 2).mesh.cell_types.where("tag = 'quadrilateral'").count() == 4**4 + 1
    with pytest.raises(RuntimeError, match="still too long"):
        dm.adapt_with_metric(m, 2, 2)


def test_xdmf_is_read_back(spark, tmp_path):
    m = generate.hex_mesh(spark, 2, 1, 1)
    formats.write_mesh(m, str(tmp_path / "x"), "xdmf")
    back = formats.read_mesh(spark, str(tmp_path / "x" / "part-*"), "xdmf")
    pts = lambda x: sorted(tuple(map(tuple, r.pts)) for r in generate.cell_coordinates(x).collect())
    assert pts(back) == pts(m)
