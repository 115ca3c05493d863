"""Facade over a mesh's tables: queries, sections, submeshes, distribution and checks by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import adapt, assembly, checks, distribution, generate, geometry, labels, lattice, sections, strata, topology, traverse
from .operators.generate import Mesh
from .plans.loops import cut, empty


@dataclass
class Options:
    """Typed profile of option strings; unknown options are left alone."""

    refine: int = 0
    reorder: str = ""
    check_topology: bool = False
    overlap: int = 0
    ranks: int = 1
    metric_high: float = 1.2
    metric_low: float = 0.8
    metric_target: float | None = None

    @classmethod
    def parse(cls, options: Mapping[str, str], prefix: str = "dm.") -> Options:
        """From string pairs such as spark.conf's, named prefix + field."""
        got = cls()
        for f in fields(cls):
            v = options.get(prefix + f.name)
            if v is not None:
                kind = str(f.type)
                setattr(got, f.name, v.lower() in ("1", "true", "yes", "on") if kind == "bool" else int(v) if kind == "int" else float(v) if kind.startswith("float") else v)
        return got


@dataclass
class MeshDM:
    """A mesh with derived tables made on demand and kept."""

    mesh: Mesh
    options: Options = field(default_factory=Options)
    _kept: dict = field(default_factory=dict)

    def _keep(self, name: str, make):
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    @property
    def arrows(self) -> DataFrame:
        return self.mesh.arrows

    @property
    def strata(self) -> DataFrame:
        return self._keep("strata", lambda: strata.strata(self.arrows, self.mesh.cell_types))

    @property
    def cells(self) -> DataFrame:
        """Points of height 0 that aren't alone."""
        return self.strata.where("height = 0 and depth > 0").select("point")

    def chart(self) -> DataFrame:
        return topology.points(self.arrows).agg(F.min("point").alias("first"), (F.max("point") + 1).alias("end"))

    def cone_size(self) -> DataFrame:
        return topology.cone_degree(self.arrows)

    def support_size(self) -> DataFrame:
        return topology.support_degree(self.arrows)

    def closure(self, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
        return traverse.closure(self.arrows, seeds, max_depth=max_depth)

    def star(self, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
        return traverse.star(self.arrows, seeds, max_depth=max_depth)

    def section_from_depth(self, dofs: dict[int, int], support: DataFrame | None = None) -> DataFrame:
        """(point, seq, len, offset): degrees of freedom by depth, in chart order; depths without any are left out."""
        spark = self.arrows.sparkSession
        table = spark.createDataFrame([(d, n) for d, n in dofs.items() if n > 0], "depth int, len int")
        spans = self.strata.join(F.broadcast(table), "depth").select("point", F.col("chart_index").alias("seq"), "len")
        if support is not None:
            spans = spans.join(support.select("point"), "point", "left_semi")
        return sections.atlas(spans)

    def closure_values(self, rows: DataFrame, cells: DataFrame, layout: DataFrame) -> DataFrame:
        return assembly.closure_values(assembly.closure_index(self.arrows, cells, layout), rows)

    def dual_graph(self, max_depth: int = 1) -> DataFrame:
        return lattice.dual_graph(self.arrows, self.cells, max_depth)

    def preallocation(self, layout: DataFrame) -> DataFrame:
        """(row, nnz) of the matrix over a layout's degrees of freedom."""
        index = assembly.closure_index(self.arrows, self.cells, layout).select("cell", "point")
        own = index.join(layout.select("point", F.col("offset").alias("first"), "len"), "point")
        dofs = own.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("len") - 1)).alias("dof"))
        return assembly.pattern(dofs).groupBy("row").agg(F.count("*").alias("nnz"))

    def submesh(self, name: str, value: int) -> tuple[MeshDM, DataFrame]:
        """The labelled stratum's closure with compact ids, and the map from old ids to new."""
        arrows, kept, perm = labels.extract_submesh(self.arrows, self.mesh.labels, name, value)
        types = strata.renumber(self.mesh.cell_types.join(perm, "point", "left_semi"), perm, "point").select("point", "tag", "param")
        coords = strata.renumber(self.mesh.coords.join(perm, "point", "left_semi"), perm, "point").select("point", "xyz")
        return MeshDM(Mesh(arrows, types, coords, kept), self.options), perm

    def label_boundary(self, name: str = "boundary") -> DataFrame:
        """labels with every point that at most one cell touches given value 1, others 2."""
        got = labels.classify_boundary(self.arrows, self.cells, topology.points(self.arrows))
        new = got.select(F.lit(name).alias("name"), "point", F.when(F.col("is_boundary"), 1).otherwise(2).alias("value"))
        return new if self.mesh.labels is None else labels.upsert(self.mesh.labels, new)

    def refined(self, times: int = 1) -> MeshDM:
        mesh = self.mesh
        for _ in range(times):
            mesh, _ = generate.refine(mesh)
        return MeshDM(mesh, self.options)

    def quality(self) -> DataFrame:
        return geometry.quality(generate.cell_coordinates(self.mesh))

    def distribute(self, parts: DataFrame, layers: int | None = None) -> dict[str, DataFrame]:
        return distribution.distribute(self.arrows, parts, self.options.overlap if layers is None else layers)

    def setup(self) -> MeshDM:
        """Refine, reorder and check as the options say."""
        dm = self.refined(self.options.refine) if self.options.refine else self
        if self.options.reorder:
            perm = cut(strata.permutation(dm.strata, self.options.reorder))
            m = dm.mesh
            marks = strata.renumber(m.labels, perm, "point").select("name", "point", "value") if m.labels is not None else None
            dm = MeshDM(Mesh(strata.renumber(m.arrows, perm, "src", "dst").select(*m.arrows.columns), strata.renumber(m.cell_types, perm, "point").select("point", "tag", "param"), strata.renumber(m.coords, perm, "point").select("point", "xyz"), marks), self.options)
        if self.options.check_topology:
            checks.strict(checks.topology_faults(dm.mesh))
        return dm

    def adapt_with_metric(self, metrics: DataFrame, dim: int, rounds: int = 30) -> MeshDM:
        """Refine the cells that have an edge longer than metric_high in metrics(cell, metric) until none has.

        Children inherit their cell's metric, cells without one stay; cells still too long after `rounds` are an error.
        """
        dm, metrics = self, cut(metrics)
        for _ in range(rounds):
            cells = generate.cell_coordinates(dm.mesh).join(metrics, "cell")
            chosen = cut(adapt.select_by_metric(cells, dim, self.options.metric_high, self.options.metric_low).where("action = 'refine'").select(F.col("cell").alias("point")))
            if empty(chosen):
                return dm
            mesh, mapping = generate.refine(dm.mesh, chosen)
            kept = metrics.join(chosen.withColumnRenamed("point", "cell"), "cell", "left_anti").select("cell", "metric")
            metrics = cut(kept.unionByName(mapping.join(metrics.withColumnRenamed("cell", "coarse"), "coarse").select(F.col("fine").alias("cell"), "metric")))
            dm = MeshDM(mesh, self.options)
        raise RuntimeError(f"cells are still too long after {rounds} rounds")
