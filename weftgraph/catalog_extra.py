"""More queries over the driver's tables: edits, labels, slices, constraints, overlap, forests and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ARROWS, CUSTOMER, DEPTHS, HEIGHTS, LOCAL, NATION, OP, ORDER, PART, REGION, bipartite, id_, incidence, line_counts, order_parts, order_ranks, part_labels, query, t, vectors
from .catalog import ship
from .operators import adapt, assembly, constraints, distribution, fvm, generate, geometry, labels, lattice, maps, partition, sections, strata, topology, traverse
from .operators.topology import point

# --- edits and roles


@query(f"with {ARROWS}, gone as (select {id_(3, 'o_custkey')} as src, {id_(6, 'o_orderkey')} as dst from orders where o_orderstatus = 'O') select src, dst from arrows where (src, dst) not in (select (src, dst) from gone)")
def remove_arrows(s, d):
    gone = t(s, d, "orders").where("o_orderstatus = 'O'").select(point(CUSTOMER, F.col("o_custkey")).alias("src"), point(ORDER, F.col("o_orderkey")).alias("dst"))
    return topology.remove(incidence(s, d), gone)


@query(f"with {ARROWS} select src as point from arrows union select dst from arrows")
def all_points(s, d):
    return topology.points(incidence(s, d))


def big_parts(s, d) -> DataFrame:
    return t(s, d, "part").where("p_size = 50").select(point(PART, F.col("p_partkey")).alias("dst"))


BIG = f"big as (select {id_(5, 'p_partkey')} as dst from part where p_size = 50)"


@query(f"with {OP}, {BIG} select src, dst from op where src <> {id_(6, '1')} union all select {id_(6, '1')}, dst from big")
def set_cone(s, d):
    return topology.set_cone(order_parts(s, d), 6 * 10**12 + 2, big_parts(s, d))


@query(f"with {OP}, {BIG} select src, dst from op union select {id_(6, '1')}, dst from big")
def add_cone(s, d):
    return topology.add_cone(order_parts(s, d), 6 * 10**12 + 2, big_parts(s, d))


@query(f"with {OP}, o as (select {id_(6, 'o_orderkey')} as src from orders where o_orderpriority = '1-URGENT') select src, dst from op where dst <> {id_(5, '1')} union all select src, {id_(5, '1')} from o")
def set_support(s, d):
    chain = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(point(ORDER, F.col("o_orderkey")).alias("src"))
    return topology.set_support(order_parts(s, d), 5 * 10**12 + 2, chain)


@query(f"with {OP}, o as (select {id_(6, 'o_orderkey')} as src from orders where o_orderpriority = '1-URGENT') select src, dst from op union select src, {id_(5, '1')} from o")
def add_support(s, d):
    chain = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(point(ORDER, F.col("o_orderkey")).alias("src"))
    return topology.add_support(order_parts(s, d), 5 * 10**12 + 2, chain)


@query(f"with {ARROWS}, r as (select src as point, list(dst order by dst) as n from arrows group by src), o as (select point, n, sum(len(n)) over (order by point) - len(n) as f from r) select point, (f + i)::bigint as position, n[i + 1] as neighbor from (select point, n, f, unnest(range(len(n))) as i from o)")
def frozen_rows(s, d):
    """Every entry of the compressed rows with its place."""
    return topology.frozen(incidence(s, d)).select("point", "offset", F.posexplode("neighbors").alias("i", "neighbor")).select("point", (F.col("offset") + F.col("i")).alias("position"), "neighbor")


# --- traversal and strata


@query(f"""with recursive {ARROWS}, both_ways as (select src as a, dst as b from arrows union select dst, src from arrows), walk(nation, point, depth) as (
  select {id_(2, 'n_nationkey')}, {id_(2, 'n_nationkey')}, 0 from nation union select w.nation, l.b, w.depth + 1 from walk w join both_ways l on l.a = w.point where w.depth < 2)
select nation, point, min(depth)::int as depth from walk group by 1, 2""")
def closure_both_ways(s, d):
    seeds = t(s, d, "nation").select(point(NATION, F.col("n_nationkey")).alias("nation"), point(NATION, F.col("n_nationkey")).alias("point"))
    return traverse.closure_both(incidence(s, d), seeds, keys=["nation"], max_depth=2)


def all_regions(s, d) -> DataFrame:
    return t(s, d, "region").select(point(REGION, F.col("r_regionkey")).alias("point"))


DOWN = f"walk(point, far) as (select {id_(1, 'r_regionkey')}, 0 from region union select a.dst, w.far + 1 from walk w join arrows a on a.src = w.point)"


@query(f"{DEPTHS.replace('walk(point, depth)', 'up(point, depth)').replace('from walk w', 'from up w').replace('from walk group', 'from up group')}, {DOWN} select walk.point, min(far)::int as depth from walk join h on h.point = walk.point where h.depth <= 2 group by walk.point")
def closure_to_depth(s, d):
    a = incidence(s, d)
    return traverse.closure_to_depth(a, strata.depths(a), all_regions(s, d), 2)


@query(f"{HEIGHTS}, down(point, far) as (select {id_(1, 'r_regionkey')}, 0 from region union select a.dst, w.far + 1 from down w join arrows a on a.src = w.point) select down.point, min(far)::int as depth from down join h on h.point = down.point where h.height <= 2 group by down.point")
def closure_to_height(s, d):
    a = incidence(s, d)
    return traverse.closure_to_height(a, strata.heights(a), all_regions(s, d), 2)


@query(f"{HEIGHTS}, d as (select max(height) as top from h), ct as (select {id_(6, 'o_orderkey')} as point, 2 as dim from orders where o_orderstatus = 'F') select h.point, coalesce(ct.dim, d.top - height)::int as dim from h cross join d left join ct on ct.point = h.point")
def dimension_of_points(s, d):
    cell_dim = t(s, d, "orders").where("o_orderstatus = 'F'").select(point(ORDER, F.col("o_orderkey")).alias("point"), F.lit(2).alias("dim"))
    return strata.dimension_of(strata.heights(incidence(s, d)), cell_dim)


@query("select 0::bigint as faults, true as acyclic")
def acyclic(s, d):
    """The incidence graph has no cycle, and the cell-first permutation is a bijection."""
    a = incidence(s, d)
    h = strata.heights(a)
    faults = strata.permutation_faults(strata.permutation(h), topology.points(a))
    return faults.agg(F.count("*").alias("faults")).withColumn("acyclic", F.lit(strata.is_acyclic(a)))


# --- labels


@query(f"select 'size' as name, {id_(5, 'p_partkey')} as point, (case when p_retailprice > 1200 then 99 else p_size end)::int as value from part")
def label_upsert(s, d):
    new = part_labels(s, d, "size", F.lit(99)).join(t(s, d, "part").where("p_retailprice > 1200").select(point(PART, F.col("p_partkey")).alias("point")), "point", "left_semi")
    return labels.upsert(part_labels(s, d, "size", F.col("p_size")), new)


@query(f"select 'size' as name, {id_(5, 'p_partkey')} as point, p_size::int as value from part where p_size <> 7")
def label_clear_value(s, d):
    return labels.clear_value(part_labels(s, d, "size", F.col("p_size")), "size", 7)


@query(f"with {OP} select 'size' as name, {id_(5, 'p_partkey')} as point, p_size::int as value from part where {id_(5, 'p_partkey')} not in (select dst from op)")
def label_clear_points(s, d):
    return labels.clear_points(part_labels(s, d, "size", F.col("p_size")), order_parts(s, d).select(F.col("dst").alias("point")))


@query(f"with {OP} select 'size' as name, {id_(5, 'p_partkey')} as point, p_size::int as value from part where {id_(5, 'p_partkey')} in (select dst from op)")
def label_filtered_to(s, d):
    return labels.filtered_to(part_labels(s, d, "size", F.col("p_size")), order_parts(s, d).select(F.col("dst").alias("point")))


@query(f"select 'size' as name, {id_(5, 'p_partkey')} as point, (case when p_size = 7 then 70 else p_size end)::int as value from part")
def label_remap_value(s, d):
    return labels.remap_value(part_labels(s, d, "size", F.col("p_size")), "size", 7, 70)


@query(f"select p_size::int as value, unnest(list({id_(5, 'p_partkey')} order by p_partkey)) as point from part group by p_size")
def label_strata(s, d):
    return labels.strata_by_value(part_labels(s, d, "size", F.col("p_size")), "size").select("value", F.explode("points").alias("point"))


@query(f"""with recursive {ARROWS}, l as (select {id_(2, 'n_nationkey')} as point, n_regionkey as value from nation), walk(value, point) as (select value, point from l union select w.value, a.dst from walk w join arrows a on a.src = w.point)
select 'region' as name, point, max(value)::int as value from walk group by point""")
def label_propagate_all(s, d):
    """Nations' regions pushed down in ascending order, so that the greatest stays where several meet."""
    own = t(s, d, "nation").select(F.lit("region").alias("name"), point(NATION, F.col("n_nationkey")).alias("point"), F.col("n_regionkey").cast("int").alias("value"))
    return labels.propagate_all(own, incidence(s, d))


def coastal_labels(s, d) -> DataFrame:
    p, key = t(s, d, "part"), point(PART, F.col("p_partkey"))
    one = [("coastal", "p_partkey % 3 = 0", F.lit(1)), ("coastal", "p_partkey % 6 = 0", F.lit(2)), ("coastal", "p_partkey % 5 = 1", F.lit(3)), ("open_boundary_role", "p_partkey % 10 <= 1", F.lit(2)), ("wet_dry", "p_size > 25", F.lit(1)), ("wet_dry", "p_size < 30", F.lit(0))]
    rows = [p.where(c).select(F.lit(n).alias("name"), key.alias("point"), v.alias("value")) for n, c, v in one]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"""with p as (select {id_(5, 'p_partkey')} as point, p_partkey as k, p_size as z from part)
select 'surface_and_bed' as fault, point from p where k % 6 = 0 union all select 'open_boundary_without_role', point from p where k % 5 = 1 and not k % 10 <= 1
union all select 'role_without_open_boundary', point from p where k % 10 <= 1 and k % 5 <> 1 union all select 'wet_and_dry', point from p where z > 25 and z < 30""")
def coastal_violations(s, d):
    return labels.coastal_faults(coastal_labels(s, d))


@query(f"select {id_(5, 'p_partkey')} as point from part where p_partkey % 5 = 1")
def coastal_open_boundary(s, d):
    return labels.coastal(coastal_labels(s, d), "open_boundary")


# --- sections


@query("with x as (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings) select vec_id + 1 as point, vec_id as seq, i::int as idx, (2 * embedding[i + 1]::double)::double as value from x")
def section_scatter(s, d):
    """A buffer with every value doubled, scattered back into slices."""
    v = vectors(s, d)
    layout = sections.atlas(v.select("point", "seq", F.size("values").alias("len")))
    buffer = sections.flat(v).select("index", (F.col("value") * 2).alias("value"))
    return sections.scatter(layout, buffer).select("point", "seq", F.posexplode("values").alias("idx", "value"))


@query("with x as (select vec_id, unnest(range(10)) as i from embeddings) select vec_id + 1 as point, i::int as idx, 0::double as zero, 2.5::double as pad from x")
def section_resize_fill(s, d):
    e = vectors(s, d)
    sizes = e.select("point", F.lit(10).alias("len"))
    zero, pad = (sections.resize(e, sizes, p, 2.5).select("point", F.posexplode("values").alias("idx", p)) for p in ("zero", "pad"))
    return zero.join(pad, ["point", "idx"])


@query(f"with c as (select l_orderkey as seq, count(*) as len from lineitem group by 1), k as (select * from c where seq not in (select o_orderkey from orders where o_orderstatus = 'F')) select {id_(6, 'seq')} as point, seq, len, (sum(len) over (order by seq rows unbounded preceding) - len)::bigint as \"offset\" from k")
def atlas_remove(s, d):
    return sections.remove_points(line_counts(s, d), t(s, d, "orders").where("o_orderstatus = 'F'").select(point(ORDER, F.col("o_orderkey")).alias("point")))


@query(f"select {id_(6, 'l_orderkey')} as point, 'duplicate' as fault from lineitem group by l_orderkey having count(*) > 1 union all select {id_(6, 'l_orderkey')}, 'no_length' from lineitem where l_quantity < 10")
def atlas_violations(s, d):
    spans = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("point"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_quantity") < 10, 0).otherwise(1).alias("len"))
    return sections.atlas_faults(spans)


@query(f"with c as (select o_orderkey as k, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from orders) select {id_(6, 'k')} as point, 4 as len, nullif(n, 0)::int as n from c where n <> 4")
def section_length_violations(s, d):
    layout = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("point"), F.lit(4).alias("len"))
    section = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("values")).select(point(ORDER, F.col("l_orderkey")).alias("point"), "values")
    return sections.length_faults(section, layout)


# --- constraints and assembly


def part_rows(s, d) -> DataFrame:
    return t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point"), F.col("p_partkey").alias("seq"), F.lit(0).alias("idx"), F.col("p_size").cast("double").alias("value"))


def neighbour_terms(s, d) -> DataFrame:
    p = point(PART, F.col("p_partkey"))
    return t(s, d, "part").where("p_partkey % 3 = 0").select(p.alias("point"), F.lit(0).alias("idx"), (p - 1).alias("src_point"), F.lit(0).alias("src_idx"), F.lit(0.5).alias("weight"))


@query(f"select {id_(5, 'a.p_partkey')} as point, (case when a.p_retailprice > 1500 then -1 when a.p_partkey % 3 = 0 and b.p_size is not null then 0.5 * b.p_size else a.p_size end)::double as value from part a left join part b on b.p_partkey = a.p_partkey - 1")
def constraints_in_order(s, d):
    """Hanging values first, fixed ones second."""
    on = t(s, d, "part").where("p_retailprice > 1500").select(point(PART, F.col("p_partkey")).alias("point"), F.lit(0).alias("idx"), F.lit(-1.0).alias("value"))
    return constraints.apply_all(part_rows(s, d), neighbour_terms(s, d), on).select("point", "value")


@query(f"select distinct {id_(5, 'l_partkey')} as point, (l_linenumber - 1)::int as idx from lineitem where l_linenumber > 1")
def constraint_violations(s, d):
    on = t(s, d, "lineitem").select(point(PART, F.col("l_partkey")).alias("point"), (F.col("l_linenumber") - 1).cast("int").alias("idx")).distinct()
    return constraints.faults(part_rows(s, d), on)


@query(f"select {id_(5, 'p_partkey')} as point, (p_size + coalesce((select sum(l_quantity) from lineitem where l_partkey = p_partkey), 0))::double as value from part")
def add_closure(s, d):
    add = t(s, d, "lineitem").select(point(PART, F.col("l_partkey")).alias("point"), F.lit(0).alias("idx"), F.col("l_quantity").cast("double").alias("value"))
    return assembly.set_closure(part_rows(s, d), add, add=True).select("point", "value")


@query(f"select {id_(5, 'p_partkey')} as point, coalesce((select max(l_quantity) from lineitem where l_partkey = p_partkey), p_size)::double as value from part")
def set_closure(s, d):
    new = t(s, d, "lineitem").select(point(PART, F.col("l_partkey")).alias("point"), F.lit(0).alias("idx"), F.col("l_quantity").cast("double").alias("value"))
    return assembly.set_closure(part_rows(s, d), new).select("point", "value")


@query(f"with {OP}, z as (select op.src as cell, op.dst as point, p_size::double as value from op join part on {id_(5, 'p_partkey')} = op.dst) select cell, point, (row_number() over (partition by cell order by point) - 1)::bigint as slot, value from z")
def closure_gather(s, d):
    op = order_parts(s, d)
    index = assembly.closure_index(op, op.select(F.col("src").alias("point")).distinct(), part_rows(s, d).select("point", F.lit(1).alias("len")))
    return assembly.closure_values(index, part_rows(s, d)).select("cell", "point", F.col("slot").cast("long").alias("slot"), "value")


@query("select l_partkey as dof, sum(l_quantity)::double as value from lineitem group by 1")
def assemble_vector(s, d):
    return assembly.assemble_vector(t(s, d, "lineitem").select(F.col("l_partkey").alias("dof"), F.col("l_quantity").cast("double").alias("value")))


@query("select l_suppkey as row, l_partkey as col, sum(l_quantity)::double as value from lineitem group by 1, 2")
def assemble_matrix(s, d):
    return assembly.assemble_matrix(t(s, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("double").alias("value")))


@query("select p_partkey as idx, (2.0 * p_size + coalesce((select sum(l_quantity) from lineitem where l_partkey = p_partkey), 0))::double as value from part")
def axpy(s, d):
    x = t(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("value"))
    y = t(s, d, "lineitem").select(F.col("l_partkey").alias("idx"), F.col("l_quantity").cast("double").alias("value"))
    return assembly.axpy(2.0, x, y)


@query("with sp as (select distinct l_orderkey as c, l_suppkey as s from lineitem), p as (select distinct a.s as row, b.s as col from sp a join sp b on a.c = b.c), r as (select row, count(*) as n, min(col) as first_col, max(col) as last_col from p group by 1) select row, first_col, last_col, n::int as n, (sum(n) over (order by row rows unbounded preceding) - n)::bigint as row_ptr from r")
def csr_rows(s, d):
    dofs = t(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("dof")).distinct()
    return assembly.csr(assembly.pattern(dofs)).select("row", F.array_min("cols").alias("first_col"), F.array_max("cols").alias("last_col"), F.size("cols").alias("n"), "row_ptr")


# --- overlap, forests and partitions


def held(s, d) -> DataFrame:
    return traverse.closure(order_parts(s, d), order_ranks(s, d).select(F.col("part").alias("rank"), F.col("cell").alias("point")), keys=["rank"]).select("rank", "point")


PAIRS = f"{LOCAL}, pairs as (select a.rank, a.point, b.rank as neighbor from local a join local b on a.point = b.point and a.rank <> b.rank)"


@query(f"with {PAIRS} select rank, point, neighbor, (case when rank < neighbor then point + 7 end)::bigint as remote_point from pairs")
def overlap_resolve(s, d):
    links = distribution.overlap_links(held(s, d))
    return distribution.resolve(links.withColumn("remote_point", F.lit(None).cast("long")), links.where("rank < neighbor").withColumn("remote_point", F.col("point") + 7))


@query(f"with {PAIRS} select rank, point, neighbor, (case when rank > neighbor then point end)::bigint as remote_point from pairs")
def overlap_add_links(s, d):
    """Links added again, those to lesser ranks with their remote ids."""
    links = distribution.overlap_links(held(s, d))
    bare = links.withColumn("remote_point", F.lit(None).cast("long"))
    return distribution.add_links(bare, links.where("rank > neighbor").withColumn("remote_point", F.col("point")))


@query(f"with {PAIRS} select rank, point, neighbor, 'no_mirror' as fault from pairs where rank = 0")
def overlap_violations(s, d):
    """Links to rank 0 are left out, so those of rank 0 have no mirror."""
    links = distribution.overlap_links(held(s, d)).withColumn("remote_point", F.lit(None).cast("long"))
    return distribution.overlap_faults(links.where("neighbor <> 0"))


@query(f"with {LOCAL}, w as (select point, min(rank) as owner from local group by 1) select owner as rank, local.point as leaf, rank as remote_rank, local.point as remote_point from local join w on w.point = local.point where rank <> owner")
def forest_invert(s, d):
    return distribution.invert(distribution.forest(distribution.ownership(held(s, d))))


@query(f"with {LOCAL}, w as (select point, min(rank) as owner from local group by 1) select rank, local.point, p_size::double as value from local join w on w.point = local.point join part on {id_(5, 'p_partkey')} = local.point where rank <> owner")
def forest_migrate(s, d):
    """Owners' values of parts moved to the ranks that hold them as ghosts."""
    own = distribution.ownership(held(s, d))
    values = own.where("not is_ghost").join(part_rows(s, d), "point").select("rank", "point", "value")
    return distribution.migrate(values, distribution.forest(own))


@query(f"with {LOCAL}, w as (select point, min(rank) as owner from local group by 1) select rank, local.point as leaf, owner as remote_rank, local.point as remote_point from local join w on w.point = local.point join part on {id_(5, 'p_partkey')} = local.point where rank <> owner and p_size <= 10")
def forest_restrict(s, d):
    small = t(s, d, "part").where("p_size <= 10").select(point(PART, F.col("p_partkey")).alias("point"))
    return distribution.restrict_forest(distribution.forest(distribution.ownership(held(s, d))), small)


@query("select l_partkey as slave, count(distinct l_suppkey)::bigint as masters from lineitem group by 1 having count(distinct l_suppkey) > 1")
def periodic_violations(s, d):
    return distribution.periodic_conflicts(t(s, d, "lineitem").select(F.col("l_partkey").alias("slave"), F.col("l_suppkey").alias("master")))


@query(f"with {OP} select p as vertex, count(*) as degree from (select src as p from op union all select dst from op) group by 1")
def graph_degrees(s, d):
    return partition.degrees(bipartite(s, d)[0])


@query("select l_orderkey as u, l_partkey as v, 'order' as fault from lineitem where l_orderkey >= l_partkey union all select l_orderkey, l_partkey, 'repeated' from lineitem group by 1, 2 having count(*) > 1")
def edge_violations(s, d):
    return partition.edge_faults(t(s, d, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")))


@query("select l_partkey as vertex, min(l_suppkey) as value from lineitem group by 1")
def reconcile_decisions(s, d):
    return partition.least_decision(t(s, d, "lineitem").select(F.col("l_partkey").alias("vertex"), F.col("l_suppkey").alias("value")), "vertex")


@query(f"with {OP} select least(a.src, b.src) as u, greatest(a.src, b.src) as v, count(*) as weight from op a join op b on a.dst = b.dst and a.src < b.src group by 1, 2")
def shared_part_edges(s, d):
    return lattice.adjacency_edges(order_parts(s, d), "dst", "src")


@query(f"with {PAIRS} select rank, point, neighbor from pairs where not (rank = 0 and neighbor = 1)")
def overlap_remove_links(s, d):
    links = distribution.overlap_links(held(s, d))
    return distribution.remove_links(links, links.where("rank = 0 and neighbor = 1"))


@query(f"with {PAIRS} select rank, point, neighbor from pairs where neighbor in (1, 3)")
def overlap_retain(s, d):
    return distribution.retain_neighbors(distribution.overlap_links(held(s, d)), [1, 3])


RANKED = f"v as (select distinct (l_orderkey % 4)::int as rank, {id_(5, 'l_partkey')} as base, {id_(4, 'l_suppkey')} as cap from lineitem)"


@query(f"with {RANKED} select distinct h.rank, v.base, v.cap from v join (select distinct rank, base from v) h on h.base = v.base")
def complete_stack(s, d):
    """Suppliers over the parts that a rank's lines have, those of other ranks' lines imported."""
    v = t(s, d, "lineitem").select((F.col("l_orderkey") % 4).cast("int").alias("rank"), point(PART, F.col("l_partkey")).alias("base"), point(4, F.col("l_suppkey")).alias("cap")).distinct()
    links = distribution.overlap_links(v.select("rank", F.col("base").alias("point")))
    return distribution.complete_stack(v, links)


@query(f"with v as (select distinct (l_orderkey % 4)::int as rank, {id_(5, 'l_partkey')} as point from lineitem), w as (select {id_(5, 'l_partkey')} as point, sum(l_quantity)::double as value from lineitem group by 1) select rank, point, 0::int as idx, value from v join w using (point)")
def complete_sum(s, d):
    """Each rank's sums of its own lines, completed to the sums over all ranks."""
    own = t(s, d, "lineitem").groupBy((F.col("l_orderkey") % 4).cast("int").alias("rank"), point(PART, F.col("l_partkey")).alias("point")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return distribution.complete_reduced(own.select("rank", "point", F.lit(0).alias("idx"), "value"))


@query(f"with {OP} select (o_custkey % 3)::int as rank, src, dst from op join orders on {id_(6, 'o_orderkey')} = src where o_orderpriority = '1-URGENT'")
def fetch_cones(s, d):
    ask = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 3).cast("int").alias("rank"), point(ORDER, F.col("o_orderkey")).alias("point"))
    return distribution.fetch(order_parts(s, d), ask)


CO = f"co as (select {id_(3, 'o_custkey')} as c, {id_(6, 'o_orderkey')} as o, (o_custkey % 3)::int as rank from orders)"


@query(f"with {OP}, {CO} select rank, c as point, 0::int as depth from co union select rank, o, 1 from co union select rank, dst, 2 from co join op on op.src = co.o")
def closure_completed(s, d):
    """Closures of customers whose ranks hold only the arrows to orders."""
    near = t(s, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("rank"), point(CUSTOMER, F.col("o_custkey")).alias("src"), point(ORDER, F.col("o_orderkey")).alias("dst"))
    local = near.unionByName(order_parts(s, d).withColumn("rank", F.lit(3)).select("rank", "src", "dst"))
    return distribution.closure_completed(local, near.select("rank", F.col("src").alias("point")))


# --- adaptation and transfers


@query(f"with {OP}, {CO} select distinct c as src, dst from co join op on op.src = co.o")
def coarsen_cells(s, d):
    """A customer's orders merged into one cell over their parts."""
    o = t(s, d, "orders").select(point(CUSTOMER, F.col("o_custkey")).alias("coarse"), point(ORDER, F.col("o_orderkey")).alias("src"))
    return adapt.coarsen(order_parts(s, d).join(o, "src").select("coarse", "dst"))


@query(f"with {OP}, {CO}, p as (select src from op union select dst from op) select c as coarse, o as point, 'fine' as fault from co where o not in (select src from p) union all select distinct c, o + 7 * 1000000000000, 'cone' from co")
def coarsen_violations(s, d):
    """Orders without lines aren't points of the fine topology, nor are the cones' points here."""
    o = t(s, d, "orders").select(point(CUSTOMER, F.col("o_custkey")).alias("coarse"), point(ORDER, F.col("o_orderkey")).alias("fine"))
    return adapt.coarsen_faults(order_parts(s, d), o, o.select("coarse", (F.col("fine") + 7 * 10**12).alias("dst")))


@query("select l_orderkey * 100 + l_linenumber as point, p_size::int as value from lineitem join part on p_partkey = l_partkey")
def transfer_shared_labels(s, d):
    """Parts' sizes copied to the lines that have the part's key as their label."""
    source = part_labels(s, d, "key", F.col("p_partkey"))
    target = t(s, d, "lineitem").select(F.lit("key").alias("name"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("point"), F.col("l_partkey").alias("value"))
    return adapt.transfer_labels(part_labels(s, d, "size", F.col("p_size")).select("point", "value"), source, target, "key")


@query("with x as (select l_quantity * 2 as a, l_discount * 50 as k, l_tax as h from lineitem) select case when a > 75 or k > 4 or h < 0.00000001 then 'refine' when a <= 35 and k <= 1.5 and h >= 0.0001 then 'coarsen' else 'keep' end as action, count(*) as cells from x group by 1")
def fvm_select(s, d):
    x = t(s, d, "lineitem").select((F.col("l_quantity") * 2).alias("non_orthogonality"), (F.col("l_discount") * 50).alias("skewness"), F.col("l_tax").alias("length"))
    return adapt.select_by_fvm(x).groupBy("action").agg(F.count("*").alias("cells"))


@query("select 'hexahedron' as tag, 192::bigint as cells, 1.0::double as measure union all select 'prism', 192, 1.0 union all select 'tetrahedron', 8, 0.166666667")
def refine_solids(s, d):
    """A box of hexahedra, the same box as prisms, and the reference tetrahedron, each refined once."""
    ship(s)
    boxes = generate.hex_mesh(s, 4, 3, 2)
    prisms = generate.extrude(generate.triangulated(generate.quad_mesh(s, 4, 3)), [0.0, 0.5, 1.0])
    out = None
    for mesh in (boxes, prisms, generate.reference_cell(s, "tetrahedron")):
        fine, _ = generate.refine(mesh)
        one = generate.cell_coordinates(fine).groupBy("tag").agg(F.count("*").alias("cells"), F.round(F.sum(geometry.measure(F.col("tag"), F.col("pts"))), 9).alias("measure"))
        out = one if out is None else out.unionByName(one)
    return out


# --- reference maps and finite volumes


def part_quads(s, d) -> DataFrame:
    """A quadrilateral for each part, wider with its size and slanted."""
    z = F.col("p_size").cast("double")
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    pts = F.array(corner(F.lit(0), F.lit(0)), corner(z, F.lit(0)), corner(z + 2, F.lit(4)), corner(F.lit(0), F.lit(4)))
    return t(s, d, "part").select("p_partkey", F.lit("quadrilateral").alias("tag"), pts.alias("pts"), F.array(F.lit(0.25), F.lit(0.5)).alias("at"))


@query("select p_partkey, round(0.25 * p_size + 0.25, 9)::double as x, 2::double as y, round(p_size + 1, 9)::double as xr, 0.5::double as xs, 0::double as yr, 4::double as ys from part")
def reference_to_physical(s, d):
    """Places and Jacobians at (1/4, 1/2)."""
    got = maps.jacobian(maps.reference_to_physical(part_quads(s, d)))
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 9) + 0.0
    return got.select("p_partkey", at("x", 0).alias("x"), at("x", 1).alias("y"), *[at("jacobian", k).alias(n) for k, n in enumerate(("xr", "xs", "yr", "ys"))])


@query("select p_partkey, 0.25::double as r, 0.5::double as s from part")
def physical_to_reference(s, d):
    got = maps.physical_to_reference(maps.reference_to_physical(part_quads(s, d)), out="back")
    return got.select("p_partkey", F.round(F.get("back", F.lit(0)), 9).alias("r"), F.round(F.get("back", F.lit(1)), 9).alias("s"))


def bounded_faces(s, d) -> DataFrame:
    """Lines as faces; first lines are on the boundary, on a branch named by the order's status."""
    phi = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("cell"), (F.col("o_custkey") % 100).cast("double").alias("phi")).unionByName(t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("cell"), F.col("p_size").cast("double").alias("phi")))
    first = F.col("l_linenumber") == 1
    f = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    f = f.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("face"), point(ORDER, F.col("l_orderkey")).alias("owner"), F.when(~first, point(PART, F.col("l_partkey"))).alias("neighbor"), (F.col("l_quantity") - 25).cast("double").alias("mass_flux"), F.col("l_linenumber").cast("double").alias("area"), F.lit(2.0).alias("distance"), F.when(first, F.col("o_orderstatus")).alias("branch"))
    return fvm.joined(f, phi)


CONDITIONS = {"F": ("dirichlet", 10.0), "O": ("neumann", 1.5), "P": ("robin", 2.0, 4.0, 8.0)}
BOUNDED = f"""f as (select {id_(6, 'l_orderkey')} as o, case when l_linenumber <> 1 then {id_(5, 'l_partkey')} end as n, (l_quantity - 25)::double as m, (o_custkey % 100)::double as a, p_size::double as b, l_linenumber::double as area, o_orderstatus as br
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
g as (select *, case when n is not null then b when br = 'F' then 10 when br = 'O' then a else (8 - 4 * a) / 2 end as other, case when n is not null then (b - a) / 2 when br = 'F' then (10 - a) / 2 when br = 'O' then 1.5 else (8 - 2 * a) / 4 end as slope from f),
x as (select o, n, m * case when m >= 0 then a else other end as c, -0.5 * slope * area as d, case when n is null and br = 'P' then 0.5 * 2 * area else 0 end as s from g)"""


@query(f"with {BOUNDED} select cell, sum(c)::double as convective, sum(d)::double as diffusive, sum(c + d)::double as residual, sum(s)::double as source from (select o as cell, c, d, s from x union all select n, -c, -d, 0 from x where n is not null) group by 1")
def fv_system(s, d):
    return fvm.assemble_system(bounded_faces(s, d), CONDITIONS, CONDITIONS, 0.5)


@query("select l_orderkey * 100 + 1 as face, 'unsupported_branch' as fault from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1 and o_orderstatus = 'P'")
def fv_system_violations(s, d):
    some = {k: v for k, v in CONDITIONS.items() if k != "P"}
    return fvm.system_faults(bounded_faces(s, d), some, CONDITIONS)
