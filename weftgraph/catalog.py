"""Queries over the driver's tables, by name, with the SQL that gives the same rows.

The tables' foreign keys form the incidence graph region, nation, customer and supplier, orders, part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import adapt, assembly, constraints, distribution, fvm, generate, geometry, labels, lattice, partition, sections, strata, topology, traverse
from .operators.topology import point
from .plans.loops import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(1, 7)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path names it."""
    import os
    from pathlib import Path

    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def incidence(spark: SparkSession, d: str) -> DataFrame:
    """arrows(src, dst) of all six tables, one for each pair."""
    pairs = [
        t(spark, d, "nation").select(point(REGION, F.col("n_regionkey")).alias("src"), point(NATION, F.col("n_nationkey")).alias("dst")),
        t(spark, d, "customer").select(point(NATION, F.col("c_nationkey")).alias("src"), point(CUSTOMER, F.col("c_custkey")).alias("dst")),
        t(spark, d, "supplier").select(point(NATION, F.col("s_nationkey")).alias("src"), point(SUPPLIER, F.col("s_suppkey")).alias("dst")),
        t(spark, d, "orders").select(point(CUSTOMER, F.col("o_custkey")).alias("src"), point(ORDER, F.col("o_orderkey")).alias("dst")),
        order_parts(spark, d),
        t(spark, d, "lineitem").select(point(SUPPLIER, F.col("l_suppkey")).alias("src"), point(PART, F.col("l_partkey")).alias("dst")).distinct(),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("src"), point(PART, F.col("l_partkey")).alias("dst")).distinct()


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(point(SUPPLIER, F.col("l_suppkey")).alias("src"), point(PART, F.col("l_partkey")).alias("dst")).distinct()


def id_(kind: int, key: str) -> str:
    return f"({kind * 10**12 + 1} + {key})::bigint"


ARROWS = f"""arrows as (
  select {id_(1, 'n_regionkey')} as src, {id_(2, 'n_nationkey')} as dst from nation
  union select {id_(2, 'c_nationkey')}, {id_(3, 'c_custkey')} from customer
  union select {id_(2, 's_nationkey')}, {id_(4, 's_suppkey')} from supplier
  union select {id_(3, 'o_custkey')}, {id_(6, 'o_orderkey')} from orders
  union select {id_(6, 'l_orderkey')}, {id_(5, 'l_partkey')} from lineitem
  union select {id_(4, 'l_suppkey')}, {id_(5, 'l_partkey')} from lineitem)"""
OP = f"op as (select distinct {id_(6, 'l_orderkey')} as src, {id_(5, 'l_partkey')} as dst from lineitem)"
HEIGHTS = f"""with recursive {ARROWS}, walk(point, height) as (
  select distinct src, 0 from arrows where src not in (select dst from arrows)
  union select a.dst, w.height + 1 from walk w join arrows a on a.src = w.point),
h as (select point, max(height)::int as height from walk group by point)"""
DEPTHS = f"""with recursive {ARROWS}, walk(point, depth) as (
  select distinct dst, 0 from arrows where dst not in (select src from arrows)
  union select a.src, w.depth + 1 from walk w join arrows a on a.dst = w.point),
h as (select point, max(depth)::int as depth from walk group by point)"""


# --- primitives


@query(f"with {ARROWS} select src as point, count(*) as degree from arrows group by src")
def cone_degree(s, d):
    return topology.cone_degree(incidence(s, d))


@query(f"with {ARROWS} select dst as point, count(*) as degree from arrows group by dst")
def support_degree(s, d):
    return topology.support_degree(incidence(s, d))


@query(f"select {id_(6, 'l_orderkey')} as src, {id_(5, 'l_partkey')} as dst, max(l_linenumber) as seq, max(struct_pack(a := l_linenumber, b := l_quantity)).b as payload from lineitem group by 1, 2")
def arrow_upsert(s, d):
    a = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("src"), point(PART, F.col("l_partkey")).alias("dst"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("payload"))
    return topology.upsert(a, "seq")


@query(f"with {ARROWS} select point, bool_or(b) as is_base, bool_or(c) as is_cap from (select src as point, true as b, false as c from arrows union all select dst, false, true from arrows) group by point")
def point_roles(s, d):
    return topology.roles(incidence(s, d))


@query(f"with {ARROWS} select src, dst from arrows where src in (select {id_(3, 'c_custkey')} from customer where c_mktsegment = 'BUILDING')")
def restrict_base(s, d):
    seeds = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(point(CUSTOMER, F.col("c_custkey")).alias("point"))
    return topology.restrict_base(incidence(s, d), seeds)


@query(f"with {ARROWS} select src, dst from arrows where dst in (select {id_(5, 'p_partkey')} from part where p_size <= 10)")
def restrict_cap(s, d):
    return topology.restrict_cap(incidence(s, d), t(s, d, "part").where("p_size <= 10").select(point(PART, F.col("p_partkey")).alias("point")))


@query(f"with {ARROWS}, gone as (select {id_(6, 'o_orderkey')} as p from orders where o_orderstatus = 'F') select src, dst from arrows where src not in (select p from gone) and dst not in (select p from gone)")
def remove_points(s, d):
    gone = t(s, d, "orders").where("o_orderstatus = 'F'").select(point(ORDER, F.col("o_orderkey")).alias("point"))
    return topology.remove_points(incidence(s, d), gone)


@query(f"with {OP}, q as (select {id_(6, 'o_orderkey')} as src, {id_(5, 'o_orderkey % 100')} as dst from orders) select q.src, q.dst, op.src is not null as found from q left join op on q.src = op.src and q.dst = op.dst")
def has_arrow(s, d):
    pairs = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("src"), point(PART, F.col("o_orderkey") % 100).alias("dst"))
    return topology.has(order_parts(s, d), pairs)


@query(f"with {ARROWS}, r as (select src as point, count(*) as n, min(dst) as first from arrows group by src) select point, first, (sum(n) over (order by point rows unbounded preceding) - n)::bigint as \"offset\" from r")
def frozen_csr(s, d):
    return topology.frozen(incidence(s, d)).select("point", F.get("neighbors", F.lit(0)).alias("first"), "offset")


# --- recursion and strata


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Histogram of heights, the longest path from a source."""
    return strata.heights(incidence(s, d)).groupBy("height").agg(F.count("*").alias("points"))


QUERIES["height_histogram"] = flagship
SQL["height_histogram"] = f"{HEIGHTS} select height, count(*) as points from h group by height"


@query(f"{HEIGHTS} select point, height from h")
def strata_height(s, d):
    return strata.heights(incidence(s, d))


@query(f"{DEPTHS} select point, depth from h")
def strata_depth(s, d):
    return strata.depths(incidence(s, d))


@query(f"{HEIGHTS} select max(height) as diameter from h")
def diameter(s, d):
    return strata.diameter(strata.heights(incidence(s, d)))


@query(f"{HEIGHTS} select point, height, (row_number() over (order by height, point) - 1)::bigint as chart_index from h")
def chart_index(s, d):
    return topology.dense_index(strata.heights(incidence(s, d)), ["height", "point"], "chart_index")


@query(f"{HEIGHTS} select point, height, (row_number() over (partition by height order by point) - 1)::bigint as id from h")
def stratum_numbering(s, d):
    return strata.stratum_numbering(strata.heights(incidence(s, d)))


@query(f"{HEIGHTS} select point, (point // 1000000000000 % 2)::int as owner, height, (row_number() over (partition by height order by point // 1000000000000 % 2, point) - 1)::bigint as id from h")
def stratum_numbering_global(s, d):
    h = strata.heights(incidence(s, d))
    return strata.stratum_numbering_global(h, h.select("point", (F.floor(F.col("point") / 10**12) % 2).cast("int").alias("owner")))


@query(f"{DEPTHS} select point, row_number() over (order by depth, point)::bigint as new_id from h")
def permutation_vertex_first(s, d):
    return strata.permutation(strata.depths(incidence(s, d)), "vertex_first")


@query(f"with recursive {ARROWS}, walk(region, point, depth) as (select {id_(1, 'r_regionkey')}, {id_(1, 'r_regionkey')}, 0 from region union select w.region, a.dst, w.depth + 1 from walk w join arrows a on a.src = w.point) select region, point, min(depth)::int as depth from walk group by 1, 2")
def closure_region(s, d):
    """The closure of every region."""
    seeds = t(s, d, "region").select(point(REGION, F.col("r_regionkey")).alias("region"), point(REGION, F.col("r_regionkey")).alias("point"))
    return traverse.closure(incidence(s, d), seeds, keys=["region"])


@query(f"with recursive {ARROWS}, walk(point, depth) as (select {id_(5, 'p_partkey')}, 0 from part where p_size = 1 union select a.src, w.depth + 1 from walk w join arrows a on a.dst = w.point) select point, min(depth)::int as depth from walk group by point")
def star_part(s, d):
    return traverse.star(incidence(s, d), t(s, d, "part").where("p_size = 1").select(point(PART, F.col("p_partkey")).alias("point")))


@query(f"with recursive {ARROWS}, walk(region, point, depth) as (select {id_(1, 'r_regionkey')}, {id_(1, 'r_regionkey')}, 0 from region union select w.region, a.dst, w.depth + 1 from walk w join arrows a on a.src = w.point where w.depth < 3) select region, point, min(depth)::int as depth from walk group by 1, 2")
def traverse_to_depth(s, d):
    seeds = t(s, d, "region").select(point(REGION, F.col("r_regionkey")).alias("region"), point(REGION, F.col("r_regionkey")).alias("point"))
    return traverse.closure(incidence(s, d), seeds, keys=["region"], max_depth=3)


@query(f"with {OP}, p as (select {id_(6, 'o_orderkey')} as a, lead({id_(6, 'o_orderkey')}) over (partition by o_custkey order by o_orderkey) as b from orders) select p.a, p.b, x.dst as point from p join op x on x.src = p.a join op y on y.src = p.b and y.dst = x.dst")
def meet_orders(s, d):
    from pyspark.sql import Window

    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("a"), point(ORDER, nxt).alias("b")).where("b is not null")
    return lattice.meet(order_parts(s, d), pairs)


@query(f"""with up as (
  select distinct l_partkey as p, n_regionkey as r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  union select distinct l_partkey, n_regionkey from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
select {id_(5, 'x.p')} as a, {id_(5, 'y.p')} as b, {id_(1, 'x.r')} as point from up x join up y on y.p = x.p + 1 and y.r = x.r""")
def join_parts(s, d):
    """Pairs are every part with its successor; tops of what stands above both."""
    p = t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("a"), point(PART, F.col("p_partkey") + 1).alias("b"))
    return lattice.join(incidence(s, d), p)


@query(f"with {ARROWS}, short as (select {id_(1, 'n_regionkey')} as src, {id_(3, 'c_custkey')} as dst from customer join nation on c_nationkey = n_nationkey) select src, dst from short")
def redundant_arrows(s, d):
    return lattice.redundant(with_shortcuts(s, d))


@query(f"with {ARROWS} select src, dst from arrows")
def transitive_reduction(s, d):
    return lattice.transitive_reduction(with_shortcuts(s, d))


def with_shortcuts(s, d):
    short = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(point(REGION, F.col("n_regionkey")).alias("src"), point(CUSTOMER, F.col("c_custkey")).alias("dst"))
    return incidence(s, d).unionByName(short)


@query(f"with recursive {ARROWS}, walk(src, dst) as (select src, dst from arrows union select w.src, a.dst from walk w join arrows a on a.src = w.dst) select src, dst from walk where (src, dst) not in (select (src, dst) from arrows)")
def closure_edges(s, d):
    return lattice.closure_edges(incidence(s, d))


# --- adjacency


@query(f"with {OP} select a.src as u, b.src as v, count(*) as weight from op a join op b on a.dst = b.dst and a.src < b.src group by 1, 2")
def cell_adjacency(s, d):
    return lattice.adjacency_edges(order_parts(s, d), "dst", "src")


@query(f"with {OP} select a.dst as u, b.dst as v, count(*) as weight from op a join op b on a.src = b.src and a.dst < b.dst group by 1, 2")
def vertex_adjacency(s, d):
    return lattice.adjacency_edges(order_parts(s, d), "src", "dst")


@query(f"""with sp as (select distinct {id_(4, 'l_suppkey')} as c, l_partkey as b from lineitem), e as (select x.c as point, y.c as n, count(*) as w from sp x join sp y on x.b = y.b and x.c <> y.c group by 1, 2),
g as (select c as point, count(e.n) as degree, coalesce(sum(w), 0)::bigint as weight from (select distinct c from sp) left join e on e.point = c group by 1)
select point, degree::int as degree, weight, (sum(degree) over (order by point rows unbounded preceding) - degree)::bigint as xadj from g""")
def dual_graph_csr(s, d):
    sp = supplier_parts(s, d)
    got = lattice.dual_graph(sp, sp.select(F.col("src").alias("point")).distinct())
    return got.select("point", F.size("neighbors").alias("degree"), F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"), "xadj")


@query(f"select {id_(2, 'c_nationkey')} as base, {id_(6, 'o_orderkey')} as cap, (c_custkey % 7 + o_orderkey % 5)::bigint as payload from orders join customer on o_custkey = c_custkey")
def stack_compose(s, d):
    low = t(s, d, "customer").select(point(NATION, F.col("c_nationkey")).alias("base"), point(CUSTOMER, F.col("c_custkey")).alias("cap"), (F.col("c_custkey") % 7).alias("payload"))
    high = t(s, d, "orders").select(point(CUSTOMER, F.col("o_custkey")).alias("base"), point(ORDER, F.col("o_orderkey")).alias("cap"), (F.col("o_orderkey") % 5).alias("payload"))
    return lattice.compose(low, high, F.col("p") + F.col("q"))


# --- labels


def part_labels(s, d, name: str, value: Column) -> DataFrame:
    return t(s, d, "part").select(F.lit(name).alias("name"), point(PART, F.col("p_partkey")).alias("point"), value.cast("int").alias("value"))


@query(f"select {id_(5, 'p_partkey')} as point from part where p_size = 7")
def label_stratum(s, d):
    return labels.stratum(part_labels(s, d, "size", F.col("p_size")), "size", 7)


@query("select p_size as value, count(*) as size from part group by 1")
def label_values(s, d):
    return labels.values(part_labels(s, d, "size", F.col("p_size")), "size")


@query(f"select p_size as value, {id_(5, 'p_partkey')} as point from part where p_size >= 10 and p_size < 20")
def label_range(s, d):
    return labels.in_range(part_labels(s, d, "size", F.col("p_size")), "size", 10, 20)


def two_labels(s, d):
    return part_labels(s, d, "f", (F.col("p_size") <= 10).cast("int")), part_labels(s, d, "f", (F.col("p_retailprice") > 1200).cast("int"))


@query(f"select {id_(5, 'p_partkey')} as point from part where p_size <= 10 or p_retailprice > 1200")
def label_union(s, d):
    return labels.union(*two_labels(s, d), "f", 1)


@query(f"select {id_(5, 'p_partkey')} as point from part where p_size <= 10 and p_retailprice > 1200")
def label_intersection(s, d):
    return labels.intersection(*two_labels(s, d), "f", 1)


@query(f"select {id_(5, 'p_partkey')} as point from part where p_size <= 10 and not p_retailprice > 1200")
def label_difference(s, d):
    return labels.difference(*two_labels(s, d), "f", 1)


@query(f"""with recursive {ARROWS}, l as (select {id_(2, 'n_nationkey')} as point, n_regionkey as value from nation), walk(point) as (select point from l where value = 2 union select a.dst from walk w join arrows a on a.src = w.point)
select 'region' as name, point, 2::int as value from walk union all select 'region', point, value from l where point not in (select point from walk)""")
def label_propagate_closure(s, d):
    own = t(s, d, "nation").select(F.lit("region").alias("name"), point(NATION, F.col("n_nationkey")).alias("point"), F.col("n_regionkey").cast("int").alias("value"))
    return labels.propagate(own, incidence(s, d), "region", 2)


@query(f"""with {OP}, n as (select dst as point, count(*) as cells from op group by 1) select {id_(5, 'p_partkey')} as point, coalesce(cells, 0)::bigint as cells, coalesce(cells, 0) <= 1 as is_boundary from part left join n on point = {id_(5, 'p_partkey')}""")
def boundary_parts(s, d):
    op = order_parts(s, d)
    return labels.classify_boundary(op, op.select(F.col("src").alias("point")).distinct(), t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point")))


@query(f"""with recursive {ARROWS}, walk(point) as (select {id_(2, 'n_nationkey')} from nation where n_regionkey = 1 union select a.dst from walk w join arrows a on a.src = w.point),
m as (select point, row_number() over (order by point)::bigint as new_id from walk) select x.new_id as src, y.new_id as dst from arrows join m x on x.point = src join m y on y.point = dst""")
def extract_submesh(s, d):
    own = t(s, d, "nation").select(F.lit("region").alias("name"), point(NATION, F.col("n_nationkey")).alias("point"), F.col("n_regionkey").cast("int").alias("value"))
    return labels.extract_submesh(incidence(s, d), own, "region", 1)[0]


# --- sections


def line_counts(s, d) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("len")).select(point(ORDER, F.col("l_orderkey")).alias("point"), F.col("l_orderkey").alias("seq"), "len")


@query(f"with c as (select l_orderkey as seq, count(*) as len from lineitem group by 1) select {id_(6, 'seq')} as point, seq, len, (sum(len) over (order by seq rows unbounded preceding) - len)::bigint as \"offset\" from c")
def atlas_offsets(s, d):
    return sections.atlas(line_counts(s, d))


@query(f"with c as (select l_orderkey as k, count(*) as len from lineitem group by 1), o as (select {id_(6, 'k')} as point, c_nationkey as owner, len from c join orders on o_orderkey = k join customer on c_custkey = o_custkey) select point, owner, len, (sum(len) over (order by owner, point rows unbounded preceding) - len)::bigint as global_offset from o")
def global_numbering(s, d):
    return strata.global_offsets(line_counts(s, d), order_owners(s, d))


def order_owners(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(point(ORDER, F.col("o_orderkey")).alias("point"), F.col("c_nationkey").alias("owner"))


@query(f"""with c as (select l_orderkey as k, count(*) as len, count(distinct case when l_quantity > 45 then l_linenumber end) as fixed from lineitem group by 1), o as (select {id_(6, 'k')} as point, c_nationkey as owner, len - fixed as len from c join orders on o_orderkey = k join customer on c_custkey = o_custkey)
select point, owner, len, (sum(len) over (order by owner, point rows unbounded preceding) - len)::bigint as global_offset from o""")
def constrained_numbering(s, d):
    fixed = t(s, d, "lineitem").where("l_quantity > 45").select(point(ORDER, F.col("l_orderkey")).alias("point"), F.col("l_linenumber").alias("idx"))
    return strata.global_offsets(strata.constrained_lengths(line_counts(s, d), fixed), order_owners(s, d))


def vectors(s, d) -> DataFrame:
    return t(s, d, "embeddings").select((F.col("vec_id") + 1).alias("point"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("values"))


@query("""with e as (select vec_id, embedding, sum(len(embedding)) over (order by vec_id rows unbounded preceding) - len(embedding) as o from embeddings), x as (select vec_id, o, embedding, unnest(range(len(embedding))) as i from e)
select (o + i)::bigint as index, vec_id + 1 as point, i::int as idx, embedding[i + 1]::double as value from x""")
def section_gather(s, d):
    return sections.flat(vectors(s, d))


def _resized(policy: str) -> Query:
    def run(s, d):
        e = vectors(s, d)
        got = sections.resize(e, e.select("point", F.lit(10).alias("len")), policy)
        return got.select("point", F.posexplode("values").alias("idx", "value"))

    return run


QUERIES["section_resize_prefix"], QUERIES["section_resize_suffix"] = _resized("prefix"), _resized("suffix")
SQL["section_resize_prefix"] = "with x as (select vec_id, embedding, unnest(range(10)) as i from embeddings) select vec_id + 1 as point, i::int as idx, coalesce(embedding[i + 1], 0)::double as value from x"
SQL["section_resize_suffix"] = "with x as (select vec_id, embedding, unnest(range(10)) as i from embeddings) select vec_id + 1 as point, i::int as idx, (case when len(embedding) - 10 + i < 0 then 0 else embedding[len(embedding) - 10 + i + 1] end)::double as value from x"


@query("""select (l_orderkey * 8 + l_linenumber)::bigint as point, case when l_linenumber % 2 = 1 then o_custkey else o_orderkey end::double as v0, case when l_linenumber % 2 = 1 then o_orderkey else o_custkey end::double as v1 from lineitem join orders on l_orderkey = o_orderkey""")
def refine_copy(s, d):
    coarse = t(s, d, "orders").select(F.col("o_orderkey").alias("point"), F.array(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")).alias("values"))
    mapping = t(s, d, "lineitem").select(F.col("l_orderkey").alias("coarse"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fine"), (F.col("l_linenumber") % 2 == 1).alias("reverse"))
    return sections.refine(coarse, mapping).select("point", F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1)).alias("v1"))


@query("with c as (select l_orderkey as k, l_partkey as p, sum(l_quantity) as q from lineitem group by 1, 2) select o_orderkey as point, coalesce(avg(q), -1)::double as mean from orders left join c on k = o_orderkey group by 1")
def assemble_mean(s, d):
    base = t(s, d, "orders").select(F.col("o_orderkey").alias("point"), F.array(F.lit(-1.0)).alias("values"))
    cap = (F.col("l_orderkey") * 10**9 + F.col("l_partkey")).alias("cap")
    q = t(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    caps, stack = q.select(cap.alias("point"), F.array("q").alias("values")), q.select(F.col("l_orderkey").alias("base"), cap)
    return sections.assemble(base, caps, stack).select("point", F.get("values", F.lit(0)).alias("mean"))


@query(f"select {id_(6, 'o_orderkey')} as point, coalesce(sum(l_quantity * p_size), o_custkey)::double as value from orders left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey group by o_orderkey, o_custkey")
def hanging_constraints(s, d):
    rows = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("point"), F.lit(0).alias("idx"), F.col("o_custkey").cast("double").alias("value")).unionByName(t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point"), F.lit(0).alias("idx"), F.col("p_size").cast("double").alias("value")))
    terms = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("point"), F.lit(0).alias("idx"), point(PART, F.col("l_partkey")).alias("src_point"), F.lit(0).alias("src_idx"), F.col("l_quantity").alias("weight"))
    return constraints.hanging(rows, terms).where(f"point > {ORDER * 10**12}").select("point", "value")


@query(f"select {id_(5, 'p_partkey')} as point, case when p_size = 3 then 100 + p_partkey % 10 else p_size end::double as value from part")
def dirichlet(s, d):
    rows = t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point"), F.lit(0).alias("idx"), F.col("p_size").cast("double").alias("value"))
    on = labels.stratum(part_labels(s, d, "size", F.col("p_size")), "size", 3)
    return constraints.dirichlet(rows, on, [0], (F.lit(100) + (F.col("point") - 1) % 10).cast("double")).select("point", "value")


# --- assembly and linear algebra


@query(f"with {OP}, c as (select src as cell, src as point, 1::bigint as len from (select distinct src from op) union all select src, dst, 2 from op) select cell, point, (row_number() over w - 1)::int as place, coalesce(sum(len) over (partition by cell order by point rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", len from c window w as (partition by cell order by point)")
def closure_index(s, d):
    op = order_parts(s, d)
    atlas = topology.points(op).select("point", F.when(F.col("point") > ORDER * 10**12, 1).otherwise(2).alias("len"))
    return assembly.closure_index(op, op.select(F.col("src").alias("point")).distinct(), atlas)


@query("with sp as (select distinct l_orderkey as c, l_suppkey as s from lineitem) select a.s as row, count(distinct b.s) as nnz from sp a join sp b on a.c = b.c group by 1")
def preallocation(s, d):
    dofs = t(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("dof")).distinct()
    return assembly.pattern(dofs).groupBy("row").agg(F.count("*").alias("nnz"))


@query("select l_orderkey as row, sum(l_quantity * p_size)::double as value from lineitem join part on l_partkey = p_partkey group by 1")
def spmv(s, d):
    m = t(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    return assembly.spmv(m, t(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("value")))


@query("select sum(p_size)::double as sum, sqrt(sum(p_size * p_size)::double) as l2_norm, max(abs(p_size))::double as max_abs from part")
def reductions(s, d):
    return assembly.reductions(t(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("value")))


# --- distribution and partitioning


def order_ranks(s, d) -> DataFrame:
    return t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("cell"), (F.col("o_orderkey") % 4).cast("int").alias("part"))


LOCAL = f"{OP}, local as (select {id_(6, 'o_orderkey')} as point, (o_orderkey % 4)::int as rank from orders union select dst, ((src - {6 * 10**12 + 1}) % 4)::int from op)"


@query(f"with {LOCAL} select point, min(rank) as owner from local group by point")
def owner_min(s, d):
    return distribution.owners_from_parts(order_parts(s, d), order_ranks(s, d))


@query(f"with {LOCAL} select a.rank, b.rank as neighbor, count(*) as links, count(*)::bigint as unresolved from local a join local b on a.point = b.point and a.rank <> b.rank group by 1, 2")
def overlap_links(s, d):
    held = traverse.closure(order_parts(s, d), order_ranks(s, d).select(F.col("part").alias("rank"), F.col("cell").alias("point")), keys=["rank"])
    return distribution.neighbor_ranks(distribution.overlap_links(held).withColumn("remote_point", F.lit(None).cast("long")))


@query(f"""with {LOCAL}, up as (select distinct l.rank, op.src as point from local l join op on op.dst = l.point), met as (select rank, point from up union select up.rank, op.dst from up join op on op.src = up.point)
select rank, layer, count(*) as points from (select rank, point, 0 as layer from local union all select rank, point, 1 from met where (rank, point) not in (select (rank, point) from local)) group by 1, 2""")
def ghost_layer(s, d):
    op = order_parts(s, d)
    own = traverse.closure(op, order_ranks(s, d).select(F.col("part").alias("rank"), F.col("cell").alias("point")), keys=["rank"])
    return distribution.ghost_layers(op, own, 1).groupBy("rank", "layer").agg(F.count("*").alias("points"))


@query(f"with {LOCAL}, w as (select point, min(rank) as owner from local group by 1) select local.rank, local.point as leaf, owner as remote_rank, local.point as remote_point from local join w on w.point = local.point where rank <> owner")
def star_forest(s, d):
    held = traverse.closure(order_parts(s, d), order_ranks(s, d).select(F.col("part").alias("rank"), F.col("cell").alias("point")), keys=["rank"])
    return distribution.forest(distribution.ownership(held))


@query("select p_partkey as point, p_partkey - p_partkey % 7 as representative from part where p_partkey % 7 <> 0 or p_partkey + 1 in (select p_partkey from part)")
def periodic_classes(s, d):
    p = t(s, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("slave"), (F.col("p_partkey") - 1).alias("master"))
    return distribution.periodic_classes(p)


def bipartite(s, d) -> tuple[DataFrame, DataFrame]:
    e = order_parts(s, d).select(F.col("dst").alias("u"), F.col("src").alias("v"))
    v = topology.points(order_parts(s, d)).select(F.col("point").alias("vertex"), ((F.col("point") - 1) % 4).cast("int").alias("part"))
    return e, v


@query(f"with {OP} select sum(((src - 1) % 4 <> (dst - 1) % 4)::int)::bigint as edge_cut, count(*) as edges from op")
def edge_cut(s, d):
    return partition.edge_cut(*bipartite(s, d))


@query(f"with {OP}, p as (select src as v, (dst - 1) % 4 as p from op union select dst, (src - 1) % 4 from op union select src, (src - 1) % 4 from op union select dst, (dst - 1) % 4 from op) select avg(n)::double as replication_factor from (select v, count(distinct p) as n from p group by v)")
def replication_factor(s, d):
    return partition.replication_factor(*bipartite(s, d))


@query(f"with {OP}, x as (select (v - 1) % 4 as p, count(*) as load from (select src as v from op union all select dst from op) group by 1) select min(load)::bigint as min_load, max(load)::bigint as max_load, max(load)::double / min(load) as ratio from x")
def load_balance(s, d):
    return partition.load_balance(*bipartite(s, d))


# --- geometry, finite volumes, adaptation


@query("select (1 + x * 11 + y)::bigint as point, x / 10.0::double as x, y / 20.0::double as y from (select unnest(range(11)) as x), (select unnest(range(11)) as y)")
def quad_mesh_coords(s, d):
    return generate.quad_mesh(s, 10, 10, high=(1.0, 0.5)).coords.select("point", F.get("xyz", F.lit(0)).alias("x"), F.get("xyz", F.lit(1)).alias("y"))


@query("select c_custkey as query, (122 + floor((c_custkey % 100) / 10) * 10 + floor((c_custkey // 100 % 100) / 10))::bigint as cell from customer")
def locate_points(s, d):
    mesh = generate.quad_mesh(s, 10, 10)
    q = t(s, d, "customer").select(F.col("c_custkey").alias("query"), F.array((F.col("c_custkey") % 100 + 0.5) / 100, (F.floor(F.col("c_custkey") / 100) % 100 + 0.5) / 100).alias("x"))
    return geometry.locate(generate.cell_coordinates(mesh), q, 0.1)


@query("select o_orderkey as target, p_partkey as source, abs(o_totalprice / 100 - p_retailprice) as distance from orders, part qualify row_number() over (partition by o_orderkey order by abs(o_totalprice / 100 - p_retailprice), p_partkey) = 1")
def nearest_part(s, d):
    src = t(s, d, "part").select(F.col("p_partkey").alias("source"), F.array("p_retailprice").alias("x"))
    return geometry.nearest(src, t(s, d, "orders").select(F.col("o_orderkey").alias("target"), F.array(F.col("o_totalprice") / 100).alias("x")), 1.0)


def line_faces(s, d) -> DataFrame:
    """Lines as faces from an order to a part, with whole numbers as mass fluxes and values."""
    f = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("owner"), point(PART, F.col("l_partkey")).alias("neighbor"), (F.col("l_quantity") - 25).alias("mass_flux"))
    phi = t(s, d, "orders").select(point(ORDER, F.col("o_orderkey")).alias("cell"), (F.col("o_custkey") % 100).cast("double").alias("phi")).unionByName(t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("cell"), F.col("p_size").cast("double").alias("phi")))
    return fvm.joined(f, phi)


FACES = "f as (select {o} as o, {p} as n, l_quantity - 25 as m, (o_custkey % 100)::double as a, p_size::double as b from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)".format(o=id_(6, "l_orderkey"), p=id_(5, "l_partkey"))


@query(f"with {FACES}, x as (select o, n, m * case when m >= 0 then a else b end as v from f) select cell, sum(v)::double as residual from (select o as cell, v from x union all select n, -v from x) group by 1")
def flux_residual_upwind(s, d):
    return fvm.residual(fvm.convective(line_faces(s, d), "upwind"))


@query(f"with {FACES}, x as (select o, n, m * ((a + b) / 2) as v from f) select cell, sum(v)::double as residual from (select o as cell, v from x union all select n, -v from x) group by 1")
def flux_residual_central(s, d):
    return fvm.residual(fvm.convective(line_faces(s, d), "central"))


@query("with q as (select l_quantity as v, row_number() over (order by l_quantity) - 1 as i, count(*) over () as n from lineitem) select 'l_quantity' as metric, count(*) as count, max(v) as max, avg(v) as mean, min(v) filter (i = floor(0.95 * (n - 1) + 0.5)) as p95 from q")
def quality_summary(s, d):
    return fvm.summary(t(s, d, "lineitem"), "l_quantity")


@query("select case when l_quantity > 40 then 'refine' when l_quantity < 10 then 'coarsen' else 'keep' end as action, count(*) as cells from lineitem group by 1")
def metric_select(s, d):
    got = adapt.select(t(s, d, "lineitem"), F.col("l_quantity") > 40, F.col("l_quantity") < 10)
    return got.groupBy("action").agg(F.count("*").alias("cells"))


@query("select 1::int as level, x::bigint as x, y::bigint as y from (select unnest(range(2)) as x), (select unnest(range(2)) as y) where not (x = 0 and y = 0) union all select 2, x, y from (select unnest(range(2)) as x), (select unnest(range(2)) as y)")
def forest_refine(s, d):
    root = s.createDataFrame([(0, [0, 0], 1.0)], "level int, coords array<long>, value double")
    once = adapt.refine_by_indicator(root, 2, 0.5).withColumn("value", F.when(F.aggregate("coords", F.lit(0).cast("long"), lambda a, x: a + x) == 0, 1.0).otherwise(0.0))
    return adapt.refine_by_indicator(once, 2, 0.5).select("level", F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


# --- more of sections, constraints and transfers


@query(f"select {id_(5, 'p_partkey')} as point, p_retailprice + 2.0::double as x, p_size + 2.0::double * 3.0::double as y from part")
def advance_with_velocity(s, d):
    at = t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("xyz"))
    v = at.select("point", F.array(F.lit(1.0), F.lit(3.0)).alias("xyz"))
    return sections.advance(at, v, 2.0).select("point", F.get("xyz", F.lit(0)).alias("x"), F.get("xyz", F.lit(1)).alias("y"))


@query("with c as (select l_orderkey as k, count(*) as n from lineitem group by 1), f as (select k as seq, 0 as field_idx, 1::bigint as len from c union all select k, 1, n from c) select seq, field_idx::int as field_idx, len, (sum(len) over (order by seq, field_idx rows unbounded preceding) - len)::bigint as \"offset\" from f")
def multi_section_layout(s, d):
    c = line_counts(s, d)
    f = c.select("point", "seq", F.lit(0).alias("field_idx"), F.lit(1).cast("long").alias("len")).unionByName(c.select("point", "seq", F.lit(1).alias("field_idx"), "len"))
    return sections.fields_layout(f).select("seq", "field_idx", "len", "offset")


@query("select p_partkey as point, case when p_partkey % 2 = 1 then p_size else p_partkey end::double as v0, case when p_partkey % 2 = 1 then p_partkey - 1 else coalesce(p_size, 0) end::double as v1 from part where p_partkey % 2 = 0 union all select a.p_partkey, b.p_size::double, b.p_partkey::double from part a join part b on b.p_partkey = a.p_partkey - 1 where a.p_partkey % 2 = 1")
def copy_between_points(s, d):
    own = t(s, d, "part").select(F.col("p_partkey").alias("point"), F.col("p_partkey").alias("seq"), F.array(F.col("p_partkey").cast("double"), F.col("p_size").cast("double")).alias("values"))
    pairs = t(s, d, "part").where("p_partkey % 2 = 1").select((F.col("p_partkey") - 1).alias("src"), F.col("p_partkey").alias("dst"), F.lit(True).alias("reverse"))
    return sections.copy_between(own, pairs).select("point", F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1)).alias("v1"))


@query(f"select {id_(5, 'p_partkey')} as point, 0::int as idx, (p_size * 10)::double as value from part where p_size in (3, 4)")
def constraints_from_labels(s, d):
    specs = s.createDataFrame([("size", 3, 0, 30.0), ("size", 4, 0, 40.0)], "name string, value int, idx int, fixed double")
    return constraints.from_labels(part_labels(s, d, "size", F.col("p_size")), specs)


@query(f"with {OP}, n as (select src, count(*) as n from op group by 1) select op.src as point, 0::int as idx, dst as src_point, 0::int as src_idx, (1.0::double / n)::double as weight from op join n on n.src = op.src")
def anchor_constraints(s, d):
    op = order_parts(s, d)
    return constraints.anchor_terms(op.select(F.col("src").alias("point"), F.col("dst").alias("parent")), op.select(F.col("src").alias("point"), F.lit(1).alias("len")).distinct())


@query("with c as (select (l_suppkey % 4)::int as rank, l_partkey as point, sum(l_quantity) as v from lineitem group by 1, 2), w as (select point, sum(v) as value, min(rank) as owner from c group by 1) select c.rank, c.point, 0::int as idx, case when c.point % 10 = 0 then -1 else w.value end::double as value from c join w on w.point = c.point")
def assemble_shared(s, d):
    local = t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 4).cast("int").alias("rank"), F.col("l_partkey").alias("point")).agg(F.sum("l_quantity").alias("value")).withColumn("idx", F.lit(0))
    owners = local.groupBy("point").agg(F.min("rank").alias("owner"))
    fixed = t(s, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("point"), F.lit(0).alias("idx"), F.lit(-1.0).alias("value"))
    return assembly.assemble_shared(local, owners, fixed)


@query("with c as (select (l_suppkey % 4)::int as rank, l_partkey as point, sum(l_quantity) as v from lineitem group by 1, 2), w as (select point, arg_min(v, rank) as value from c group by 1) select c.rank, c.point, 0::int as idx, w.value::double as value from c join w on w.point = c.point")
def complete_section(s, d):
    local = t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 4).cast("int").alias("rank"), F.col("l_partkey").alias("point")).agg(F.sum("l_quantity").alias("value")).withColumn("idx", F.lit(0))
    return distribution.complete(local, local.groupBy("point").agg(F.min("rank").alias("owner")))


@query(f"with {LOCAL}, w as (select point, min(rank) as owner from local group by 1), sf as (select local.rank, local.point as leaf, owner as rr from local join w on w.point = local.point where rank <> owner) select rank, leaf, (rr + 10)::int as remote_rank, leaf as remote_point from sf where leaf % 2 = 0 union all select rank, leaf, rr, leaf from sf where leaf % 2 <> 0")
def compose_forests(s, d):
    held = traverse.closure(order_parts(s, d), order_ranks(s, d).select(F.col("part").alias("rank"), F.col("cell").alias("point")), keys=["rank"])
    sf = distribution.forest(distribution.ownership(held))
    moved = sf.where("leaf % 2 = 0").select(F.col("remote_rank").alias("rank"), F.col("remote_point").alias("leaf"), (F.col("remote_rank") + 10).alias("remote_rank"), "remote_point").distinct()
    return distribution.compose(sf, moved)


@query(f"select distinct {id_(6, 'l_orderkey')} as src, {id_(5, '(l_partkey - l_partkey % 7)')} as dst from lineitem")
def periodic_quotient(s, d):
    same = t(s, d, "part").select(point(PART, F.col("p_partkey")).alias("point"), point(PART, F.col("p_partkey") - F.col("p_partkey") % 7).alias("representative"))
    return distribution.quotient(order_parts(s, d), same)


@query(f"""with {OP}, near as (select src as v, (dst - 1) % 4 as p from op union all select dst, (src - 1) % 4 from op), n as (select v, p, count(*) as c from near group by 1, 2)
select v as vertex, arg_max(p, c * 100 + case when p = (v - 1) % 4 then 50 else 0 end - p)::int as primary, count(*)::int as replicas from n group by 1""")
def vertex_cuts(s, d):
    return partition.vertex_cuts(*bipartite(s, d)).select("vertex", "primary", F.size("replicas").alias("replicas"))


@query(f"with {FACES} select cell, axis, sum(v)::double / 2 as gradient from (select o as cell, 0 as axis, (a + b) / 2 * m as v from f union all select n, 0, -((a + b) / 2 * m) from f union all select o, 1, (a + b) / 2 from f union all select n, 1, -((a + b) / 2) from f) group by 1, 2")
def green_gauss_gradient(s, d):
    f = line_faces(s, d).withColumn("area_vector", F.array("mass_flux", F.lit(1.0)))
    cells = f.select(F.explode(F.array("owner", "neighbor")).alias("cell")).distinct().withColumn("volume", F.lit(2.0))
    return fvm.gradients(f, cells)


@query(f"with x as (select {id_(6, 'l_orderkey')} as o, {id_(5, 'l_partkey')} as n, l_quantity as a, l_discount as k from lineitem) select cell, max(a) as non_orthogonality, max(k) as skewness, 0::bigint as boundary_faces from (select o as cell, a, k from x union all select n, a, k from x) group by 1")
def cell_diagnostics(s, d):
    m = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("owner"), point(PART, F.col("l_partkey")).alias("neighbor"), F.col("l_quantity").alias("non_orthogonality"), F.col("l_discount").alias("skewness"))
    return fvm.cell_diagnostics(m)


@query("select 'non_orthogonality' as check, sum((l_quantity > 40)::int)::bigint as violations from lineitem union all select 'skewness', sum((l_discount > 0.05)::int) from lineitem union all select 'degenerate_faces', sum((l_tax <= 0)::int) from lineitem")
def fv_readiness(s, d):
    m = t(s, d, "lineitem").select(F.col("l_quantity").alias("non_orthogonality"), F.col("l_discount").alias("skewness"), F.col("l_tax").alias("area"))
    return fvm.readiness(m, 40.0, 0.05)


@query(f"select {id_(6, 'l_orderkey')} as owner, l_linenumber as line, not (l_linenumber = 1 and o_orderstatus = 'F') as active from lineitem join orders on l_orderkey = o_orderkey")
def wet_dry_mask(s, d):
    f = t(s, d, "lineitem").select(point(ORDER, F.col("l_orderkey")).alias("owner"), F.when(F.col("l_linenumber") != 1, point(PART, F.col("l_partkey"))).alias("neighbor"), F.col("l_linenumber").alias("line"))
    dry = t(s, d, "orders").where("o_orderstatus = 'F'").select(F.lit("wet_dry").alias("name"), point(ORDER, F.col("o_orderkey")).alias("point"), F.lit(0).alias("value"))
    return fvm.active(f, dry).select("owner", "line", "active")


@query("select l_orderkey * 100 + l_linenumber as point, o_custkey as value from lineitem join orders on l_orderkey = o_orderkey")
def transfer_refinement(s, d):
    m = t(s, d, "lineitem").select(F.col("l_orderkey").alias("coarse"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("fine"))
    return adapt.transfer_refinement(t(s, d, "orders").select(F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("value")), m)


@query("select o_custkey as point, 0::int as idx, avg(o_orderkey)::double as value from orders group by 1")
def transfer_coarsening(s, d):
    m = t(s, d, "orders").select(F.col("o_custkey").alias("coarse"), F.col("o_orderkey").alias("fine"))
    return adapt.transfer_coarsening(t(s, d, "orders").select(F.col("o_orderkey").alias("point"), F.lit(0).alias("idx"), F.col("o_orderkey").cast("double").alias("value")), m)


@query(f"with {OP} select dst as point, min((src - 1) % 5)::bigint as owner from op group by 1")
def transfer_ownership(s, d):
    op = order_parts(s, d)
    own = op.select(F.col("src").alias("point"), ((F.col("src") - 1) % 5).alias("owner")).distinct()
    return adapt.transfer_ownership(own, op.select(F.col("src").alias("coarse"), F.col("dst").alias("fine")))


@query("select (c_nationkey % 3)::int as mesh_id, 'seg' as name, c_custkey % 50 as point, w.v as value from customer join (select c_custkey % 50 as p, max(c_nationkey)::int as v from customer group by 1) w on w.p = c_custkey % 50 group by all")
def bundle_sync_labels(s, d):
    from .sources.bundles import sync_labels

    own = t(s, d, "customer").select((F.col("c_nationkey") % 3).cast("int").alias("mesh_id"), F.lit("seg").alias("name"), (F.col("c_custkey") % 50).alias("point"), F.col("c_nationkey").cast("int").alias("value"))
    return sync_labels(own, own)


@query("select 'hexahedron' as tag, 60::bigint as cells, 6.0::double as measure union all select 'triangle', 24, 1.0")
def mesh_measures(s, d):
    out = None
    for mesh in (generate.hex_mesh(s, 5, 4, 3, high=(1.0, 2.0, 3.0)), generate.triangulated(generate.quad_mesh(s, 4, 3))):
        one = generate.cell_coordinates(mesh).groupBy("tag").agg(F.count("*").alias("cells"), F.round(F.sum(geometry.measure(F.col("tag"), F.col("pts"))), 9).alias("measure"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select 0::int as orient, 31::bigint as arrows union all select -1, 17")
def interpolate_topology(s, d):
    """Arrows of the edges of a 4 x 3 grid: each edge's first cell, and the second cells that meet it the other way."""
    return generate.interpolate(generate.quad_mesh(s, 4, 3), "edges")[1].groupBy("orient").agg(F.count("*").alias("arrows"))


@query("select 'triangle' as tag, 96::bigint as cells, 1.0::double as measure")
def refine_templates(s, d):
    mesh, _ = generate.refine(generate.triangulated(generate.quad_mesh(s, 4, 3)))
    return generate.cell_coordinates(mesh).groupBy("tag").agg(F.count("*").alias("cells"), F.round(F.sum(geometry.measure(F.col("tag"), F.col("pts"))), 9).alias("measure"))


def queries() -> dict[str, Query]:
    from . import catalog_extra  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_extra  # noqa: F401

    return dict(SQL)


__all__ = ["cut", "flagship", "oracle_sql", "queries"]
