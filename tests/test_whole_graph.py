"""Queries over the whole incidence graph against brute force on hand-made tables."""

import pytest

from weftgraph import catalog

P = lambda kind, key: kind * 10**12 + 1 + key


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    nation, customer, supplier = [(k, k % 3) for k in range(5)], [(k, k % 5) for k in range(1, 8)], [(k, (k + 1) % 5) for k in range(1, 4)]
    orders = [(k, 1 + k % 7) for k in range(1, 10)]
    line = [(1 + k % 9, 1 + k * 5 % 12, 1 + k % 3) for k in range(20)]
    for name, rows, schema in [
        ("region", [(k,) for k in range(3)], "r_regionkey long"),
        ("nation", nation, "n_nationkey long, n_regionkey long"),
        ("customer", customer, "c_custkey long, c_nationkey long"),
        ("supplier", supplier, "s_suppkey long, s_nationkey long"),
        ("part", [(k,) for k in range(1, 13)], "p_partkey long"),
        ("orders", orders, "o_orderkey long, o_custkey long"),
        ("lineitem", line, "l_orderkey long, l_partkey long, l_suppkey long"),
    ]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    arrows = {(P(1, r), P(2, n)) for n, r in nation} | {(P(2, n), P(3, c)) for c, n in customer} | {(P(2, n), P(4, x)) for x, n in supplier} | {(P(3, c), P(6, o)) for o, c in orders}
    return d, arrows | {(P(6, o), P(5, p)) for o, p, _ in line} | {(P(4, x), P(5, p)) for _, p, x in line}


def reach(arrows, start):
    """Points below start and their least depth."""
    got, level, n = {start: 0}, {start}, 0
    while level:
        n += 1
        level = {b for a, b in arrows if a in level} - set(got)
        got |= dict.fromkeys(level, n)
    return got


def test_join_of_all_neighbouring_parts(spark, tables):
    d, arrows = tables
    up = {p: set(reach({(b, a) for a, b in arrows}, p)) for p in (P(5, k) for k in range(1, 13))}
    sources = {a for a, _ in arrows} - {b for _, b in arrows}
    want = {(a, a + 1, x) for a in up if a + 1 in up for x in up[a] & up[a + 1] & sources}
    got = [(r.a, r.b, r.point) for r in catalog.queries()["join_parts"](spark, d).collect()]
    assert sorted(got) == sorted(want) and {a for a, _, _ in got} - {P(5, 10)}


def test_closures_of_all_regions(spark, tables):
    d, arrows = tables
    want = [(P(1, r), x, n) for r in range(3) for x, n in reach(arrows, P(1, r)).items()]
    assert sorted((r.region, r.point, r.depth) for r in catalog.queries()["closure_region"](spark, d).collect()) == sorted(want)


def test_closure_edges_over_suppliers_and_parts(spark, tables):
    d, arrows = tables
    want = {(a, b) for a in {x for x, _ in arrows} for b, n in reach(arrows, a).items() if n and (a, b) not in arrows}
    got = [(r.src, r.dst) for r in catalog.queries()["closure_edges"](spark, d).collect()]
    assert sorted(got) == sorted(want) and any(b // 10**12 == 5 for _, b in got)


def test_whole_submesh_of_a_region(spark, tables):
    d, arrows = tables
    kept = sorted(set().union(*(reach(arrows, b) for a, b in arrows if a == P(1, 1))))
    at = {p: k for k, p in enumerate(kept, 1)}
    got = [(r.src, r.dst) for r in catalog.queries()["extract_submesh"](spark, d).collect()]
    assert sorted(got) == sorted((at[a], at[b]) for a, b in arrows if a in at and b in at) and any(p // 10**12 == 5 for p in kept)
