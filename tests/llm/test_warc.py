import random

from weftgraph.llm import warc

SCHEMA = "page_id long, url string, html string, key string"


def pages(n, seed=1):
    r = random.Random(seed)
    return [(i * 3, f"http://h{r.randrange(5)}/é{i}", None if i % 50 == 0 else "<p>" + "x" * r.randrange(200) + "ü</p>", "k") for i in range(n)]


def text(p, u, h):
    body = h or ""
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if p is None else p}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"


def brute(ours, theirs):
    def by(rows):
        got = {}
        for p, u, h, _ in rows:
            got.setdefault(-1 if p is None else p, []).append(text(p, u, h))
        return {k: sorted(v) for k, v in got.items()}

    a, b = by(ours), by(theirs)
    out = set()
    for k in a.keys() | b.keys():
        if a.get(k) != b.get(k):
            side = a if k in a else b
            off = sum(len(t.encode()) for j, v in side.items() if j >> 10 == k >> 10 and j < k for t in v)
            out.add((None if k == -1 else k, "missing" if k not in b else "extra" if k not in a else "corrupt", off))
    return out


def run(spark, ours, theirs):
    got = warc.audit(spark.createDataFrame(ours, SCHEMA), spark.createDataFrame(theirs, SCHEMA)).collect()
    return {(r.page_id, r.status, r.record_offset) for r in got}


def test_finds_all_damage(spark):
    ours = pages(900)
    theirs = list(ours)
    theirs[5] = (*ours[5][:2], "<p>changed", "k")
    theirs[800] = (ours[800][0], "http://other", *ours[800][2:])
    del theirs[400], theirs[300]
    theirs += [(-40, "u", "h", "k"), (10**9, "u", "h", "k"), ours[20]]
    got = run(spark, ours, theirs)
    assert got == brute(ours, theirs) and len(got) == 7


def test_equal_empty_null_and_repeated(spark):
    ours = pages(40)
    assert run(spark, ours, list(reversed(ours))) == set()
    assert run(spark, ours, []) == brute(ours, [])
    assert run(spark, [], []) == set()
    odd = [(None, None, None, None), (None, "u", "h", None), (7, "u", "h", ""), (7, "u", "h", "")]
    assert run(spark, odd, odd) == set()
    worse = [odd[0], odd[2]]
    assert run(spark, odd, worse) == brute(odd, worse)


def test_only_mismatching_branches_are_descended(spark):
    ours = pages(2000)
    theirs = list(ours)
    theirs[7] = (*ours[7][:2], "y", "k")
    a, b = (warc._stored(warc.tree(warc.manifest(spark.createDataFrame(x, SCHEMA)), 4)) for x in (ours, theirs))
    bad = None
    sizes = []
    for level in range(4, -1, -1):
        bad = warc._compared(a, b, level, bad)
        sizes.append(bad.count())
    assert sizes == [1] * 5


def test_places_lead_to_the_bytes_of_written_files(spark, tmp_path):
    ours = [*pages(900), (None, "u", "h\r\n", "k"), (30, "same", "id", "k")]
    df = spark.createDataFrame(ours, SCHEMA)
    warc.write_files(df, f"{tmp_path}/warc")
    every = warc.audit(df, spark.createDataFrame([], SCHEMA))
    got = warc.read_records(spark, f"{tmp_path}/warc", every).selectExpr("page_id", "record_length", "expected_sha256", "sha2(record, 256) as h", "cast(record as string) as r").collect()
    assert len(got) == 901 and all(x.h == x.expected_sha256 for x in got)
    assert {x.r for x in got} >= {text(*x[:3]) for x in ours if x[0] != 30}
