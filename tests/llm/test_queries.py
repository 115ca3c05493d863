import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.llm import queries as llm

DIR = "/root/testdata/sf0.001"


def test_registered_once_each():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = llm.queries()[name](spark, DIR)
    want = c.execute(llm.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted(str(x) for x in df.sparkSession.createDataFrame(want.fetchall(), df.select(*names).schema).collect())
