import __spark_entry__ as entry
from weftgraph import catalog


def test_entry_and_registries(spark):
    rows = {r.height: r.points for r in entry.entry(spark).collect()}
    assert rows == {0: 5, 1: 25, 2: 160, 3: 1500, 4: 200}
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
