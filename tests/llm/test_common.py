from weftgraph.llm import common


def test_cut_returns_what_the_drivers_jvm_has_freed(spark, monkeypatch):
    """The command is there and is taken, and each cut gives it once its rows are written."""
    assert common.trim(spark)
    given = []
    monkeypatch.setattr(common, "trim", lambda s, f=common.trim: given.append(f(s)))
    assert sorted(r.id for r in common.cut(spark.range(10)).collect()) == list(range(10))
    assert given == [True]
