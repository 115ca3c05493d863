import random

from weftgraph.operators import labels


def test_all_values_as_one_after_another(spark):
    r = random.Random(3)
    for _ in range(3):
        arrows = {(a, b) for a, b in (sorted(r.sample(range(1, 25), 2)) for _ in range(30))}
        own = {(n, p): r.randrange(5) for n in "xy" for p in r.sample(range(1, 25), 8)}
        want = dict(own)
        for n in "xy":
            for v in sorted({v for (m, _), v in own.items() if m == n}):
                todo = [p for (m, p), w in want.items() if m == n and w == v]
                while todo:
                    p = todo.pop()
                    want[n, p] = v
                    todo += [b for a, b in arrows if a == p]
        got = labels.propagate_all(
            spark.createDataFrame([(n, p, v) for (n, p), v in own.items()], "name string, point long, value int"), spark.createDataFrame(sorted(arrows), "src long, dst long")
        )
        assert {(x.name, x.point): x.value for x in got.collect()} == want
