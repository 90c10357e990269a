"""Running totals by ranges, and plans in which no task orders all distinct values."""

import random

from certloom import catalog
from certloom.functions.ranks import mean_ranks, running


def test_running_totals(spark):
    rng = random.Random(2)
    rows = list({(rng.choice("ab"), rng.choice([None, *[rng.lognormvariate(0, 4) for _ in range(400)]])): rng.randrange(9) for _ in range(900)}.items())
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows] + [(None, 1.0, 4), (None, 2.0, 5)], "g string, v double, n long")
    got = {(r.g, r.v): r.before for r in running(df, ["v"], "n", ("g",)).collect()}
    want = {(None, 1.0): 0, (None, 2.0): 4}
    for own in "ab":
        total = 0
        for (_, v), n in sorted((r for r in rows if r[0][0] == own), key=lambda r: (r[0][1] is not None, r[0][1] or 0)):
            want[(own, v)] = total
            total += n
    assert got == want
    assert running(df.limit(0), ["v"], "n").count() == 0


def test_mean_ranks(spark):
    values = [3.0, 1.0, 3.0, 3.0, 2.0, None]
    got = {r.v: (r.n, r.rank) for r in mean_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert got == {1.0: (1, 1.0), 2.0: (1, 2.0), 3.0: (3, 4.0)}


def test_no_task_orders_all_values(spark):
    for name in ("a17_auc", "w07_score_ranks"):
        lines = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
        windows = [x for x in lines if "Window [" in x or "Window(" in x]
        assert any("part#" in x for x in windows)
        for k, line in enumerate(lines):
            if "SinglePartition" in line:  # totals of the ranges, or the partial sums of the result
                assert "keys=[part" in "".join(lines[k : k + 3]) or "keys=[]" in "".join(lines[k - 2 : k + 3]), lines[k - 3 : k + 4]
