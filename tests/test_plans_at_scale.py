"""Plans that must not order or hold a whole table in one task, and odd cases of the operators behind them."""

import random

import pytest
from pyspark.sql import functions as F

from certloom import catalog
from certloom.operators import capture, metrics

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a20_percentile_nearest", "a23_latency_stages", "a39_endpoint_latency", "j15_gap_overlap", "t10_segments"])
def test_no_single_partition_over_rows(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if "SinglePartition" in line:  # only over one row a day
            assert "HashAggregate(keys=[day" in "".join(lines[k : k + 4]) or "HashAggregate(keys=[day" in "".join(lines[k - 6 : k + 6]), lines[k - 3 : k + 5]


@pytest.mark.parametrize("small", [0, 2, metrics.SMALL])
def test_percentiles_of_ties_and_extremes(spark, small):
    rng = random.Random(3)
    groups = {"ties": [5.0] * 900 + [7.0], "one": [3.0], "wide": [rng.gauss(0, 1) for _ in range(500)] + [1e12], "few": [1.0, 2.0]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in metrics.percentiles(df, ["k"], "v", {"a": metrics.half_up(0.25), "b": metrics.half_even(0.5), "c": metrics.floor_index(0.99)}, small).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        s, n = sorted(own), len(own)
        assert (got[k].a, got[k].b, got[k].c, got[k].n, got[k].largest) == (s[int(0.25 * (n - 1) + 0.5)], s[round(0.5 * (n - 1))], s[int(0.99 * (n - 1))], n, s[-1])
    assert metrics.percentiles(df.limit(0), ["k"], "v", {"a": metrics.half_up(0.5)}, small).count() == 0


def test_ranges_of_skewed_values(spark):
    """Values spread over many orders of magnitude, with heavy outliers, fall into ranges of about equal size."""
    values = spark.range(200_000).select(F.expr("exp(6 * randn(5))").alias("v")).union(spark.createDataFrame([(1e300,), (-1e300,), (float("inf"),)], "v double"))
    ends = values.agg(metrics._bounds(F.col("v")).alias("bounds"))
    sizes = [r["count"] for r in metrics._ranged(values.crossJoin(ends), "bounds", "v", "cell").groupBy("cell").count().collect()]
    assert len(sizes) > metrics.RANGES * 0.7 and max(sizes) < 200_000 / metrics.RANGES * 8
    own = sorted(r.v for r in values.collect())
    got = metrics.percentiles(values.withColumn("k", F.lit(1)), ["k"], "v", {f"p{q}": metrics.floor_index(q / 100) for q in (1, 33, 50, 99)}).first()
    assert [got[f"p{q}"] for q in (1, 33, 50, 99)] == [own[int(q / 100 * (len(own) - 1))] for q in (1, 33, 50, 99)]
    odd = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", float("nan")), ("c", float("-inf")), ("c", 0.0)], "k string, v double")
    got = {r.k: (str(r.low), str(r.high)) for r in metrics.percentiles(odd, ["k"], "v", {"low": lambda n: F.lit(1), "high": lambda n: n}, small=0).collect()}
    assert got == {"a": ("1.0", "nan"), "b": ("nan", "nan"), "c": ("-inf", "0.0")}


def test_segments_across_days(spark):
    day, gap = 1000, 300
    times = [10, 20, 400, 900, 1100, 2050, 2060, 2999, 3001, 3200, 3490, 4100, 9000, 9100, 9100]
    df = spark.createDataFrame([(t,) for t in times], "us long")
    want, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            want.append([t, t, 0])
        want[-1][1], want[-1][2], last = t, want[-1][2] + 1, t
    assert sorted(tuple(r) for r in capture.segments(df, bucket_us=day, gap_us=gap).collect()) == [tuple(x) for x in want]
    assert capture.segments(df.filter(F.lit(False))).count() == 0


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A task counts so many pairs, however few tasks the sets took."""
    from certloom.operators import plans

    monkeypatch.setattr(plans, "PAIRS_A_TASK", 100)
    dep = spark.range(60).selectExpr("id % 2 as campaign", "id as domain", "explode(sequence(id % 7, id % 7 + 9)) as node")
    got = plans.co_coverage(dep)
    assert got.rdd.getNumPartitions() == 14 * 55 // 100 + 1
    x, y = dep.alias("x"), dep.alias("y")
    want = x.join(y, ["campaign", "domain"]).filter("x.node <= y.node").groupBy("campaign", "x.node", "y.node").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plans.co_coverage(dep.limit(0)).isEmpty()


def test_rounds_of_a_cover_do_not_write_the_table_again(spark, monkeypatch):
    """Budgets beyond the cover, and what the rounds store."""
    from certloom.operators import plans

    stored = []
    keep = plans.materialise
    monkeypatch.setattr(plans, "materialise", lambda df, name: stored.append(name) or keep(df, name))
    dep = spark.range(300).selectExpr("id % 3 as campaign", "id as domain", "explode(array(id % 11, 20 + id % 5)) as node")
    left, want = {(r.campaign, r.domain, r.node) for r in dep.collect()}, set()
    for rank in range(1, 9):
        for c in {x[0] for x in left}:
            gain = {}
            for x in left:
                if x[0] == c:
                    gain[x[2]] = gain.get(x[2], 0) + 1
            node = min(gain, key=lambda n: (-gain[n], str(n)))
            want.add((c, rank, node, gain[node]))
            gone = {x[1] for x in left if x[0] == c and x[2] == node}
            left = {x for x in left if x[1] not in gone}
    got = {tuple(r) for r in plans.greedy(dep, 8).collect()}
    assert got == want and not left and stored.count("cover") == 1
