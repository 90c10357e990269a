"""Components that share two nodes, and co-coverage, against brute force: hubs, long node lists, equal lists."""

import random
from collections import Counter
from itertools import combinations, combinations_with_replacement

import pytest

from certloom.operators.graph import components, sharing
from certloom.operators.plans import co_coverage


def groups(links, members):
    parent = {m: m for m in members}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {m: root(m) for m in members}


@pytest.mark.parametrize("limit", [2, 3, 8, None])
def test_sharing(spark, limit):
    rng = random.Random(11)
    held = {c: {rng.randrange(400) for _ in range(rng.randrange(1, 4))} | ({1000} if c % 3 else set()) for c in range(300)}  # node 1000 is a hub
    held |= {c: set(rng.sample(range(400), 40)) for c in (300, 301)}  # long lists
    held |= {c: {500, 501, 502} for c in range(310, 330)} | {330: {501, 502, 600}, 331: {600, 601}, 332: {601, 600, 7}}  # equal lists, a chain
    rows = spark.createDataFrame([(n, c) for c, own in held.items() for n in own], "node long, component long")
    want = groups([(a, b) for a, b in combinations(held, 2) if len(held[a] & held[b]) >= 2], held)
    found = {r.node: r.label for r in components(sharing(rows, limit)).collect()}
    assert {c: found.get(c, c) for c in held} == want
    assert len(set(want.values())) < len(held)


def test_sharing_nothing(spark):
    none = spark.createDataFrame([], "node long, component long")
    assert sharing(none).count() == 0
    hub = spark.createDataFrame([(1, c) for c in range(50)], "node long, component long")
    assert sharing(hub).count() == 0


def test_co_coverage(spark):
    rng = random.Random(4)
    dep = {(c, d): {rng.randrange(6) for _ in range(rng.randrange(1, 5))} for c in (1, 2) for d in range(60)}
    rows = spark.createDataFrame([(c, d, n) for (c, d), own in dep.items() for n in own], "campaign int, domain int, node int")
    want = Counter((c, a, b) for (c, _), own in dep.items() for a, b in combinations_with_replacement(sorted(own), 2))
    assert {(r.campaign, r.a, r.b): r.both for r in co_coverage(rows).collect()} == dict(want)


@pytest.mark.parametrize("classes, at_once, held", [(1, 1_000_000, 1_000_000), (4, 50, 1_000_000), (7, 7, 60)])
def test_pairs_are_counted_in_cells(spark, classes, at_once, held):
    """Sets of one and of many members, a pair that most sets have, names in any order; steps and rows that are replaced by their counts."""
    from certloom.functions.pairs import pair_counts

    rng = random.Random(5)
    names = [f"n{k}" for k in range(40)] + ["é", "z", "Z", "\U0001f600", ""]
    sets = [(g, sorted({*rng.sample(names, rng.choice([1, 2, 5, 30])), *(["n1", "n30"] if k % 3 else [])}, key=str.encode), rng.randrange(1, 4)) for g in ("x", "y") for k in range(150)]
    want = Counter()
    for g, own, n in sets:
        want.update({(g, a, b): n for a, b in combinations_with_replacement(own, 2)})
    numbers = {k: n for n, k in enumerate(sorted(names, key=str.encode))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    for of, kind in ((lambda x: x, "string"), (numbers.get, "long")):
        rows = spark.createDataFrame([(g, [of(x) for x in own], n) for g, own, n in sets], f"g string, own array<{kind}>, w int")
        got = pair_counts(rows, "g", "own", "w", classes, 5, at_once, held).collect()
        assert len(got) == len(want) and {(r.g, r.a, r.b): r.n for r in got} == {(g, of(a), of(b)): n for (g, a, b), n in want.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_co_coverage_moves_no_pairs(spark):
    """Sets are dealt, never a row for each set and pair."""
    dep = spark.range(40).selectExpr("id % 2 as campaign", "id as domain", "explode(sequence(id % 7, id % 7 + 9)) as node")
    dealt = [line for line in co_coverage(dep)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and "hashpartitioning(campaign" in dealt[0] and " a#" not in dealt[0] and " b#" not in dealt[0]


def test_rounds_send_nothing_to_the_driver(spark):
    """Joins of the graph's rounds are merges also where a side is small."""
    from certloom.operators import graph

    e = spark.createDataFrame([(1, 5, 0.85), (2, 5, 0.85), (3, 6, 0.15)], "domain long, node long, weight double")
    found = graph.strong_components(e)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 3)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
