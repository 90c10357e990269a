"""The budget sweep against a plain greedy cover, pairs and dominated nodes against all pairs."""

import itertools
import random
from collections import Counter

import pytest

from certloom import catalog
from certloom.operators import plans
from certloom.tables import dependencies

SF = "/root/testdata/sf0.001"


def test_full_sweep(spark):
    covers: dict = {}
    for r in dependencies(spark, SF).collect():
        covers.setdefault(r.campaign, {}).setdefault(r.domain, set()).add(r.node)
    want = {}
    for campaign, left in covers.items():
        total, killed = len(left), 0
        for k in range(1, 16):
            gains = Counter(n for nodes in left.values() for n in nodes)
            node = min(gains, key=lambda n: (-gains[n], str(n)), default=None)
            killed += gains.get(node, 0)
            left = {d: nodes for d, nodes in left.items() if node not in nodes}
            want[campaign, k] = (node, killed, round(100 * killed / total, 6))
    got = {(r.campaign, r.k): (r.node, r.killed, r.pct) for r in catalog.QUERIES["i05_full_sweep"](spark, SF).collect()}
    assert got == want


def _random_campaigns(seed):
    """Skewed node sizes, equal sets, contained sets, a node in nearly all domains, campaigns of one node or one domain."""
    rng, rows = random.Random(seed), set()
    for c in range(12):
        nodes = rng.choice([1, 2, 5, 14])
        for d in range(rng.choice([1, 3, 20])):
            rows.add((c, 100 * c + d, rng.randrange(nodes)))
            for n in range(nodes):
                if rng.random() < rng.choice([0.02, 0.9 if n == c % 3 else 0.15]):
                    rows.add((c, 100 * c + d, n))
    for c, d, n in list(rows):
        if c % 2 and n == 1:
            rows.add((c, d, 30))  # an equal set
            if rng.random() < 0.5:
                rows.add((c, d, 31))  # a contained one
    return sorted(rows)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_and_dominated_nodes(spark, seed):
    rows = _random_campaigns(seed)
    sets: dict = {}
    for c, d, n in rows:
        sets.setdefault(c, {}).setdefault(n, set()).add(d)
    dep = spark.createDataFrame(rows, "campaign long, domain long, node long")
    want = {c: max(len(a | b) for a, b in itertools.combinations(own.values(), 2)) for c, own in sets.items() if len(own) > 1}
    assert {r.campaign: r.killed for r in plans.best_pairs(dep).collect()} == want
    below = {(c, v) for c, own in sets.items() for v, a in own.items() for u, b in own.items() if u != v and a <= b and (len(b) > len(a) or u < v)}
    got = [tuple(r) for r in plans.dominated(dep).collect()]
    assert len(got) == len(set(got)) and set(got) == below
    assert plans.best_pairs(dep.limit(0)).count() == 0 and plans.dominated(dep.limit(0)).count() == 0


def test_few_pairs_are_formed(spark):
    dep = plans.materialise(dependencies(spark, "/root/testdata/sf0.01"), "dependencies")
    formed, every = plans.reached_pairs(*plans.within_reach(dep)), plans.co_coverage(dep).filter("a < b")
    assert formed.count() * 10 < every.count()
