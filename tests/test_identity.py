"""Operators without an SQL twin against brute force on small fixtures."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from certloom.operators.evidence import merkle_roots
from certloom.operators.lookups import plan_violations, reuse_identity
from certloom.operators.signals import skeleton


def brute_identity(clusters, prior):
    size = Counter(c for _, c in clusters)
    votes = Counter((c, prior[d]) for d, c in clusters if d in prior)
    out, free = {}, dict(votes)
    while free:
        best = {}
        for (c, p), n in free.items():
            best[c] = min(best.get(c, (0, 0)), (-n, p))
        won = {}
        for c, (_, p) in best.items():
            won[p] = min(won.get(p, (0, 0)), (-size[c], c))
        out |= {c: p for p, (_, c) in won.items()}
        free = {(c, p): n for (c, p), n in free.items() if c not in out and p not in won}
    return {c: out.get(c) for c in size}


def test_identity(spark):
    clusters = [(d, d % 7 // 2) for d in range(1, 60)] + [(100, 9), (101, 9)]
    prior = {d: d % 5 + 100 for d in range(1, 60) if d % 3}
    got = reuse_identity(spark.createDataFrame(clusters, "domain long, cluster long"), spark.createDataFrame(list(prior.items()), "domain long, campaign long"))
    got = {r.cluster: r.identity for r in got.collect()}
    assert got == brute_identity(clusters, prior)
    assert got[9] is None and len({v for v in got.values() if v}) == len([v for v in got.values() if v])


def test_identity_without_prior(spark):
    none = spark.createDataFrame([], "domain long, campaign long")
    assert [tuple(r) for r in reuse_identity(spark.createDataFrame([(1, 4)], "domain long, cluster long"), none).collect()] == [(4, None)]


def brute_root(values):
    level = [hashlib.sha256(b"\0" + v.encode() + b"\0" + hashlib.sha256(v.encode()).digest()).digest() for v in sorted(values)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_roots(spark):
    rows = [(k, f"node:{i}") for k in (1, 2, 5, 8) for i in range(k)]
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    leaves = spark.createDataFrame(rows, "k int, value string").withColumn("sha", F.sha2("value", 256))
    assert {r.k: r.root for r in merkle_roots(leaves, "k", "value", "sha").collect()} == {k: brute_root(v) for k, v in groups.items()}


def test_skeleton(spark):
    """Look-alikes fall together; full-width forms are normalised first; null stays null, empty stays empty."""
    rows = spark.createDataFrame([("pаypal",), ("PAYPAL",), ("ｐａｙｐａｌ",), ("rnodern",), ("",), (None,)], "s string")
    got = [r.k for r in rows.select(skeleton(F.col("s")).alias("k")).collect()]
    assert got == ["paypai", "paypai", "paypai", "modem", "", None]


def test_violations(spark):
    dep = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "campaign int, domain int, node int")
    plan = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 1)], "campaign int, node int")
    assert {r.rule: r.n for r in plan_violations(dep, plan, 2).collect()} == {"budget": 1, "duplicate": 1, "unknown": 2}
