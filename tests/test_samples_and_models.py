"""Samples, splits and the regression, which have no SQL twin, against plain Python over the same tables."""

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from certloom import catalog
from certloom.operators.datasets import regression

SF = "/root/testdata/sf0.001"


def hashed(*values):
    """The 64-bit hash of a row: each value under the one before as seed. Values are bytes, or (integer, bits)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q" if v[1] == 64 else "<i", v[0]), seed=h)
    return h - (1 << 64) if h >> 63 else h


def column(table, name):
    values = pq.read_table(f"{SF}/{table}.parquet", columns=[name]).column(0)
    return values.to_pylist(), values.type.bit_width if pa.types.is_primitive(values.type) else None


def test_stable_sample(spark):
    keys, bits = column("orders", "o_orderkey")
    want = sorted(keys, key=lambda k: (hashed((k, bits), (7, 32)), k))[:40]
    assert sorted(r.o_orderkey for r in catalog.QUERIES["k05_stable_sample"](spark, SF).collect()) == sorted(want)


def test_recorder(spark):
    (ids, a), (users, b), (values, _) = (column("events", c) for c in ("event_id", "user_id", "value"))
    want = set()
    for i, u, v in zip(ids, users, values):
        if v is not None and v >= 20:
            want.add((i, "scored"))
        elif hashed((u, b), (i, a)) % 100 == 0:
            want.add((i, "background_sample"))
    assert {(r.idx, r.tag) for r in catalog.QUERIES["s06_recorder"](spark, SF).collect()} == want
    assert {t for _, t in want} == {"scored", "background_sample"}


def test_disjoint_split(spark):
    (ids, _), (urls, _) = column("pages", "page_id"), column("pages", "url")
    key = lambda u: re.sub("[0-9]+", "#", re.match(r"[a-z]+://([^/:?#]+)", u).group(1).lower())
    want = {(i, hashed(key(u).encode(), (13, 32)) % 100 < 30) for i, u in zip(ids, urls)}
    assert {(r.page_id, r.test) for r in catalog.QUERIES["l05_campaign_disjoint_split"](spark, SF).collect()} == want
    assert len({t for _, t in want}) == 2


def newton(x, y):
    """Balanced logistic regression over standardised columns with the usual penalty, by Newton's method."""
    deviation = x.std(axis=0, ddof=1)
    x = np.c_[np.where(deviation > 0, (x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1), 0), np.ones(len(x))]
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    penalty = np.r_[np.ones(x.shape[1] - 1), 0]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * beta)
    return beta[:-1]


def test_regression(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(400, 2)) * [1, 30], np.full(400, 4.0), rng.integers(0, 3, 400)]
    y = (x[:, 0] - x[:, 1] / 40 + rng.normal(size=400) > 0.8).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, same double, c double, y double")
    got = {r.feature: r for r in regression(rows, ["a", "b", "same", "c"]).collect()}
    want = newton(x, y)
    for k, n in enumerate(["a", "b", "same", "c"]):
        assert abs(got[n].coefficient - want[k]) < 1e-3
        assert abs(got[n].share - abs(want[k]) / np.abs(want).sum()) < 1e-3
    assert regression(rows.limit(0), ["a", "b"]).collect() == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_twelve_features(spark):
    """The query fits all twelve features; tokens of brands speak for an imitation."""
    got = {r.feature: r for r in catalog.QUERIES["l07_logistic_regression"](spark, SF).collect()}
    assert len(got) == 12 and abs(sum(r.share for r in got.values()) - 1) < 1e-9
    assert got["keyword_count"].coefficient > 0
