import numpy as np
from pyspark.sql import functions as F

from certloom.llm import neighbours as N


def brute(rows, every, k=20):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok], np.float64)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = (m * m[n]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(40)] + rng.normal(size=8) * 0.3]) for i in range(6000)]
    rows += [(10_000 + i, rows[17][1]) for i in range(3000)]  # a vector that a third of all rows share
    odd = [(20_000, None), (20_020, [0.0] * 8), (20_040, [1.0] * 7 + [None]), (20_060, [float("nan")] * 8), (20_080, [1.0]), (None, [1.0] * 8), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(0))
    want = brute(rows + odd, 20)
    # fitted on all distinct vectors but few, and on a sample far smaller than the table with many groups
    for more in ({}, {"sample": 400, "group_numbers": 8 * 500}):
        check_lists(N.nearest(df, "vec_id", "embedding", F.expr("id % 20 = 0"), **more).collect(), want, rows)


def check_lists(found_rows, want, rows):
    got = {}
    for r in found_rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    found = total = 0
    for q, w in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        found += len({i for _, i, _ in mine} & {i for i, _ in w})
        total += 20
    assert found / total >= 0.95
    same = [i for i, v in rows if v == rows[17][1] and i % 20 == 0]
    assert all([i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]] for q in same)


def test_search_visits_few_leaves():
    """Clustered vectors, searched through trees fitted without them; the recall is that of unsampled rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 16)) * 3
    rows = centres[rng.integers(200, size=20_000)] + rng.normal(size=(20_000, 16)) * 0.5
    ids, queries = np.arange(20_000), rows[:400] + rng.normal(size=(400, 16)) * 0.1
    truth = np.argsort(-(queries @ rows.T), axis=1)[:, :20]
    upper = N.Upper(rows[rng.permutation(20_000)[:2_000]], 16, 20)
    bounds = upper.bounds(queries)
    q, own, _, share = N.search(rows, ids, queries, bounds, np.zeros(400, bool), 20)
    hit = {(a, b) for a, b in zip(q.tolist(), own.tolist())}
    recall = np.mean([(a, b) in hit for a in range(400) for b in truth[a]])
    print("recall", recall, "share of leaves", share)
    assert recall >= 0.9 and share < 0.5
    upper.sizes = np.bincount(upper.tree.assign(rows), minlength=len(upper.sizes))
    group = upper.tree.assign(rows)
    upper.calibrate(queries, np.repeat(np.arange(400), 20), group[truth].ravel())
    visited = [set(own) for _, own, _ in upper.visits(queries)]
    assert np.mean([group[b] in visited[a] for a in range(400) for b in truth[a]]) >= N.UPPER_TARGET and np.mean([len(v) for v in visited]) < 0.6 * len(upper.sizes)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (40, [3.0, 1.0])], "vec_id long, embedding array<float>")
    ask = lambda d: sorted(tuple(r) for r in N.nearest(d, "vec_id", "embedding", F.expr("id % 20 = 0")).collect())
    assert ask(df) == [(0, 1, 40, 5.0), (0, 2, 1, 1.5), (40, 1, 0, 5.0), (40, 2, 1, 2.0)]
    assert ask(df.limit(0)) == [] and ask(df.limit(1)) == []


def test_table_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids, m = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got = {}
    for r in N.op6_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in got:
        s = m @ rows[q]
        s[ids == q] = -9
        found += len(got[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    print("recall", found / 20 / len(got))
    assert len(got) == sum(i % 20 == 0 for i in rows) and found / 20 / len(got) >= 0.9
