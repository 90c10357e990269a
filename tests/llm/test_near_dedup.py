import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from certloom.llm import near_dedup as N


def bag(t):
    w = (t or "").encode().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(rows):
    """Class of each row by all pairs."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                least = sum((bags[i] & bags[j]).values())
                if least / sum((bags[i] | bags[j]).values()) >= 0.8:
                    parent[root(i)] = root(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            classes[root(i)] = min(classes.get(root(i), d), d)
    return sorted(((d, classes.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_registers_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    key = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
    b[:30] = a[:30]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for turn in range(40):
        k = N.mix(key, np.full(60, turn + 1, np.uint64))
        s = N.bag_minhash(np.repeat([0, 1], 60), np.r_[k, k], np.r_[a, b], 2)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.02 and N.bag_minhash(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1).shape == (1, 120)


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(3000)
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 120, 200]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(5, rows[3][1]), (5, rows[4][1]), (6, "again " * 50), (7, "again " * 55), (8, "again " * 90), (9, None), (10, ""), (11, "  "), (None, rows[0][1]), (None, "solo words only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("doc", F.lit(1))
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert N.near_duplicates(df.limit(0)).count() == 0
    kept = N.stage(spark, df, "").select("doc_id", "text").collect()
    assert {(r.doc_id) for r in kept if (r.text or "").strip() and r.doc_id is not None} == {c for d, c in brute(rows) if c is not None} - {9, 10, 11}


def test_star_whose_centre_is_not_the_smallest(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(60):  # each is near the base, few are near each other
        w = list(base)
        for k in rng.sample(range(150), 3):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_stage_keeps_one_row_of_each_class(spark):
    """By row, not by id: rows that repeat an id with other texts stay, copies under null ids go."""
    rng = random.Random(12)
    text = lambda: " ".join("v%d" % rng.randrange(5000) for _ in range(90))
    a, b, c, d = text(), text(), text(), text()
    near = " ".join(["x"] + a.split()[1:])
    rows = [(3, a), (5, a), (5, b), (5, c), (7, b), (None, a), (None, a), (None, d), (None, d), (9, near), (5, c), (11, None), (12, " "), (None, None)]
    df = spark.createDataFrame([(i, t, k, "z") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key_a int, row string")
    kept = [(r.doc_id, r.text) for r in N.stage(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (5, c), (None, d), (11, None), (12, " "), (None, None)], key=str)
    assert N.stage(spark, df, "").columns == df.columns and N.stage(spark, df.limit(0), "").count() == 0


def test_given_table_against_all_pairs(spark):
    """All documents of a given table: classes equal those of every pair that shares a shingle."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bags, holders, parent = [bag(t) for _, t in rows], {}, list(range(len(rows)))
    for i, x in enumerate(bags):
        for s in x:
            holders.setdefault(s, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = [sum(x.values()) for x in bags]
    for i, x in enumerate(bags):
        common = Counter()
        for s, n in x.items():
            for j in holders[s]:
                if j < i:
                    common[j] += min(n, bags[j][s])
        for j, n in common.items():
            if n / (total[i] + total[j] - n) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    want = sorted((d, least[root(i)]) for i, (d, _) in enumerate(rows))
    got = sorted((r.doc_id, r.class_id) for r in N.op10_near_dedup(spark, sf).collect())
    assert got == want and any(a != b for a, b in want)
