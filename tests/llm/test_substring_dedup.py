import hashlib
import random
import re

from pyspark.sql import functions as F

from certloom.llm import substring_dedup as S


def brute(rows):
    """Expected digest rows by the definition, over (doc_id, text)."""
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[j : j + 50])] < i:
                keep[j : j + 50] = [False] * 50
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in S.substring_dedup(df).select("doc", "n_words", "n_removed", "kept_sha256").collect()], key=str)


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_random_passages(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 77, 120, 300)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(90))]
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            w += p[a:] if rng.random() < 0.5 else p
        rows.append((i * 3 % 61, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200, rows[5][1]), (200, rows[6][1]), (200, rows[6][1]), (None, rows[7][1]), (201, None), (202, ""), (203, "x y   z"), (204, "same line " * 3000), (205, "same line " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("cells", F.lit(1)).withColumn("starts", F.lit("x"))
    assert got(df) == brute(rows)


def test_empty_table_and_stage(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "en", 9, 1), (2, "a  b " + text + " c", "en", 9, 2), (3, "x\ny", None, None, 3)], "doc_id long, text string, lang string, n_chars long, row int")
    out = {r.doc_id: r for r in S.stage(spark, df, "").collect()}
    assert out[1].text == text and out[2].text == "a b c" and out[2].n_chars == 5 and out[3].text == "x\ny" and out[2].row == 2


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert got(d) == brute(rows)
