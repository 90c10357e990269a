import random

from pyspark.sql import functions as F

from certloom.llm import toxicity as T


def test_held_out_accuracy_and_range(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    toxic, said = sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    print(len(rows), toxic, said, hit)
    assert hit >= 0.9 * toxic and hit >= 0.95 * said


def test_odd_rows(spark):
    rng = random.Random(1)
    text = lambda bad: " ".join(rng.choice(["sun", "sea", "YOU", "tree"] + ["1d1ot", "scum", "stuuupid"] * bad) for _ in range(30))
    rows = [(i, text(i % 3 == 0)) for i in range(200)] + [(500, None), (501, ""), (None, "you scum"), (7, "you scum"), (502, "x" * 100_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(200)] + [(3, 1), (4, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("row", F.lit(2))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.fit(docs, known).transform(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert next(r.score for r in out if r.row.doc_id is None) > next(r.score for r in out if r.row.doc_id == 501)
    assert {r.score for r in T.fit(docs, known.limit(0)).transform(docs).collect()} == {0.0}
    assert T.fit(docs.limit(0), known).transform(docs.limit(0)).count() == 0
