"""Data sets for models: de-duplication, negatives, splits, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.storage import materialise
from ..tables import HOSTS, hosts, table
from .metrics import floor_index, nearest_rank


@query(f"SELECT key, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(host, '[0-9]+', '#', 'g') AS key FROM {HOSTS}) GROUP BY 1")
def l01_deduplicated_positives(spark, sf):
    return hosts(spark, sf).groupBy(F.regexp_replace("host", "[0-9]+", "#").alias("key")).agg(F.min("page_id").alias("page_id"))


@query(f"SELECT DISTINCT host FROM {HOSTS} WHERE contains(split_part(host, '.', 1), 'th') AND host NOT IN (SELECT host FROM {HOSTS} WHERE contains(url, 'ref='))")
def l02_hard_negatives(spark, sf):
    h = hosts(spark, sf)
    return h.filter(F.substring_index("host", ".", 1).contains("th")).select("host").distinct().join(h.filter("contains(url, 'ref=')").select("host"), "host", "left_anti")


@query("SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, CASE WHEN count(*) FILTER (quality = 1) < 5000 THEN 'stop' ELSE 'go' END AS rule FROM labels")
def l03_counts_with_stop_rule(spark, sf):
    c = table(spark, sf, "labels").agg(F.sum((F.col("quality") == 1).cast("long")).alias("positives"), F.sum((F.col("quality") == 0).cast("long")).alias("negatives"))
    return c.withColumn("rule", F.when(F.col("positives") < 5000, "stop").otherwise("go"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT doc_id, doc_id >= (SELECT doc_id FROM r WHERE rn = floor(0.67 * (n - 1)) + 1) AS test FROM labels")
def l04_temporal_split(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("all"))
    cut = nearest_rank(l, ["all"], "doc_id", 0.67, floor_index).select(F.col("value").alias("cut"))
    return l.crossJoin(cut).select("doc_id", (F.col("doc_id") >= F.col("cut")).alias("test"))


@query()
def l05_campaign_disjoint_split(spark, sf):
    """A campaign key falls on one side as a whole, by its hash."""
    key = F.regexp_replace("host", "[0-9]+", "#")
    return hosts(spark, sf).select("page_id", (F.pmod(F.xxhash64(key, F.lit(13)), F.lit(100)) < 30).alias("test"))


def regression(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, coefficient, share of all absolute coefficients) of a logistic regression of ``y`` on standardised columns, classes
    weighted to equal sums, with the penalty of one row (L07, L08). Without rows of both classes all coefficients are 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    spark = rows.sparkSession
    n, share = rows.agg(F.count("y"), F.avg("y")).first()
    values = [0.0] * len(names)
    if n and 0 < share < 1:
        weighed = rows.select("y", *[F.col(c).cast("double").alias(c) for c in names]).withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        raw = VectorAssembler(inputCols=names, outputCol="raw").transform(weighed)
        scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
        model = LogisticRegression(labelCol="y", weightCol="w", maxIter=200, tol=1e-9, regParam=1.0 / n, standardization=False).fit(scaled)
        values = [float(c) for c in model.coefficients]
    total = sum(map(abs, values)) or 1.0
    return spark.createDataFrame([(k, c, abs(c) / total) for k, c in zip(names, values)], "feature string, coefficient double, share double")


@query()
def l07_logistic_regression(spark, sf):
    """Regression over the twelve features of triage (L06-L08): names that registrants make of hosts against the hosts themselves."""
    from .triage import FEATURES, triage

    real = hosts(spark, sf).select(F.col("host").alias("name")).distinct().withColumn("real", F.lit(True))
    named = triage(spark, sf).join(real, "name", "left").withColumn("y", F.col("real").isNull().cast("double"))
    return regression(materialise(named.select("y", *FEATURES), "features"), list(FEATURES))
