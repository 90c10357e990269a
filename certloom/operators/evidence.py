"""Evidence: Merkle roots of all groups together, re-verification, attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.storage import materialise
from ..tables import table


def merkle_roots(leaves: DataFrame, group: str, name: str, sha: str) -> DataFrame:
    """(group, root) over the name-sorted leaves of each group; all groups advance together, an odd node is promoted."""
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.col(name).cast("binary"), F.unhex(F.lit("00")), F.unhex(sha)), 256)
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (group, name), so a large group is numbered by several tasks: its place in the range, and the counts of ranges before
    ranged = materialise(leaves.select(group, name, leaf.alias("h")).repartitionByRange(parts, group, name).withColumn("part", F.spark_partition_id()), "leaves")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("n")).select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(name)) - 1
    level = ranged.withColumn("own", place).join(counts, [group, "part"]).select(group, (F.col("before") + F.col("own")).alias("i"), "h")
    level = materialise(level, "merkle")
    while (level.agg(F.max("i")).first()[0] or 0) > 0:
        half = level.groupBy(group, F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", F.col("i")).alias("l"), F.max_by("h", F.col("i")).alias("r"), F.count("*").alias("n"))
        level = materialise(half.select(group, "i", F.when(F.col("n") == 1, F.col("l")).otherwise(F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)).alias("h")), "merkle")
    return level.select(group, F.col("h").alias("root"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(bundle, name, status): missing, unexpected, hash_mismatch or valid."""
    j = recorded.withColumnRenamed("sha", "a").join(found.withColumnRenamed("sha", "b"), ["bundle", "name"], "full_outer")
    return j.select("bundle", "name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "hash_mismatch").otherwise("valid").alias("status"))


@query()
def a30_merkle_roots(spark, sf):
    d = table(spark, sf, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.sha2("text", 256).alias("sha"))
    return merkle_roots(d, "source", "name", "sha")


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS size FROM documents")
def s22_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' WHEN a.h <> b.h THEN 'hash_mismatch' ELSE 'valid' END AS status FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars >= 60) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN lang ELSE text END) AS h FROM documents WHERE n_chars < 4000) b USING (doc_id)) GROUP BY 1")
def a41_reverification(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("name"), "text", "lang", "n_chars")
    a = d.filter("n_chars >= 60").select("bundle", "name", F.sha2("text", 256).alias("sha"))
    b = d.filter("n_chars < 4000").select("bundle", "name", F.sha2(F.when(F.col("lang") == "es", F.col("lang")).otherwise(F.col("text")), 256).alias("sha"))
    return verify(a, b).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT o_custkey, o_orderpriority, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict FROM orders GROUP BY 1, 2) SELECT o_custkey, count(*) AS organisations, count(DISTINCT verdict) > 1 OR bool_or(verdict = 'P') AS disputed FROM l GROUP BY 1")
def a40_attestations(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("verdict"))
    return last.groupBy("o_custkey").agg(F.count("*").alias("organisations"), ((F.count_distinct("verdict") > 1) | F.bool_or(F.col("verdict") == "P")).alias("disputed"))
