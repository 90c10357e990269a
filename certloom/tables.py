"""The given tables as the engine's inputs. Timestamps without zone become microseconds since 1970, in UTC by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of small columns that one task takes where much is made of each.
TASK_ROWS = 50_000

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({} as timestamp_ntz))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, *by: str, rows: int = TASK_ROWS) -> DataFrame:
    """The same rows by hash in partitions of about ``rows`` each, and at least one for each core; a number that is given is not reduced afterwards."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as certificate messages: cert, operator, log index, capture run (hour), time in microseconds, score."""
    us = F.expr(MICROS.format("ts"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("idx"), F.col("user_id").alias("cert"), F.col("event_type").alias("operator"), us.alias("us"), F.floor(us / 3_600_000_000).alias("run"), "value"
    )


#: The same view for the oracle.
MESSAGES = "(SELECT event_id AS idx, user_id AS cert, event_type AS operator, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS run, value FROM events)"


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` with the host of each URL, in lower case."""
    return table(spark, sf, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))


HOSTS = r"(SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """All of ``lineitem`` as domain-infrastructure edges; large quantities with some return flags are strong or medium, the rest weak."""
    large = F.col("l_quantity") >= 49
    weight = F.when(large & (F.col("l_returnflag") == "A"), 0.85).when(large & (F.col("l_returnflag") == "N"), 0.35).otherwise(0.15)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("domain"), F.col("l_partkey").alias("node")).agg(F.max(weight).alias("weight"))


EDGES = "(SELECT l_orderkey AS domain, l_partkey AS node, max(CASE WHEN l_quantity >= 49 AND l_returnflag = 'A' THEN 0.85 WHEN l_quantity >= 49 AND l_returnflag = 'N' THEN 0.35 ELSE 0.15 END)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """(campaign, domain, node, weight): parts as domains, their suppliers as nodes, part sizes as campaigns."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").alias("campaign"), F.col("l_partkey").alias("domain"), F.col("l_suppkey").alias("node")).distinct()


DEPENDENCIES = "(SELECT DISTINCT p_size AS campaign, l_partkey AS domain, l_suppkey AS node FROM lineitem JOIN part ON l_partkey = p_partkey)"


def count_if(condition: str):
    """Rows for which an SQL condition holds."""
    return F.count_if(F.expr(condition))
