"""Streams over tables that land in turns: each turn is a query of its own that goes on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.ranks import mean_ranks
from ..operators.metrics import SCORED, scored
from ..streaming.bounded import RecentKeys, Throttle
from ..streaming.sightings import Sightings
from ..tables import MESSAGES, messages
from .landed import folder
from .segments import read_segments

TURNS = 3
HOUR_US = 3_600_000_000


def in_turns(rows: DataFrame, schema: str, step) -> None:
    """Land the rows of each turn in the order of ``turn`` (0 to TURNS - 1) and run ``step`` on the stream of all that has landed."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, "turns")
    for k in range(TURNS):
        rows.filter(F.col("turn") == k).drop("turn").write.mode("append").parquet(path)
        step(spark.readStream.schema(schema).parquet(path)).awaitTermination()


ARRIVALS = f"""(SELECT 'u' || cert || '.example.org' AS name, cert, idx, us, CASE WHEN value < 10 THEN 2 ELSE t END AS turn FROM (SELECT *, least(2, floor(3.0 * (us - lo) / (hi - lo + 1)))::INT AS t FROM {MESSAGES}, (SELECT min(us) AS lo, max(us) AS hi FROM {MESSAGES}))
 UNION ALL SELECT 'u' || cert || '.example.org', cert, idx, us, 2 FROM {MESSAGES} WHERE value >= 95)"""


def arrivals(spark, sf) -> DataFrame:
    """(name, cert, idx, us, turn): messages arrive by thirds of their time, those of low value in the last turn, those of high value there once more."""
    rows = messages(spark, sf)
    ends = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))  # one row
    third = F.least(F.lit(2), F.floor(F.lit(3.0) * (F.col("us") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)).cast("int"))
    own = rows.crossJoin(F.broadcast(ends)).withColumn("turn", F.when(F.col("value") < 10, 2).otherwise(third))
    name = F.concat(F.lit("u"), F.col("cert").cast("string"), F.lit(".example.org")).alias("name")
    again = own.filter("value >= 95").withColumn("turn", F.lit(2))
    return own.unionByName(again).select(name, "cert", "idx", "us", "turn")


@query(f"""WITH a AS {ARRIVALS}, m AS (SELECT turn, max(us) AS us FROM a GROUP BY 1), w AS (SELECT t.turn, (SELECT max(us) FROM m WHERE m.turn < t.turn) - {HOUR_US} AS watermark FROM m t),
 r AS (SELECT a.*, coalesce((us // {HOUR_US} + 1) * {HOUR_US} <= watermark, false) AS late FROM a JOIN w USING (turn))
 SELECT 'index' AS part, name, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (late)::BIGINT AS n FROM r GROUP BY name
 UNION ALL SELECT 'window', NULL, us // {HOUR_US} * {HOUR_US}, NULL, count(*) FROM r WHERE NOT late GROUP BY us // {HOUR_US}""")
def t05_late_rows(spark, sf):
    """First and last sightings of each name with its late rows, and rows of each hour without them, kept by one stream."""
    kept, progress = Sightings(spark, folder(spark, "sightings"), HOUR_US, HOUR_US), folder(spark, "progress")
    in_turns(arrivals(spark, sf).select("name", "us", "turn"), "name string, us bigint", lambda rows: kept.follow(rows, progress))
    index = kept.index().select(F.lit("index").alias("part"), "name", "first_us", "last_us", F.col("late").alias("n"))
    hours = kept.windows().select(F.lit("window").alias("part"), F.lit(None).cast("string").alias("name"), F.col("window_us").alias("first_us"), F.lit(None).cast("bigint").alias("last_us"), "n")
    return index.unionByName(hours)


#: Of the table's certificates, those that are remembered between turns; a production stream remembers bounded.CAPACITY.
REMEMBERED = 100


@query(f"""WITH a AS {ARRIVALS}, k AS (SELECT turn, cert::VARCHAR AS key, min(us) AS us, max(us) AS last FROM a GROUP BY 1, 2),
 s0 AS (SELECT key, last FROM k WHERE turn = 0 ORDER BY last DESC, key LIMIT {REMEMBERED}),
 s1 AS (SELECT key, max(last) AS last FROM (SELECT key, last FROM k WHERE turn = 1 UNION ALL SELECT * FROM s0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {REMEMBERED})
 SELECT key, us FROM k WHERE turn = 0 UNION ALL SELECT key, us FROM k WHERE turn = 1 AND key NOT IN (SELECT key FROM s0) UNION ALL SELECT key, us FROM k WHERE turn = 2 AND key NOT IN (SELECT key FROM s1)""")
def t01_recent_keys(spark, sf):
    """One copy of each certificate among the newest that are remembered; forgotten ones are given again."""
    kept, progress = RecentKeys(spark, folder(spark, "recent"), REMEMBERED), folder(spark, "progress")
    rows = arrivals(spark, sf).select(F.col("cert").cast("string").alias("key"), "us", "turn")
    in_turns(rows, "key string, us bigint", lambda stream: kept.follow(stream, progress))
    return kept.rows().select("key", "us")


@query(f"""WITH a AS (SELECT idx, (us // 36000)::BIGINT AS us, value >= 90 AS candidate, idx % 3 AS turn FROM {MESSAGES}),
 p AS (SELECT *, us // 1000000 AS second, row_number() OVER (PARTITION BY turn, us // 1000000, candidate ORDER BY us, idx) AS place FROM a),
 c AS (SELECT second, count(*) FILTER (candidate AND turn = 0) AS c0, count(*) FILTER (NOT candidate AND turn = 0) AS o0, count(*) FILTER (candidate AND turn = 1) AS c1, count(*) FILTER (NOT candidate AND turn = 1) AS o1, count(*) FILTER (candidate AND turn = 2) AS c2 FROM p GROUP BY 1),
 g0 AS (SELECT *, c0 + least(o0, greatest(20 - c0, 0)) AS t0 FROM c), g1 AS (SELECT *, t0 + c1 + least(o1, greatest(20 - t0 - c1, 0)) AS t1 FROM g0)
 SELECT idx, candidate FROM p JOIN g1 USING (second) WHERE candidate OR place + CASE turn WHEN 0 THEN c0 WHEN 1 THEN t0 + c1 ELSE t1 + c2 END <= 20""")
def t08_throttled_stream(spark, sf):
    """A feed of at most 20 rows a second, candidates first, replayed at 36,000 times its speed; a third of the rows arrives in each turn."""
    kept, progress = Throttle(spark, folder(spark, "throttled")), folder(spark, "progress")
    rows = messages(spark, sf).select("idx", F.floor(F.col("us") / 36_000).alias("us"), (F.col("value") >= 90).alias("candidate"), (F.col("idx") % 3).alias("turn"))
    in_turns(rows, "idx bigint, us bigint, candidate boolean", lambda stream: kept.follow(stream, progress))
    return kept.rows().select("idx", "candidate")


@query(f"SELECT idx, operator, us, 1 AS times FROM {MESSAGES}")
def s03_resumed_segments(spark, sf):
    """Messages as lines of segments that land in turns, each read by a query that goes on where the one before it was ended; each line once."""
    path, out, progress = folder(spark, "segments"), folder(spark, "read"), folder(spark, "progress")
    rows = messages(spark, sf).withColumn("turn", F.col("idx") % TURNS)
    for k in range(TURNS):
        line = F.to_json(F.struct("idx", "operator", "us")).alias("value")
        rows.filter(F.col("turn") == k).select(line).write.text(f"{path}/{k:06d}")
        read_segments(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema("value string, segment string, at bigint").parquet(out)
    told = lines.select(F.from_json("value", "idx bigint, operator string, us bigint").alias("m")).select("m.*")
    return told.groupBy("idx", "operator", "us").agg(F.count("*").cast("int").alias("times"))


@query(f"SELECT doc_id, round(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0, 1) AS rank FROM {SCORED}")
def w07_score_ranks(spark, sf):
    """Each document's rank by score, ties at their mean."""
    rows = scored(spark, sf)
    return rows.select("doc_id", "score").join(mean_ranks(rows, "score"), "score").select("doc_id", F.round("rank", 1).alias("rank"))
