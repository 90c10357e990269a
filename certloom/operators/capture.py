"""Capture integrity: duplicates, coverage, gaps, sightings, lead time, rates (operators A01-A09, A23-A29, J12-J15, W01-W10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import MESSAGES, count_if, messages

#: Fixed value: a silence of at least this many microseconds is a gap.
GAP_US = 300_000_000
MINUTE = 60_000_000


def gaps(stream: DataFrame, time: str = "us", bucket_us: int = 86_400_000_000, gap_us: int = GAP_US) -> DataFrame:
    """(start, end) of silences. Times are ordered within days only; the edges of days are stitched by their first and
    last times, so no task sorts the whole stream."""
    days = stream.select(F.floor(F.col(time) / bucket_us).alias("day"), F.col(time).alias("t"))
    inside = days.withColumn("next", F.lead("t").over(Window.partitionBy("day").orderBy("t"))).filter(F.col("next") - F.col("t") >= gap_us).select("t", "next")
    ends = days.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row a day
    across = ends.withColumn("next", F.lead("first").over(Window.orderBy("day"))).select(F.col("last").alias("t"), "next").filter(F.col("next") - F.col("t") >= gap_us)
    return inside.union(across).select(F.col("t").alias("start_us"), F.col("next").alias("end_us"))


GAPS = f"(SELECT us AS start_us, nxt AS end_us FROM (SELECT us, lead(us) OVER (ORDER BY us) AS nxt FROM {MESSAGES}) WHERE nxt - us >= {GAP_US})"


def earliest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


@query(f"""WITH m AS {MESSAGES} SELECT operator, count(*) AS messages, count(DISTINCT cert) AS certs, count(DISTINCT us // {MINUTE}) AS minutes,
 round(1 - count(DISTINCT cert) / count(*), 6) AS duplicate_share, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY operator""")
def capture_integrity(spark, sf):
    m = messages(spark, sf)
    return m.groupBy("operator").agg(
        F.count("*").alias("messages"), F.count_distinct("cert").alias("certs"), F.count_distinct(F.floor(F.col("us") / MINUTE)).alias("minutes"),
        F.round(1 - F.count_distinct("cert") / F.count("*"), 6).alias("duplicate_share"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )


@query(f"SELECT operator, count(*) AS n FROM {MESSAGES} GROUP BY ROLLUP (operator)")
def a07_operator_rollup(spark, sf):
    return messages(spark, sf).rollup("operator").agg(F.count("*").alias("n"))


@query(f"SELECT operator, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {MESSAGES} GROUP BY operator")
def a07_operator_share(spark, sf):
    by = messages(spark, sf).groupBy("operator").agg(F.count("*").alias("n"))
    return by.crossJoin(by.agg(F.sum("n").alias("total"))).select("operator", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY cert ORDER BY us, idx) AS nth, first_value(run) OVER (PARTITION BY cert ORDER BY us, idx) AS first_run FROM {MESSAGES})
 SELECT count(*) FILTER (nth > 1) AS same_cert, count(*) FILTER (nth > 1 AND run <> first_run) AS across_runs, count(*) AS messages FROM m""")
def a06_duplicates(spark, sf):
    w = Window.partitionBy("cert").orderBy("us", "idx")
    m = messages(spark, sf).withColumn("nth", F.row_number().over(w)).withColumn("first_run", F.first("run").over(w))
    return m.agg(count_if("nth > 1").alias("same_cert"), count_if("nth > 1 and run <> first_run").alias("across_runs"), F.count("*").alias("messages"))


@query(f"SELECT cert, min(us) AS first_us FROM {MESSAGES} GROUP BY cert")
def a01_first_sighting(spark, sf):
    return messages(spark, sf).groupBy("cert").agg(F.min("us").alias("first_us"))


@query(f"SELECT cert, idx, us FROM (SELECT *, row_number() OVER (PARTITION BY cert ORDER BY us, idx) AS n FROM {MESSAGES}) WHERE n = 1")
def w01_earliest_copy(spark, sf):
    return earliest(messages(spark, sf), ["cert"], "us", "idx").select("cert", "idx", "us")


@query(f"SELECT cert, operator, idx FROM (SELECT *, row_number() OVER (PARTITION BY cert ORDER BY us DESC, idx DESC) AS n FROM {MESSAGES}) WHERE n = 1")
def w02_latest_row(spark, sf):
    m = messages(spark, sf)
    last = m.groupBy("cert").agg(F.max(F.struct("us", "idx", "operator")).alias("m"))
    return last.select("cert", "m.operator", "m.idx")


@query(f"SELECT cert, max(us) FILTER (n = 2) - min(us) FILTER (n = 1) AS delay_us FROM (SELECT cert, us, row_number() OVER (PARTITION BY cert ORDER BY us) AS n FROM (SELECT DISTINCT cert, us FROM {MESSAGES})) WHERE n <= 2 GROUP BY cert")
def w08_first_and_second(spark, sf):
    m = messages(spark, sf).select("cert", "us").distinct().withColumn("n", F.row_number().over(Window.partitionBy("cert").orderBy("us"))).filter("n <= 2")
    return m.groupBy("cert").agg((F.max(F.when(F.col("n") == 2, F.col("us"))) - F.min(F.when(F.col("n") == 1, F.col("us")))).alias("delay_us"))


@query(f"""WITH d AS (SELECT lead(us) OVER (PARTITION BY cert ORDER BY us) - us AS x, row_number() OVER (PARTITION BY cert ORDER BY us) AS n FROM (SELECT DISTINCT cert, us FROM {MESSAGES})),
 r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS c FROM d WHERE n = 1 AND x IS NOT NULL)
 SELECT greatest(1800, ceil(x / 1e6 / 1800) * 1800)::BIGINT AS window_s, c AS names FROM r WHERE rn = floor(0.99 * (c - 1) + 0.5) + 1""")
def a25_resighting_window(spark, sf):
    from .metrics import nearest_rank

    d = w08_first_and_second(spark, sf).filter("delay_us is not null").withColumn("all", F.lit(1))
    p = nearest_rank(d, ["all"], "delay_us", 0.99)
    return p.select(F.greatest(F.lit(1800), F.ceil(F.col("value") / 1e6 / 1800) * 1800).cast("long").alias("window_s"), F.col("n").alias("names"))


@query(f"SELECT start_us, end_us FROM {GAPS}")
def w09_gaps(spark, sf):
    return gaps(messages(spark, sf))


@query(f"""WITH g AS {GAPS}, gm AS (SELECT DISTINCT unnest(range(start_us // {MINUTE} + 1, end_us // {MINUTE})) AS minute FROM g),
 m AS (SELECT DISTINCT operator, us // {MINUTE} AS minute FROM {MESSAGES}) SELECT operator, count(*) AS covered, count(*) FILTER (minute IN (SELECT minute FROM gm)) AS in_gaps FROM m GROUP BY operator""")
def a08_coverage(spark, sf):
    m = messages(spark, sf)
    low, high = F.floor(F.col("start_us") / MINUTE) + 1, F.floor(F.col("end_us") / MINUTE) - 1
    silent = gaps(m).filter(low <= high).select(F.explode(F.sequence(low, high)).alias("minute")).distinct().withColumn("gap", F.lit(1))
    minutes = m.select("operator", F.floor(F.col("us") / MINUTE).alias("minute")).distinct()
    return minutes.join(silent, "minute", "left").groupBy("operator").agg(F.count("*").alias("covered"), F.count("gap").alias("in_gaps"))


@query(f"""WITH s AS (SELECT us, CASE WHEN us - lag(us) OVER (ORDER BY us) >= {GAP_US} THEN 1 ELSE 0 END AS new FROM {MESSAGES}), n AS (SELECT us, sum(new) OVER (ORDER BY us ROWS UNBOUNDED PRECEDING) AS seg FROM s)
 SELECT min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM n GROUP BY seg""")
def t10_segments(spark, sf):
    return segments(messages(spark, sf).select("us"))


def segments(stream: DataFrame, time: str = "us", bucket_us: int = 86_400_000_000, gap_us: int = GAP_US) -> DataFrame:
    """(start_us, last_us, n) of stretches without a silence (T10). Stretches are found within days; those that go on across
    the edge of days are put together by one row a day."""
    days = stream.select(F.floor(F.col(time) / bucket_us).alias("day"), F.col(time).alias("t"))
    w = Window.partitionBy("day").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap_us).cast("int"), F.lit(0))
    inside = days.withColumn("new", new).withColumn("part", F.sum("new").over(w)).groupBy("day", "part").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("n"))
    edges = inside.groupBy("day").agg(F.min("start").alias("first"), F.max("last").alias("end"), F.max("part").alias("parts"))
    order = Window.orderBy("day")  # one row a day
    apart = F.coalesce((F.col("first") - F.lag("end").over(order) >= gap_us).cast("int"), F.lit(0))
    more = (F.col("parts") > 0).cast("int")
    chains = edges.withColumn("apart", apart).withColumn("after", F.sum(F.col("apart") + more).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.select("day", "parts", "after", (F.col("after") - more).alias("before"))
    # the first stretch of a day belongs to the chain that comes in, the last to the one that goes out, others to themselves
    chain = F.when(F.col("part") == 0, F.col("before")).when(F.col("part") == F.col("parts"), F.col("after"))
    own = F.when(chain.isNull(), F.struct("day", "part"))
    joined = inside.join(chains, "day").groupBy(chain.alias("chain"), own.alias("own")).agg(F.min("start").alias("start_us"), F.max("last").alias("last_us"), F.sum("n").alias("n"))
    return joined.select("start_us", "last_us", "n")


@query(f"""SELECT max(us - prev) AS gap_us, max_by(us, us - prev) AS at_us FROM (SELECT us, lag(us) OVER (ORDER BY us) AS prev FROM (SELECT DISTINCT us FROM {MESSAGES} WHERE value >= 90))""")
def w10_largest_candidate_gap(spark, sf):
    g = gaps(messages(spark, sf).filter("value >= 90").select("us").distinct(), gap_us=1)
    return g.agg(F.max(F.col("end_us") - F.col("start_us")).alias("gap_us"), F.max_by("end_us", F.col("end_us") - F.col("start_us")).alias("at_us"))


@query(f"SELECT count(DISTINCT cert) AS certs, count(*) AS messages FROM {MESSAGES} WHERE cert IN (SELECT cert FROM {MESSAGES} GROUP BY cert HAVING max(value) >= 200)")
def a09_candidates(spark, sf):
    m = messages(spark, sf)
    by = m.groupBy("cert").agg(F.max("value").alias("best"), F.count("*").alias("n")).filter("best >= 200")
    return by.agg(F.count("*").alias("certs"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


LISTED = f"(SELECT cert, min(us) FILTER (operator = 'view') AS seen, min(us) FILTER (operator = 'purchase') AS listed FROM {MESSAGES} GROUP BY cert)"


def lead_times(spark, sf):
    """First sighting and first listing of each host."""
    return messages(spark, sf).groupBy("cert").agg(F.min(F.when(F.col("operator") == "view", F.col("us"))).alias("seen"), F.min(F.when(F.col("operator") == "purchase", F.col("us"))).alias("listed"))


@query(f"SELECT cert, listed - seen AS lead_us FROM {LISTED} WHERE seen IS NOT NULL AND listed IS NOT NULL")
def j12_lead_time(spark, sf):
    return lead_times(spark, sf).filter("seen is not null and listed is not null").select("cert", (F.col("listed") - F.col("seen")).alias("lead_us"))


@query(f"""WITH l AS (SELECT listed - seen AS x FROM {LISTED} WHERE listed IS NOT NULL AND seen IS NOT NULL), r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM l)
 SELECT n, CASE WHEN n >= 10 THEN max(x) FILTER (rn = floor(0.5 * (n - 1) + 0.5) + 1) END AS median_us, CASE WHEN n >= 10 THEN max(x) FILTER (rn = floor(0.25 * (n - 1) + 0.5) + 1) END AS p25_us,
 CASE WHEN n >= 10 THEN max(x) FILTER (rn = floor(0.75 * (n - 1) + 0.5) + 1) END AS p75_us, CASE WHEN n >= 10 THEN max(x) END AS max_us, CASE WHEN n >= 10 THEN 'measured' ELSE 'withheld' END AS status FROM r GROUP BY n""")
def a24_lead_time_summary(spark, sf):
    from .metrics import half_up, percentiles

    enough = lambda c: F.when(F.col("n") >= 10, c)
    out = percentiles(j12_lead_time(spark, sf).withColumn("all", F.lit(1)), ["all"], "lead_us", {"m": half_up(0.5), "a": half_up(0.25), "b": half_up(0.75)}).withColumnRenamed("largest", "x")
    return out.select("n", enough(F.col("m")).alias("median_us"), enough(F.col("a")).alias("p25_us"), enough(F.col("b")).alias("p75_us"), enough(F.col("x")).alias("max_us"), F.when(F.col("n") >= 10, "measured").otherwise("withheld").alias("status"))


@query(f"""WITH p AS (SELECT DISTINCT us AS poll FROM {MESSAGES} WHERE operator = 'signup') SELECT l.cert, max(p.poll) AS previous_us FROM {LISTED} l LEFT JOIN p ON p.poll < l.listed - 60000000 WHERE l.listed IS NOT NULL GROUP BY l.cert""")
def j14_previous_poll(spark, sf):
    """As-of: union by time and carry the last poll forward, day by day; the last poll of earlier days is added from one row a day."""
    m = messages(spark, sf)
    day = F.floor(F.col("t") / 86_400_000_000).alias("day")
    polls = m.filter("operator = 'signup'").select(F.col("us").alias("t"), F.col("us").alias("poll"), F.lit(None).cast("long").alias("cert"), F.lit(1).alias("side"))
    asked = lead_times(spark, sf).filter("listed is not null").select((F.col("listed") - 60_000_000).alias("t"), F.lit(None).cast("long").alias("poll"), "cert", F.lit(0).alias("side"))
    both = polls.union(asked).select("*", day)
    inside = both.withColumn("near", F.last("poll", True).over(Window.partitionBy("day").orderBy("t", "side")))
    days = both.groupBy("day").agg(F.max("poll").alias("last"))
    before = days.withColumn("before", F.last("last", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "before")
    return inside.filter("side = 0").join(before, "day").select("cert", F.coalesce("near", "before").alias("previous_us"))


@query(f"SELECT l.cert, count(g.start_us) AS gaps FROM {LISTED} l LEFT JOIN {GAPS} g ON g.start_us < l.listed AND g.end_us > l.seen WHERE l.listed > l.seen GROUP BY l.cert")
def j15_gap_overlap(spark, sf):
    """Silences are disjoint, so those that overlap an interval are those that start before its end less those that end by its
    start. Both are running counts within days plus the counts of the days before; no pair of interval and silence is formed."""
    g, l = gaps(messages(spark, sf)), lead_times(spark, sf).filter("listed > seen")
    none, zero, one = F.lit(None).cast("long"), F.lit(0), F.lit(1)
    row = lambda t, side, cert, starts, ends, sign: F.struct(F.col(t).alias("t"), side.alias("side"), cert.alias("cert"), starts.alias("starts"), ends.alias("ends"), sign.alias("sign"))
    # at equal times: ends, then the intervals' own times, then starts
    points = g.select(F.inline(F.array(row("start_us", F.lit(2), none, one, zero, zero), row("end_us", zero, none, zero, one, zero))))
    asked = l.select(F.inline(F.array(row("listed", one, F.col("cert"), zero, zero, one), row("seen", one, F.col("cert"), zero, zero, F.lit(-1)))))
    both = points.union(asked).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    upto = Window.partitionBy("day").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("s", F.sum("starts").over(upto)).withColumn("e", F.sum("ends").over(upto)).filter("sign <> 0")
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = both.groupBy("day").agg(F.sum("starts").alias("ds"), F.sum("ends").alias("de")).select("day", F.coalesce(F.sum("ds").over(order), zero).alias("bs"), F.coalesce(F.sum("de").over(order), zero).alias("be"))
    count = F.when(F.col("sign") == 1, F.col("s") + F.col("bs")).otherwise(-(F.col("e") + F.col("be")))
    return inside.join(days, "day").groupBy("cert").agg(F.sum(count).alias("gaps"))


@query(f"SELECT operator, us // 5000000 * 5000000 AS start_us, count(*) AS certs, round(sum(value), 4) AS total FROM {MESSAGES} GROUP BY 1, 2")
def t03_tumbling_rates(spark, sf):
    m = messages(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    return m.groupBy("operator", F.window("ts", "5 seconds")).agg(F.count("*").alias("certs"), F.round(F.sum("value"), 4).alias("total")).select("operator", F.unix_micros("window.start").alias("start_us"), "certs", "total")


@query(f"SELECT operator, count(*) AS n, round(count(*) / ((max(us) - min(us)) / 1e6), 9) AS per_second FROM {MESSAGES} GROUP BY operator")
def a28_throughput(spark, sf):
    return messages(spark, sf).groupBy("operator").agg(F.count("*").alias("n"), F.round(F.count("*") / ((F.max("us") - F.min("us")) / 1e6), 9).alias("per_second"))


@query(f"SELECT operator, sum(ceil(n / 256))::BIGINT AS requests FROM (SELECT operator, run, count(*) AS n FROM {MESSAGES} GROUP BY 1, 2) GROUP BY operator")
def a29_request_estimate(spark, sf):
    return messages(spark, sf).groupBy("operator", "run").count().groupBy("operator").agg(F.sum(F.ceil(F.col("count") / 256)).cast("long").alias("requests"))


@query(f"SELECT cert, us // 60000000 AS minute, count(*) AS n FROM {MESSAGES} GROUP BY 1, 2 HAVING count(*) > 1")
def t13_rate_violations(spark, sf):
    return messages(spark, sf).groupBy("cert", F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"SELECT idx FROM (SELECT idx, value, row_number() OVER (PARTITION BY us // 3600000000 ORDER BY (value >= 90) DESC, us, idx) AS n FROM {MESSAGES}) WHERE n <= 20 OR value >= 90")
def t08_feed_throttle(spark, sf):
    w = Window.partitionBy(F.floor(F.col("us") / 3_600_000_000)).orderBy((F.col("value") >= 90).desc(), "us", "idx")
    return messages(spark, sf).withColumn("n", F.row_number().over(w)).filter("n <= 20 or value >= 90").select("idx")


@query(f"SELECT operator, max(us) AS last_us, CASE WHEN (SELECT max(us) FROM {MESSAGES}) - max(us) > 15000000 THEN 'down' ELSE 'up' END AS state FROM {MESSAGES} GROUP BY operator")
def t09_stale_sources(spark, sf):
    by = messages(spark, sf).groupBy("operator").agg(F.max("us").alias("last_us"))
    return by.crossJoin(by.agg(F.max("last_us").alias("now"))).select("operator", "last_us", F.when(F.col("now") - F.col("last_us") > 15_000_000, "down").otherwise("up").alias("state"))


@query(f"SELECT idx, CASE operator WHEN 'view' THEN 'fp:' || cert ELSE 'ix:' || operator || '#' || idx END AS key FROM {MESSAGES}")
def c35_dedup_key(spark, sf):
    m = messages(spark, sf).withColumn("fingerprint", F.when(F.col("operator") == "view", F.col("cert").cast("string")))
    return m.select("idx", F.coalesce(F.concat(F.lit("fp:"), "fingerprint"), F.concat(F.lit("ix:"), "operator", F.lit("#"), "idx")).alias("key"))


@query(f"""WITH s AS (SELECT cert, us, us // 60000000 % 1440 AS mins FROM {MESSAGES}), r AS (SELECT cert, us, mins, CASE WHEN lag(mins) OVER w - mins > 60 THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY cert ORDER BY us))
 SELECT cert, us, mins + 1440 * sum(f) OVER (PARTITION BY cert ORDER BY us ROWS UNBOUNDED PRECEDING) AS minutes FROM r""")
def w06_day_rollover(spark, sf):
    w = Window.partitionBy("cert").orderBy("us")
    s = messages(spark, sf).select("cert", "us", (F.floor(F.col("us") / MINUTE) % 1440).alias("mins"))
    s = s.withColumn("f", F.when(F.lag("mins").over(w) - F.col("mins") > 60, 1).otherwise(0))
    return s.select("cert", "us", (F.col("mins") + 1440 * F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("minutes"))
