"""Percentiles, rates at thresholds, AUC, gate and confusion tables (operators A13-A23, A26, A36-A37, A39, A42-A43, W07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.ranks import running
from ..functions.storage import materialise
from ..tables import MESSAGES, count_if, messages, table


#: Ranges of about equally many distinct values that a group is counted in before one of them is ordered; a power of two.
RANGES = 256
#: Distinct values of a group that one task orders.
SMALL = 100_000


def _bounds(value) -> Column:
    """Upper bounds of all ranges but the last, from a sketch of the values; none if no value is a number."""
    sketch = F.kll_sketch_agg_double(value.cast("double"))
    at = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, at))


def _ranged(rows: DataFrame, bounds: str, value: str, name: str) -> DataFrame:
    """``rows`` with the number of bounds below the value, halving the array at each step; 0 where there are no bounds."""
    out, step = rows.withColumn(name, F.lit(0)), RANGES // 2
    while step:
        bound = F.get(F.col(bounds), F.col(name) + step - 1)
        out, step = out.withColumn(name, F.col(name) + F.when(bound < F.col(value).cast("double"), step).otherwise(0)), step // 2
    return out


def percentiles(rows: DataFrame, keys: list[str], value: str, places: dict, small: int = SMALL) -> DataFrame:
    """(keys, n, largest, and a column for each of ``places``): the values at 1-based places, each a function of the column n.

    Equal values are counted before the shuffle, and groups of at most ``small`` distinct values are ordered as they are. Of larger ones a sketch gives RANGES
    ranges of about equally many distinct values, however they are spread; running counts over the ranges say which one holds a place, and only that range is
    ordered. The bounds are stored, as a sketch made again may differ."""
    own = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    large = own.groupBy(*keys).agg(F.count("*").alias("distinct")).filter(F.col("distinct") > small).select(*keys)
    bounds = materialise(own.join(large, keys, "left_semi").groupBy(*keys).agg(_bounds(F.col("v")).alias("bounds")), "bounds")
    if bounds.isEmpty():
        return _ordered(own, keys, places)
    out = _by_ranges(own.join(bounds, keys), keys, places)
    return _ordered(own.join(bounds, keys, "left_anti"), keys, places).unionByName(out)


def _ordered(own: DataFrame, keys: list[str], places: dict) -> DataFrame:
    """``percentiles`` of groups that one task can order each, from their distinct values ``v`` and counts ``c``."""
    group = Window.partitionBy(*keys)
    rows = own.withColumn("upto", F.sum("c").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(group))
    at = {k: f(F.col("n")).cast("long") for k, f in places.items()}
    found = [F.max(F.when((at[k] <= F.col("upto")) & (at[k] > F.col("upto") - F.col("c")), F.col("v"))).alias(k) for k in places]
    return rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys, "n").agg(F.max("v").alias("largest"), *found)


def _by_ranges(own: DataFrame, keys: list[str], places: dict) -> DataFrame:
    """``percentiles`` of groups with the bounds of their ranges."""
    extent = own.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("v").alias("largest"))
    celled = _ranged(own, "bounds", "v", "cell").drop("bounds")
    run = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows a group
    cells = celled.groupBy(*keys, "cell").agg(F.sum("c").alias("m")).withColumn("upto", F.sum("m").over(run))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("place")) for k, f in places.items()])).alias("p")
    wanted = cells.join(extent.select(*keys, "n"), keys).select(*keys, "cell", "m", "upto", asked)
    wanted = wanted.filter((F.col("p.place") <= F.col("upto")) & (F.col("p.place") > F.col("upto") - F.col("m")))
    wanted = wanted.select(*keys, "cell", "p.name", (F.col("p.place") - F.col("upto") + F.col("m")).alias("left"))
    inside = Window.partitionBy(*keys, "cell", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = celled.select(*keys, "cell", "v", "c").join(wanted, [*keys, "cell"]).withColumn("upto", F.sum("c").over(inside))
    found = found.filter((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("c")))
    chosen = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    return extent.select(*keys, "n", "largest").join(chosen, keys)


def half_up(q: float):
    return lambda n: F.floor(q * (n - 1) + 0.5) + 1


def half_even(q: float):
    return lambda n: F.bround(F.lit(q) * (n - 1)) + 1


def floor_index(q: float):
    return lambda n: F.floor(F.lit(q) * (n - 1)) + 1


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, index=half_up) -> DataFrame:
    """(keys, value, n): the percentile by index floor(q(n-1)+0.5), or the half-even or floor variants."""
    return percentiles(rows, keys, value, {"at": index(q)}).select(*keys, F.col("at").alias("value"), "n")


def _percentile_sql(q: float, index: str) -> str:
    return f"SELECT operator, value, n FROM (SELECT operator, value, row_number() OVER (PARTITION BY operator ORDER BY value) AS rn, count(*) OVER (PARTITION BY operator) AS n FROM {MESSAGES}) WHERE rn = {index.format(f'{q} * (n - 1)')} + 1"


@query(_percentile_sql(0.95, "floor({} + 0.5)"))
def a20_percentile_nearest(spark, sf):
    return nearest_rank(messages(spark, sf), ["operator"], "value", 0.95)


@query(_percentile_sql(0.5, "round_even({}, 0)"))
def a21_percentile_half_even(spark, sf):
    return nearest_rank(messages(spark, sf), ["operator"], "value", 0.5, half_even)


@query(_percentile_sql(0.99, "floor({})"))
def a22_percentile_floor(spark, sf):
    return nearest_rank(messages(spark, sf), ["operator"], "value", 0.99, floor_index)


@query(f"""WITH s AS (SELECT cert, min(us) FILTER (operator='view') AS a, min(us) FILTER (operator='click') AS b, min(us) FILTER (operator='purchase') AS c FROM {MESSAGES} GROUP BY cert),
 l AS (SELECT 'seen_to_candidate' AS stage, b - a AS x FROM s UNION ALL SELECT 'candidate_to_verdict', c - b FROM s), r AS (SELECT stage, x, row_number() OVER (PARTITION BY stage ORDER BY x) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM l WHERE x IS NOT NULL)
 SELECT stage, max(x) FILTER (rn = floor(0.5*(n-1)+0.5)+1) AS p50, max(x) FILTER (rn = floor(0.95*(n-1)+0.5)+1) AS p95, max(x) AS longest, n FROM r GROUP BY stage, n""")
def a23_latency_stages(spark, sf):
    first = lambda op: F.min(F.when(F.col("operator") == op, F.col("us")))
    s = messages(spark, sf).groupBy("cert").agg(first("view").alias("a"), first("click").alias("b"), first("purchase").alias("c"))
    long = s.select(F.inline(F.array(F.struct(F.lit("seen_to_candidate").alias("stage"), (F.col("b") - F.col("a")).alias("x")), F.struct(F.lit("candidate_to_verdict").alias("stage"), (F.col("c") - F.col("b")).alias("x"))))).filter("x is not null")
    found = percentiles(long, ["stage"], "x", {"p50": half_up(0.5), "p95": half_up(0.95)})
    return found.select("stage", "p50", "p95", F.col("largest").alias("longest"), "n")


SCORED = "(SELECT d.doc_id, d.n_chars / 20000.0 AS score, l.quality AS y, l.toxic AS hard, d.lang FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("n_chars") / 20000.0).alias("score"), F.col("quality").alias("y"), F.col("toxic").alias("hard"), "lang")


@query(f"SELECT round(avg((score >= 0.1)::INT) FILTER (y = 1), 9) AS tpr, round(avg((score >= 0.1)::INT) FILTER (y = 0), 9) AS fpr, round(avg((score >= 0.1)::INT) FILTER (hard = 1), 9) AS hard_rate FROM {SCORED}")
def a15_rates(spark, sf):
    hit = (F.col("score") >= 0.1).cast("double")
    return scored(spark, sf).agg(*[F.round(F.avg(F.when(c, hit)), 9).alias(n) for n, c in (("tpr", F.col("y") == 1), ("fpr", F.col("y") == 0), ("hard_rate", F.col("hard") == 1))])


@query(f"""WITH t AS (SELECT unnest(range(4, 17)) AS step), r AS (SELECT step, avg((score >= step / 20.0)::INT) FILTER (y = 1) AS tpr, avg((score >= step / 20.0)::INT) FILTER (y = 0) AS fpr FROM {SCORED}, t GROUP BY step)
 SELECT step, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(CASE WHEN tpr * 0.001 + fpr * 0.999 > 0 THEN tpr * 0.001 / (tpr * 0.001 + fpr * 0.999) END, 9) AS precision FROM r""")
def a16_threshold_sweep(spark, sf):
    s = scored(spark, sf).select("score", "y", F.explode(F.sequence(F.lit(4), F.lit(16))).alias("step"))
    hit = (F.col("score") >= F.col("step") / 20.0).cast("double")
    r = s.groupBy("step").agg(F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"))
    whole = F.col("tpr") * 0.001 + F.col("fpr") * 0.999
    return r.select("step", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"), F.round(F.when(whole > 0, F.col("tpr") * 0.001 / whole), 9).alias("precision"))


@query(f"""WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {SCORED})
 SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r""")
def a17_auc(spark, sf):
    """Rank sums from one row for each distinct score, ranked by ranges."""
    by = scored(spark, sf).groupBy("score").agg(count_if("y = 1").alias("p"), F.count("*").alias("n"))
    s = running(by, ["score"], "n").agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("m"))
    return s.select(F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("m")), 9).alias("auc"))


@query(f"SELECT lang, count(*) FILTER (score >= 0.1 AND y = 1) AS tp, count(*) FILTER (score >= 0.1 AND y = 0) AS fp, count(*) FILTER (score < 0.1 AND y = 1) AS fn, count(*) FILTER (score < 0.1 AND y = 0) AS tn FROM {SCORED} GROUP BY lang")
def a18_confusion(spark, sf):
    return scored(spark, sf).groupBy("lang").agg(*[count_if(f"score {s} 0.1 and y = {y}").alias(n) for n, s, y in (("tp", ">=", 1), ("fp", ">=", 0), ("fn", "<", 1), ("tn", "<", 0))])


@query(f"SELECT lang, round((sum(y) + 1) / (count(*) + 2), 9) AS rate FROM {SCORED} GROUP BY lang")
def a26_smoothed_rate(spark, sf):
    return scored(spark, sf).groupBy("lang").agg(F.round((F.sum("y") + 1) / (F.count("*") + 2), 9).alias("rate"))


@query(f"SELECT lang, count(*) AS tested, count(*) FILTER (score >= 0.2 AND hard = 1) AS false_positives, CASE WHEN count(*) FILTER (score >= 0.2 AND hard = 1) = 0 THEN 'strong' ELSE 'moderate' END AS ships_as FROM {SCORED} GROUP BY lang")
def a42_gate(spark, sf):
    g = scored(spark, sf).groupBy("lang").agg(F.count("*").alias("tested"), count_if("score >= 0.2 and hard = 1").alias("false_positives"))
    return g.withColumn("ships_as", F.when(F.col("false_positives") == 0, "strong").otherwise("moderate"))


@query("SELECT o_custkey, o_orderkey, round(100 * (m - o_totalprice) / m, 6) AS gap_pct, best FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 AS best FROM orders)")
def a36_plan_gap(spark, sf):
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf, "orders").withColumn("m", F.max("o_totalprice").over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")) == 1)
    return o.select("o_custkey", "o_orderkey", F.round(100 * (F.col("m") - F.col("o_totalprice")) / F.col("m"), 6).alias("gap_pct"), "best")


@query("SELECT o_orderpriority, o_orderstatus, round(median(o_totalprice), 4) AS median, count(*) AS runs FROM orders GROUP BY 1, 2")
def a37_median_runs(spark, sf):
    """The mean of the two middle values, which are one for odd counts."""
    keys = ["o_orderpriority", "o_orderstatus"]
    o = table(spark, sf, "orders").select(*keys, F.col("o_totalprice").cast("double").alias("v"))
    middle = percentiles(o, keys, "v", {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1})
    runs = o.groupBy(*keys).agg(F.count("*").alias("runs")).join(middle, keys, "left")
    return runs.select(*keys, F.round((F.col("low") + F.col("high")) / 2, 4).alias("median"), "runs")


@query(f"SELECT operator, run % 24 AS hour, count(*) AS n FROM {MESSAGES} GROUP BY 1, 2")
def a13_counts_by_category(spark, sf):
    return messages(spark, sf).groupBy("operator", (F.col("run") % 24).alias("hour")).agg(F.count("*").alias("n"))


@query(f"SELECT operator, count(*) FILTER (run % 2 = 0) AS even_runs, count(*) FILTER (run % 2 = 1) AS odd_runs FROM {MESSAGES} GROUP BY operator")
def a13_pivot(spark, sf):
    p = messages(spark, sf).withColumn("p", F.col("run") % 2).groupBy("operator").pivot("p", [0, 1]).count()
    return p.select("operator", F.coalesce(F.col("0"), F.lit(0)).alias("even_runs"), F.coalesce(F.col("1"), F.lit(0)).alias("odd_runs"))


@query(f"SELECT operator, CASE WHEN lag > 600000000 THEN 'bad' WHEN lag > 60000000 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT operator, (SELECT max(us) FROM {MESSAGES}) - max(us) AS lag FROM {MESSAGES} GROUP BY operator)")
def a43_health(spark, sf):
    by = messages(spark, sf).groupBy("operator").agg(F.max("us").alias("last"))
    lag = F.col("now") - F.col("last")
    return by.crossJoin(by.agg(F.max("last").alias("now"))).select("operator", F.when(lag > 600_000_000, "bad").when(lag > 60_000_000, "warn").otherwise("ok").alias("level"))
