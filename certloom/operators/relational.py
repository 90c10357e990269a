"""Tenant views, list filters, keyset pages, semi and anti joins, upserts, integrity (P08-P16, J05-J09, J16, J22-J26, K, U, W03-W15, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import MESSAGES, MICROS, count_if, messages, table


def keyset_page(rows: DataFrame, keys: list[str], cursor: tuple | None, n: int) -> DataFrame:
    """The next ``n`` rows in descending key order after ``cursor``, and one more that tells of a further page."""
    if cursor is not None:
        # the first condition alone reaches the Parquet scan
        rows = rows.filter((F.col(keys[0]) <= F.lit(cursor[0])) & (F.struct(*keys) < F.struct(*[F.lit(c).cast(rows.schema[k].dataType).alias(k) for k, c in zip(keys, cursor)])))
    return rows.orderBy(*[F.desc(k) for k in keys]).limit(n + 1)


def upsert_seen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First and last seen merged (M01): repeats never move the first."""
    return old.unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51")
def k01_keyset_page(spark, sf):
    return keyset_page(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], (300000.0, -1), 50)


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= CASE WHEN o_orderstatus = 'P' THEN 6 ELSE 3 END")
def k03_newest_by_class(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    o = table(spark, sf, "orders").withColumn("n", n).filter("n <= 6")
    return o.filter("n <= 3 or o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


@query()
def k05_stable_sample(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy(F.xxhash64("o_orderkey", F.lit(7)), "o_orderkey").limit(40)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def k06_due_batch(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus <> 'F' and o_orderdate <= timestamp_ntz'2000-01-01 00:00:00'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='P') AS p, count(*) AS total FROM orders")
def a02_status_counts(spark, sf):
    return table(spark, sf, "orders").agg(*[count_if(f"o_orderstatus = '{s.upper()}'").alias(s) for s in "fop"], F.count("*").alias("total"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS filled, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT max(o_totalprice) FROM orders) AS dearest,
 (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS debtors, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity > 45) AS suppliers, (SELECT max(event_id) FROM events) AS last_event,
 (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM pages WHERE html IS NOT NULL) AS pages""")
def a03_dashboard(spark, sf):
    """Ten counters in one row: one aggregate for each source table, of one row each."""
    one = lambda name, *aggs: table(spark, sf, name).agg(*aggs)
    orders = one("orders", F.count("*").alias("orders"), count_if("o_orderstatus = 'F'").alias("filled"), count_if("o_orderstatus = 'P'").alias("pending"), F.max("o_totalprice").alias("dearest"))
    events = one("events", F.max("event_id").alias("last_event"), count_if("event_type = 'error'").alias("errors"), F.count_distinct("user_id").alias("users"))
    suppliers = table(spark, sf, "lineitem").filter("l_quantity > 45").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    out = orders.crossJoin(one("customer", count_if("c_acctbal < 0").alias("debtors"))).crossJoin(suppliers)
    return out.crossJoin(events).crossJoin(one("pages", F.count("html").alias("pages")))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS domains FROM lineitem GROUP BY 1")
def a04_domains_per_node(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("domains"))


@query("SELECT n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey")
def a38_organisation_rollup(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", zero("c").alias("customers"), zero("s").alias("suppliers"))


@query("SELECT o_orderkey, coalesce(l_returnflag, 'candidate') AS status, coalesce(l_quantity, 1.0) AS weight FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 AND l_returnflag <> 'N' WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def p10_tenant_view(spark, sf):
    v = table(spark, sf, "lineitem").filter("l_linenumber = 1 and l_returnflag <> 'N'")
    o = table(spark, sf, "orders").filter("o_orderpriority in ('1-URGENT', '3-MEDIUM')")
    return o.join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("l_returnflag", F.lit("candidate")).alias("status"), F.coalesce("l_quantity", F.lit(1.0)).alias("weight"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p08_optional_filters(spark, sf):
    o = table(spark, sf, "orders")
    for condition in ("o_orderstatus = 'O'", None, "o_totalprice >= 200000", "o_orderpriority in ('1-URGENT', '2-HIGH')"):
        o = o.filter(condition) if condition else o
    return o.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def p09_sector_semi_join(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT p_partkey, p_size, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50) AS has_plan FROM part WHERE p_size >= 10")
def p11_campaign_list(spark, sf):
    planned = table(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, sf, "part").filter("p_size >= 10").join(planned, "p_partkey", "left").select("p_partkey", "p_size", F.col("has").isNotNull().alias("has_plan"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11' AND event_type = 'error'")
def p12_log_range(spark, sf):
    return table(spark, sf, "events").filter("ts > timestamp_ntz'2024-01-10 00:00:00' and ts <= timestamp_ntz'2024-01-11 00:00:00' and event_type = 'error'").select("event_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j07_anti_join(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def j08_retention(spark, sf):
    """Old rows without a judged reference go; the kept set is the union of the recent and the referenced."""
    o, used = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    recent = F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    return o.filter(recent).select("o_orderkey").union(o.filter(~recent).join(used, "o_orderkey", "left_semi").select("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def j09_latest_per_domain(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).o_orderkey.alias("o_orderkey"))


@query("SELECT l_orderkey, coalesce(max_by(l_returnflag, (l_linenumber, l_returnflag)) FILTER (l_returnflag <> 'N' AND l_linenumber > 1), max(l_returnflag) FILTER (l_linenumber = 1)) AS status FROM lineitem GROUP BY 1")
def j16_merged_verdict(spark, sf):
    other = F.when((F.col("l_returnflag") != "N") & (F.col("l_linenumber") > 1), F.struct("l_linenumber", "l_returnflag"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.max_by("l_returnflag", other), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")))).alias("status"))


@query("SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS targets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j22_plan_targets(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name")))
    return j.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x.p_name), "|").alias("targets"))


@query("SELECT coalesce(c.n_nationkey, s.s_nationkey) AS k, coalesce(s.n, 0) - coalesce(c.n, 0) AS delta FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) c RIGHT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c.n_nationkey")
def j24_snapshot_delta(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return b.join(a, "k", "left").select("k", (F.col("b") - F.coalesce("a", F.lit(0))).alias("delta"))


@query("SELECT s_suppkey, coalesce(o.c_custkey, -1) AS organisation FROM supplier LEFT JOIN (SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer WHERE c_acctbal > 0) WHERE n = 1) o ON o.c_nationkey = s_nationkey")
def j26_routing(spark, sf):
    """Oldest active organisation of the sector (W04), else the default (also T17, batch form)."""
    o = table(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min(F.struct("c_acctbal", "c_custkey")).c_custkey.alias("org"))
    return table(spark, sf, "supplier").join(o, "s_nationkey", "left").select("s_suppkey", F.coalesce("org", F.lit(-1)).alias("organisation"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, (c_acctbal > 0) DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def w03_boolean_priority(spark, sf):
    best = F.min_by("c_custkey", F.struct(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") <= 0, "c_custkey"))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("SELECT DISTINCT n, least(2 ** (n + 1), 60)::BIGINT AS delay_s, CASE WHEN n >= 6 THEN NULL ELSE [300, 900, 3600, 21600, 86400, 259200][n + 1] END AS recheck_s FROM (SELECT l_linenumber - 1 AS n FROM lineitem)")
def w12_backoff(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("n")).distinct()
    ladder = F.array(*[F.lit(x) for x in (300, 900, 3600, 21600, 86400, 259200)])
    return n.select("n", F.least(F.pow(F.lit(2), F.col("n") + 1), F.lit(60)).cast("long").alias("delay_s"), F.get(ladder, F.col("n")).alias("recheck_s"))


@query("SELECT p_partkey, printf('CAMP-%04d', 7 + row_number() OVER (ORDER BY p_size DESC, p_partkey)) AS label FROM part WHERE p_retailprice > 950")
def w15_labels(spark, sf):
    """Numbered within each size, behind the running count of all larger sizes: no task orders all campaigns."""
    p = table(spark, sf, "part").filter("p_retailprice > 950").select("p_partkey", "p_size")
    larger = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = p.groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", larger.alias("before"))  # one row a size
    nth = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    return p.withColumn("nth", nth).join(before, "p_size").select("p_partkey", F.format_string("CAMP-%04d", F.col("before") + F.col("nth") + 7).alias("label"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def u01_union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u03_except(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_custkey").distinct().join(o.filter("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti").select(F.col("o_custkey").alias("k"))


@query("SELECT o_orderkey, len(list_intersect(a, [1, 2, 3])) AS shared, list_has_any(a, [7]) AS any7, array_to_string(list_sort(list_distinct(list_concat(a, [99]))), ',') AS linked FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_suppkey % 10) AS a FROM lineitem GROUP BY 1)")
def u04_array_sets(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("a"))
    three = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    return a.select("o_orderkey", F.size(F.array_intersect("a", three)).cast("long").alias("shared"), F.array_contains("a", F.lit(7).cast("long")).alias("any7"), F.array_join(F.array_sort(F.array_union("a", F.array(F.lit(99).cast("long")))), ",").alias("linked"))


@query("SELECT user_id, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen FROM events GROUP BY 1")
def m01_upsert_seen(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr(MICROS.format("ts")).alias("first_seen")).withColumn("last_seen", F.col("first_seen"))
    half = lambda k: e.filter(f"event_id % 2 = {k}").drop("event_id")
    return upsert_seen(upsert_seen(half(0).limit(0), half(0), "user_id"), half(1), "user_id")


@query("SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, min(o_orderdate) FILTER (o_orderstatus = 'F') IS NOT NULL AS confirmed, epoch_us(min(o_orderdate) FILTER (o_orderstatus = 'F')) AS confirmed_us FROM orders GROUP BY 1")
def m02_verdict_upsert(spark, sf):
    first = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("first")
    v = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), first)
    return v.select("o_custkey", "status", F.col("first").isNotNull().alias("confirmed"), F.expr(MICROS.format("first")).alias("confirmed_us"))


@query("SELECT 'score_range' AS rule, count(*) AS n FROM lineitem WHERE l_discount < 0 OR l_discount > 1 UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P') UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def m05_violations(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rules = {
        "score_range": l.filter("l_discount < 0 or l_discount > 1"),
        "status": o.filter("o_orderstatus not in ('F', 'O', 'P')"),
        "orphan": l.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
        "unique": o.groupBy("o_orderkey").count().filter("count > 1"),
    }
    out = [rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, rows in rules.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def m07_demo_removal(spark, sf):
    """Rows derived from demo rows go with them (J29): the kept table is an anti join."""
    demo = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(demo, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


def recent(rows: DataFrame, time: str, as_of, micros: int) -> DataFrame:
    """Rows of the last ``micros`` before ``as_of`` (P13), a parameter, so that results can be had again."""
    return rows.filter((F.col(time) > as_of - micros) & (F.col(time) <= as_of))


@query(f"SELECT operator, count(*) FILTER (us > t - 3600000000) AS last_hour, count(*) FILTER (us > t - 86400000000) AS last_day, count(*) AS last_90_days FROM {MESSAGES}, (SELECT max(us) - 7200000000 AS t FROM {MESSAGES}) WHERE us <= t AND us > t - 7776000000000 GROUP BY operator")
def p13_recent(spark, sf):
    """Messages of the last hour, day and 90 days, as of two hours before the last one."""
    m = messages(spark, sf)
    as_of = m.agg(F.max("us") - 7_200_000_000).first()[0] or 0
    within = lambda micros: F.count_if(F.col("us") > as_of - micros)
    return recent(m, "us", F.lit(as_of), 7_776_000_000_000).groupBy("operator").agg(within(3_600_000_000).alias("last_hour"), within(86_400_000_000).alias("last_day"), F.count("*").alias("last_90_days"))
