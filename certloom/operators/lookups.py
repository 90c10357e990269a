"""Projections, lookups, queues and plan checks over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.storage import forget, materialise, shared_dir
from ..tables import DEPENDENCIES, EDGES, HOSTS, MESSAGES, count_if, dependencies, edges, hosts, messages, table
from .evidence import merkle_roots
from .graph import MERGED_SQL, campaigns, merged_components, strong_components
from .metrics import SCORED, scored
from .names import c31_mask
from .plans import GREEDY2, coverage, greedy


@query(f"SELECT count(*) AS listed, count(*) FILTER (url IS NULL) AS no_url, count(*) FILTER (host = '') AS no_host, count(*) FILTER (host <> '') AS kept FROM {HOSTS}")
def p14_skip_rules(spark, sf):
    return hosts(spark, sf).agg(F.count("*").alias("listed"), count_if("url is null").alias("no_url"), count_if("host = ''").alias("no_host"), count_if("host <> ''").alias("kept"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def p15_source_exclusion(spark, sf):
    """A time window, a source left out and a list of ids as a semi join."""
    ids = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW' and o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query(f"SELECT page_id, CASE WHEN length(split_part(host, '.', 1)) > 7 THEN left(host, 5) ELSE left(split_part(host, '.', 1), (length(split_part(host, '.', 1)) // 2)::INT) END || '***' AS masked FROM {HOSTS} ORDER BY page_id DESC LIMIT 50")
def p16_public_feed(spark, sf):
    """The newest 50 names, masked."""
    return c31_mask(spark, sf).orderBy(F.desc("page_id")).limit(50)


@query(f"SELECT idx, cert, us, round(least(value / 50, 1.0), 6) AS score, value >= 17.5 AS candidate FROM {MESSAGES}")
def p17_live_projection(spark, sf):
    return messages(spark, sf).select("idx", "cert", "us", F.round(F.least(F.col("value") / 50, F.lit(1.0)), 6).alias("score"), (F.col("value") >= 17.5).alias("candidate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 4)) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring')")
def p18_shared_infrastructure(spark, sf):
    """Nodes of shared networks and names under shared suffixes never become edges."""
    near = table(spark, sf, "nation").filter("n_regionkey in (0, 4)").select(F.col("n_nationkey").alias("s_nationkey"))
    shared = table(spark, sf, "supplier").join(near, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    names = table(spark, sf, "part").filter("p_name like '%ring'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(shared, "l_suppkey", "left_anti").join(names, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'")
def j10_campaign_rows(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return c.join(o, "c_custkey", "left").join(l, "o_orderkey", "left").select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT domain, node, weight FROM {EDGES} WHERE domain IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j11_confirmed_edges(spark, sf):
    confirmed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("domain"))
    return edges(spark, sf).join(confirmed, "domain", "left_semi").select("domain", "node", "weight")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (s_acctbal > 0) DESC, (s_acctbal > 5000) DESC, s_suppkey) AS n FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_nationkey) WHERE n = 1")
def j17_exact_or_group_lookup(spark, sf):
    """By exact key or by group: each group's best is found first, so both are equi joins with one row a key."""
    rank = F.struct((F.col("s_acctbal") <= 0).alias("a"), (F.col("s_acctbal") <= 5000).alias("b"), "s_suppkey")
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", rank.alias("rank"))
    group = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("rank").alias("by_group"))
    exact = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("rank").alias("by_key"))
    j = table(spark, sf, "customer").join(group, "c_nationkey", "left").join(exact, "c_custkey", "left")
    best = F.when(F.col("by_group").isNull() | (F.col("by_key") < F.col("by_group")), F.col("by_key")).otherwise(F.col("by_group"))
    return j.withColumn("best", best).filter("best is not null").select("c_custkey", "best.s_suppkey")


@query("SELECT feed, k, count(*) AS n FROM (SELECT 'customer' AS feed, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1, 2")
def u02_feeds(spark, sf):
    feed = lambda t, c: table(spark, sf, t).select(F.lit(t).alias("feed"), F.col(c).alias("k"))
    return feed("customer", "c_nationkey").unionByName(feed("supplier", "s_nationkey")).groupBy("feed", "k").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS known FROM lineitem GROUP BY 1")
def u06_hash_history(spark, sf):
    """Once observed, a hash stays valid: the old and the new set merged."""
    seen = lambda status: table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status if status else F.col("l_linestatus").isNull() | ~F.col("l_linestatus").isin("F")).groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("h"))
    return seen("F").union(seen(None)).groupBy("l_partkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))), ",").alias("known"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey DESC LIMIT 50")
def k07_backlog(spark, sf):
    """Due re-checks first, then newest first."""
    return table(spark, sf, "orders").filter("o_orderstatus <> 'F'").orderBy(F.desc(F.col("o_orderstatus") == "P"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def m03_replacing_upsert(spark, sf):
    """All columns of a key are replaced by its newest new row; keys without one keep their old row."""
    o = table(spark, sf, "orders").withColumn("new", F.col("o_orderstatus") != "F")
    best = F.max(F.struct("new", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice")).alias("r")
    return o.groupBy("o_custkey").agg(best).select("o_custkey", "r.o_orderpriority", "r.o_totalprice")


@query("SELECT o_orderkey, count(l_orderkey) AS attempts, coalesce(bool_or(l_returnflag = 'R'), false) AS done, CASE WHEN NOT coalesce(bool_or(l_returnflag = 'R'), false) THEN least(2 ** (count(l_orderkey) + 1), 60)::BIGINT END AS delay_s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def t12_retry_queue(spark, sf):
    """The queue after a batch: attempts made, done ones closed, the others due after a capped exponential delay."""
    tried = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("d"))
    q = table(spark, sf, "orders").join(tried, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("attempts"), F.coalesce("d", F.lit(False)).alias("done"))
    return q.withColumn("delay_s", F.when(~F.col("done"), F.least(F.pow(F.lit(2), F.col("attempts") + 1), F.lit(60)).cast("long")))


@query(f"""WITH r AS (SELECT operator, us // 300000000 AS slot, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY operator, us // 300000000) AS n FROM {MESSAGES} WINDOW w AS (PARTITION BY operator, us // 300000000 ORDER BY value))
 SELECT operator, slot, max(value) FILTER (rn = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(value) FILTER (rn = round_even(0.95 * (n - 1), 0) + 1) AS p95, n FROM r GROUP BY operator, slot, n""")
def a39_endpoint_latency(spark, sf):
    """Half-even percentiles of each operator in windows of five minutes, which bound the ordered groups."""
    from .metrics import half_even, percentiles

    m = messages(spark, sf).select("operator", F.floor(F.col("us") / 300_000_000).alias("slot"), "value")
    return percentiles(m, ["operator", "slot"], "value", {"p50": half_even(0.5), "p95": half_even(0.95)}).select("operator", "slot", "p50", "p95", "n")


@query(f"SELECT domain, node, weight FROM (SELECT domain, e.node, weight, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, n DESC, e.node) AS r FROM {EDGES} e JOIN (SELECT node, count(*) AS n FROM {EDGES} GROUP BY 1) c ON c.node = e.node) WHERE r = 1")
def c51_primary_infrastructure(spark, sf):
    """The anchor of each domain: strongest kind, then the most shared node, then the least."""
    e = edges(spark, sf)
    best = F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("n")).alias("c"), "node")).alias("b")
    j = e.join(e.groupBy("node").agg(F.count("*").alias("n")), "node").groupBy("domain").agg(best)
    return j.select("domain", "b.node", (-F.col("b.w")).alias("weight"))


@query(f"{MERGED_SQL} SELECT d.domain, d.campaign, d.campaign <> c.component AS moved FROM d JOIN c USING (domain)")
def g07_membership_stamps(spark, sf):
    """A stamp moves only where the campaign changes from the prior one."""
    e = edges(spark, sf)
    prior = strong_components(e).withColumnRenamed("component", "prior")
    return merged_components(e).join(prior.hint("merge"), "domain", "left").select("domain", "campaign", (~F.col("campaign").eqNullSafe(F.col("prior"))).alias("moved"))


def reuse_identity(clusters: DataFrame, prior: DataFrame) -> DataFrame:
    """(cluster, identity): each cluster takes the most common prior campaign of its domains that no larger cluster took;
    ties go to the lesser id, clusters without one keep null (G06). Rounds: every open cluster proposes its best free id,
    the largest proposer wins it; each round settles at least one id, in practice all but a few at once. What a round settles is one folder
    of a table, so the plan does not grow with the rounds."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    votes = clusters.join(prior.hint("merge"), "domain").groupBy("cluster", "campaign").agg(F.count("*").alias("votes"))
    session = clusters.sparkSession
    folder = f"{shared_dir(session)}/tables/identity-{uuid.uuid4().hex}"
    open_, n = materialise(votes.join(size.hint("merge"), "cluster"), "votes"), 0
    while not open_.isEmpty():
        best = open_.groupBy("cluster", "size").agg(F.min(F.struct((-F.col("votes")).alias("v"), "campaign")).campaign.alias("campaign"))
        best.groupBy("campaign").agg(F.min(F.struct((-F.col("size")).alias("s"), "cluster")).cluster.alias("cluster")).write.parquet(f"{folder}/round={n}")
        won = session.read.parquet(f"{folder}/round={n}")
        rest = materialise(open_.join(won.select("cluster").hint("merge"), "cluster", "left_anti").join(won.select("campaign").hint("merge"), "campaign", "left_anti"), "votes")
        forget(open_)
        open_, n = rest, n + 1
    kept = size.select("cluster")
    if not n:
        return kept.withColumn("identity", F.lit(None).cast("long"))
    settled = session.read.parquet(folder).select("cluster", F.col("campaign").alias("identity"))
    return kept.join(settled.hint("merge"), "cluster", "left").select("cluster", "identity")


@query()
def g06_stable_identity(spark, sf):
    """Merged campaigns take over the ids of the strong components they grew from."""
    e = edges(spark, sf)
    clusters = materialise(campaigns(e), "clusters").select("domain", F.col("campaign").alias("cluster"))
    return reuse_identity(clusters, strong_components(e).withColumnRenamed("component", "campaign"))


@query()
def a31_indicator_roots(spark, sf):
    """Merkle root over the distinct, sorted ``kind:value`` strings of each campaign."""
    e = edges(spark, sf)
    own = materialise(campaigns(e), "own")
    domains = own.select("campaign", F.concat(F.lit("domain:"), F.col("domain").cast("string")).alias("value"))
    nodes = own.join(e, "domain").select("campaign", F.concat(F.lit("node:"), F.col("node").cast("string")).alias("value"))
    values = domains.union(nodes).distinct().withColumn("sha", F.sha2("value", 256))
    return merkle_roots(values, "campaign", "value", "sha")


DOMINATED = "s AS (SELECT campaign, node, count(*) AS w FROM d GROUP BY 1, 2), c AS (SELECT x.campaign, x.node AS v, y.node AS u, count(*) AS n FROM d x JOIN d y USING (campaign, domain) WHERE x.node <> y.node GROUP BY 1, 2, 3), z AS (SELECT DISTINCT c.campaign, c.v AS node FROM c JOIN s a ON a.campaign = c.campaign AND a.node = c.v JOIN s b ON b.campaign = c.campaign AND b.node = c.u WHERE c.n = a.w AND (b.w > a.w OR (b.w = a.w AND c.u < c.v)))"


@query(f"WITH d AS {DEPENDENCIES}, {DOMINATED} SELECT s.campaign, s.node, s.w FROM s ANTI JOIN z ON z.campaign = s.campaign AND z.node = s.node")
def i02_exact_reduction(spark, sf):
    """Nodes left after dominated ones are dropped, with what they cover."""
    from .plans import j28_dominated_nodes

    w = dependencies(spark, sf).groupBy("campaign", "node").agg(F.count("*").alias("w"))
    return w.join(j28_dominated_nodes(spark, sf), ["campaign", "node"], "left_anti").select("campaign", "node", "w")


@query(f"WITH d AS {DEPENDENCIES}, t AS (SELECT campaign, node FROM (SELECT campaign, node, row_number() OVER (PARTITION BY campaign ORDER BY count(*) DESC, node) AS r FROM d GROUP BY 1, 2) WHERE r <= 12) SELECT d.campaign, count(DISTINCT domain) - count(DISTINCT domain) FILTER (t.node IS NOT NULL) AS lost FROM d LEFT JOIN t ON t.campaign = d.campaign AND t.node = d.node GROUP BY 1")
def i03_lost_weight(spark, sf):
    """What the heaviest twelve nodes of a campaign cannot reach."""
    from .plans import k04_top_nodes

    return coverage(dependencies(spark, sf), k04_top_nodes(spark, sf)).select("campaign", (F.col("total") - F.col("killed")).alias("lost"))


def plan_violations(dep: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(rule, n): campaigns over budget, targets given twice, targets unknown to their campaign."""
    over = plan.groupBy("campaign").count().filter(F.col("count") > k)
    twice = plan.groupBy("campaign", "node").count().filter("count > 1")
    unknown = plan.join(dep.select("campaign", "node"), ["campaign", "node"], "left_anti")
    one = lambda rule, rows: rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return one("budget", over).union(one("duplicate", twice)).union(one("unknown", unknown))


@query(f"WITH d AS {DEPENDENCIES}, p AS (SELECT l_linenumber AS campaign, l_suppkey AS node FROM lineitem WHERE l_quantity >= 49) SELECT 'budget' AS rule, count(*) AS n FROM (SELECT campaign FROM p GROUP BY 1 HAVING count(*) > 3) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT campaign, node FROM p GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unknown', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.campaign = p.campaign AND d.node = p.node)")
def i08_validation(spark, sf):
    """Plans as given by large line items, most of them faulty on purpose."""
    plan = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_linenumber").alias("campaign"), F.col("l_suppkey").alias("node"))
    return plan_violations(dependencies(spark, sf), plan, 3)


@query(f"""{GREEDY2}, t AS (SELECT 'greedy' AS plan, campaign, node FROM p1 UNION ALL SELECT 'greedy', campaign, node FROM p2 UNION ALL SELECT 'heaviest', campaign, node FROM (SELECT campaign, node, row_number() OVER (PARTITION BY campaign ORDER BY count(*) DESC, node) AS r FROM d GROUP BY 1, 2) WHERE r <= 2),
 s AS (SELECT plan, t.campaign, count(DISTINCT domain) AS killed FROM t JOIN d ON d.campaign = t.campaign AND d.node = t.node GROUP BY 1, 2) SELECT plan, campaign, killed, killed = max(killed) OVER (PARTITION BY campaign) AS best FROM s""")
def i10_scored_plans(spark, sf):
    """Given plans scored on one problem, the best of each campaign flagged."""
    from .plans import k04_top_nodes

    dep = materialise(dependencies(spark, sf), "dependencies")
    first = F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc("n"), "node"))
    plans = {"greedy": greedy(dep, 2), "heaviest": k04_top_nodes(spark, sf).withColumn("r", first).filter("r <= 2")}
    both = [coverage(dep, t).select(F.lit(name).alias("plan"), "campaign", "killed") for name, t in plans.items()]
    s = both[0].union(both[1])
    return s.join(s.groupBy("campaign").agg(F.max("killed").alias("most")), "campaign").select("plan", "campaign", "killed", (F.col("killed") == F.col("most")).alias("best"))


@query(f"SELECT lang, count(*) >= 5 AS enough, coalesce(avg((score >= 0.1)::INT) FILTER (y = 1) >= 0.5, false) AS recall, coalesce(avg((score >= 0.1)::INT) FILTER (y = 0) <= 0.2, false) AS false_alarms, coalesce(avg((score >= 0.1)::INT) FILTER (hard = 1) <= 0.2, false) AS hard_ones FROM {SCORED} GROUP BY lang")
def l09_release_gate(spark, sf):
    hit = (F.col("score") >= 0.1).cast("double")
    rate = lambda c: F.avg(F.when(F.expr(c), hit))
    no = F.lit(False)
    return scored(spark, sf).groupBy("lang").agg((F.count("*") >= 5).alias("enough"), F.coalesce(rate("y = 1") >= 0.5, no).alias("recall"), F.coalesce(rate("y = 0") <= 0.2, no).alias("false_alarms"), F.coalesce(rate("hard = 1") <= 0.2, no).alias("hard_ones"))


@query()
def s06_recorder(spark, sf):
    """Rows worth keeping and a stable sample of one in a hundred of the rest, by hash: the recorder's own sampling."""
    tag = F.when(F.col("value") >= 20, "scored").when(F.pmod(F.xxhash64("cert", "idx"), F.lit(100)) == 0, "background_sample")
    return messages(spark, sf).withColumn("tag", tag).filter("tag is not null").select("idx", "cert", "value", "tag")
