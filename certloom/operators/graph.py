"""Domain-infrastructure graph: components, merges, campaigns and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.storage import forget, materialise
from ..tables import EDGES, edges, table

STRONG, MEDIUM = 0.6, 0.3


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of (a, b) links, by least labels with pointer jumping. Rounds are written to
    the shared folder, and the one before is deleted. Joins are merges throughout: what one round broadcasts is small, but the driver would hold and send
    it in every round."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    stored = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        labels = stored.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialise(step.join(jump.hint("merge"), "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        done = moved.filter("old <> label").isEmpty()
        forget(stored)
        stored = moved
        if done:
            forget(both)
            return stored.select("node", "label")


def strong_components(e: DataFrame) -> DataFrame:
    """(domain, component): domains joined by nodes of strong edges; every domain has one (G03). Nodes are linked as
    negative numbers, so the least label is decided among domains by the group's minimum afterwards."""
    strong = e.filter(F.col("weight") >= STRONG)
    links = strong.select(F.col("domain").alias("a"), (-F.col("node") - 1).alias("b"))
    own = components(links).filter("node >= 0").withColumnRenamed("node", "domain")
    names = own.groupBy("label").agg(F.min("domain").alias("component"))
    found = own.join(names.hint("merge"), "label").select("domain", "component")
    return e.select("domain").distinct().join(found.hint("merge"), "domain", "left").select("domain", F.coalesce("component", "domain").alias("component"))


def sharing(medium: DataFrame, limit: int | None = None) -> DataFrame:
    """Links (a, b) that join the same components as all pairs which share two nodes or more, from distinct (node, component).

    A node that a large share of the components holds would make pairs in its square, so no pairs are formed within a node. Components of
    one node set are joined to the least of them first. Of the rest, one with at most ``limit`` nodes gives its pairs of nodes, and
    the holders of a pair are joined to the least of them. One with more nodes is counted against the others; there are at most rows / limit
    of these. With the root of the rows, the default, neither part exceeds rows^1.5."""
    often = medium.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    held = materialise(medium.join(often.hint("merge"), "node", "left_semi"), "held")
    name = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set_{k}") for k in (1, 2)]
    sets = materialise(held.groupBy("component").agg(F.count("*").alias("n"), *name).filter("n > 1"), "sets")
    firsts = sets.groupBy("n", "set_1", "set_2").agg(F.min("component").alias("a"))
    alike = sets.join(firsts.hint("merge"), ["n", "set_1", "set_2"]).filter("a < component").select("a", F.col("component").alias("b"))
    own = materialise(held.join(firsts.select(F.col("a").alias("component"), "n").hint("merge"), "component").select("node", "component", "n"), "held")
    limit = limit or max(16, int(own.count() ** 0.5))
    small, large = own.filter(F.col("n") <= limit), own.filter(F.col("n") > limit).select("node", "component")
    pairs = small.join(small.select("component", F.col("node").alias("other")).hint("merge"), "component").filter("node < other").select("node", "other", "component")
    least = pairs.groupBy("node", "other").agg(F.min("component").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    near = pairs.join(least.hint("merge"), ["node", "other"]).filter("a < component").select("a", F.col("component").alias("b"))
    met = large.join(own.select("node", F.col("component").alias("other")).hint("merge"), "node").filter("component <> other").groupBy("component", "other").agg(F.count("*").alias("n")).filter("n > 1")
    return alike.union(near).union(met.select(F.least("component", "other").alias("a"), F.greatest("component", "other").alias("b"))).distinct()


def merged_components(e: DataFrame) -> DataFrame:
    """Components that share two or more nodes of medium edges become one."""
    own = materialise(strong_components(e), "components")
    medium = e.filter((F.col("weight") >= MEDIUM) & (F.col("weight") < STRONG)).join(own.hint("merge"), "domain").select("node", "component").distinct()
    merged = components(sharing(medium)).select(F.col("node").alias("component"), F.col("label").alias("campaign"))
    return own.join(merged.hint("merge"), "component", "left").select("domain", F.coalesce("campaign", "component").alias("campaign"))


def campaigns(e: DataFrame) -> DataFrame:
    """(campaign, domain) without singletons."""
    own = materialise(merged_components(e), "campaigns")
    return own.join(own.groupBy("campaign").count().filter("count >= 2").select("campaign").hint("merge"), "campaign", "left_semi").select("campaign", "domain")


STRONG_SQL = f"""WITH RECURSIVE e AS {EDGES}, s AS (SELECT a.domain AS x, b.domain AS y FROM e a JOIN e b USING (node) WHERE a.weight >= 0.6 AND b.weight >= 0.6),
 r(x, y) AS (SELECT domain, domain FROM e UNION SELECT r.x, s.y FROM r JOIN s ON s.x = r.y), c AS (SELECT x AS domain, min(y) AS component FROM r GROUP BY x)"""
MERGED_SQL = f"""{STRONG_SQL}, m AS (SELECT DISTINCT e.node, c.component FROM e JOIN c USING (domain) WHERE weight >= 0.3 AND weight < 0.6),
 l AS (SELECT a.component AS p, b.component AS q FROM m a JOIN m b USING (node) WHERE a.component <> b.component GROUP BY 1, 2 HAVING count(*) >= 2),
 t(p, q) AS (SELECT component, component FROM (SELECT DISTINCT component FROM c) UNION SELECT t.p, l.q FROM t JOIN l ON l.p = t.q), k AS (SELECT p, min(q) AS campaign FROM t GROUP BY p), d AS (SELECT c.domain, k.campaign FROM c JOIN k ON k.p = c.component)"""


@query(f"{STRONG_SQL} SELECT domain, component FROM c")
def g03_components(spark, sf):
    return strong_components(edges(spark, sf))


@query(f"{MERGED_SQL} SELECT domain, campaign FROM d")
def g04_merged_components(spark, sf):
    return merged_components(edges(spark, sf))


@query(f"{MERGED_SQL} SELECT campaign, domain FROM d WHERE campaign IN (SELECT campaign FROM d GROUP BY 1 HAVING count(*) >= 2)")
def g05_campaigns(spark, sf):
    return campaigns(edges(spark, sf))


@query(f"""{MERGED_SQL}, k2 AS (SELECT campaign, domain FROM d WHERE campaign IN (SELECT campaign FROM d GROUP BY 1 HAVING count(*) >= 2)),
 sizes AS (SELECT campaign, count(DISTINCT domain) AS domains, count(DISTINCT node) AS nodes, round(avg(weight) FILTER (weight >= 0.6), 4) AS confidence FROM k2 JOIN e USING (domain) GROUP BY campaign),
 seen AS (SELECT campaign, o_orderpriority AS kit, o_orderstatus AS brand FROM k2 JOIN orders ON domain = o_orderkey), kits AS (SELECT campaign, kit, count(*) AS n FROM seen GROUP BY 1, 2),
 modal AS (SELECT campaign, min((-n, kit))[2] AS kit FROM kits GROUP BY 1), brandlist AS (SELECT campaign, string_agg(brand, ',' ORDER BY brand) AS brands FROM (SELECT DISTINCT campaign, brand FROM seen) GROUP BY 1)
 SELECT campaign, domains, nodes, confidence, kit, brands FROM sizes LEFT JOIN modal USING (campaign) LEFT JOIN brandlist USING (campaign)""")
def a12_campaign_summary(spark, sf):
    """Size, nodes, mean strong weight, most frequent kit (ties to the smaller name) and sorted brands of each campaign; order priorities
    stand for kits, order states for brands. Kits and brands are counted by value first, so one campaign is never one task's list of domains."""
    e = edges(spark, sf)
    members = materialise(campaigns(e), "members")
    joined = members.join(e.hint("merge"), "domain")
    size = joined.groupBy("campaign").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("node").alias("nodes"), F.round(F.avg(F.when(F.col("weight") >= STRONG, F.col("weight"))), 4).alias("confidence"))
    seen = members.join(table(e.sparkSession, sf, "orders").select(F.col("o_orderkey").alias("domain"), F.col("o_orderpriority").alias("kit"), F.col("o_orderstatus").alias("brand")).hint("merge"), "domain")
    seen = seen.groupBy("campaign", "kit", "brand").agg(F.count("*").alias("n"))
    kits = seen.groupBy("campaign", "kit").agg(F.sum("n").alias("n")).groupBy("campaign").agg(F.min(F.struct((-F.col("n")).alias("less"), "kit")).kit.alias("kit"))
    brands = seen.groupBy("campaign").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))
    return size.join(kits.hint("merge"), "campaign", "left").join(brands.hint("merge"), "campaign", "left")


@query(f"SELECT domain, string_agg(node::VARCHAR || ':' || weight::VARCHAR, ',' ORDER BY node) AS document FROM {EDGES} GROUP BY 1")
def a11_document(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("node", "weight")))
    return edges(spark, sf).groupBy("domain").agg(F.array_join(F.transform(listed, lambda x: F.concat(x.node.cast("string"), F.lit(":"), x.weight.cast("string"))), ",").alias("document"))
