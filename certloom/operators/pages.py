"""Page evidence: tag structure, kits, titles, scripts, signals and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..tables import table

BARE = r"(?is)<!--.*?-->|(<script)[^>]*>.*?(</script>)|(<style)[^>]*>.*?(</style>)"


def tags(html):
    """Tag names in order, ``/`` for closing; comments and the bodies of scripts and styles dropped."""
    bare = F.regexp_replace(html, BARE, "$1>$2$3>$4")
    return F.transform(F.regexp_extract_all(F.lower(bare), F.lit(r"<(/?[a-z][a-z0-9]*)"), F.lit(1)), lambda t: t)


TAGS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script)[^>]*>.*?(</script>)', '\1>\2', 'gis'), '(<style)[^>]*>.*?(</style>)', '\1>\2', 'gis')), '<(/?[a-z][a-z0-9]*)', 1)"


@query(f"SELECT page_id, sha256(array_to_string({TAGS}, ' ')) AS dom_hash FROM pages")
def c16_structure_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.array_join(tags("html"), " "), 256).alias("dom_hash"))


@query(f"WITH t AS (SELECT page_id, {TAGS} AS x FROM pages), o AS (SELECT page_id, x, list_filter(x, lambda e: NOT starts_with(e, '/')) AS opens FROM t) SELECT page_id, CASE WHEN len(opens) >= 20 AND len(list_distinct(opens)) >= 8 THEN sha256(array_to_string(x, ' ')) END AS kit FROM o")
def c17_kit_hash(spark, sf):
    t = table(spark, sf, "pages").select("page_id", tags("html").alias("x")).withColumn("opens", F.filter("x", lambda e: ~e.startswith("/")))
    enough = (F.size("opens") >= 20) & (F.size(F.array_distinct("opens")) >= 8)
    return t.select("page_id", F.when(enough, F.sha2(F.array_join("x", " "), 256)).alias("kit"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def c19_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT page_id, array_to_string(list_sort(list_transform(regexp_extract_all(html, '<script[^>]*>([^<]*(?:<[^/][^<]*|</p>[^<]*)*)</script>', 1), lambda s: sha256(s))), ',') AS scripts FROM pages")
def c21_script_hashes(spark, sf):
    s = F.regexp_extract_all("html", F.lit(r"<script[^>]*>([^<]*(?:<[^/][^<]*|</p>[^<]*)*)</script>"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.transform(s, lambda x: F.sha2(x, 256))), ",").alias("scripts"))


@query("SELECT page_id, regexp_matches(lower(html), 'type=.?password') AS credential, regexp_matches(lower(html), 'domain is for sale|parked|coming soon') AS parked, regexp_matches(html, 'eval\\(|atob\\(|unescape\\(') AS obfuscated FROM pages")
def c22_page_predicates(spark, sf):
    low = F.lower("html")
    return table(spark, sf, "pages").select("page_id", low.rlike("type=.?password").alias("credential"), low.rlike("domain is for sale|parked|coming soon").alias("parked"), F.col("html").rlike(r"eval\(|atob\(|unescape\(").alias("obfuscated"))


SIGNALS = "(SELECT l_orderkey AS domain, CASE l_linenumber % 3 WHEN 0 THEN 'kit' WHEN 1 THEN 'icon' ELSE 'form' END AS name, CASE WHEN l_quantity > 35 THEN 'strong' WHEN l_quantity > 20 THEN 'moderate' ELSE 'weak' END AS strength, l_suppkey % 4 AS artifact FROM lineitem)"


def signals(spark, sf, artifact=None):
    q, n = F.col("l_quantity"), F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("domain"), F.when(n == 0, "kit").when(n == 1, "icon").otherwise("form").alias("name"), F.when(q > 35, "strong").when(q > 20, "moderate").otherwise("weak").alias("strength"), (F.col("l_suppkey") % 4 if artifact is None else artifact).alias("artifact")
    )


@query(f"SELECT name, strength, count(DISTINCT domain) AS domains FROM {SIGNALS} GROUP BY 1, 2")
def a14_signal_census(spark, sf):
    return signals(spark, sf).groupBy("name", "strength").agg(F.count_distinct("domain").alias("domains"))


@query(f"SELECT DISTINCT a.domain FROM {SIGNALS} a JOIN {SIGNALS} b ON a.domain = b.domain AND a.name < b.name AND a.artifact <> b.artifact WHERE a.strength = 'strong' AND b.strength = 'strong'")
def j25_independent_strong(spark, sf):
    """Two strong signals of different names without a common artifact, by arrays of each domain's few signals."""
    s = signals(spark, sf).filter("strength = 'strong'").groupBy("domain").agg(F.collect_set(F.struct("name", "artifact")).alias("s"))
    return s.filter(F.exists("s", lambda a: F.exists("s", lambda b: (a["name"] < b["name"]) & (a["artifact"] != b["artifact"])))).select("domain")
