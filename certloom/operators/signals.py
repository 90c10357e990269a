"""Signals of names, pages, mail and logs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..catalog import query
from ..tables import HOSTS, MESSAGES, hosts, messages, table
from .mail import ADDRESS
from .names import ETLD_SQL, SEG, TOKENS, etld1, suffix_table
from .pages import SIGNALS, TAGS, signals, tags

#: Letters of other scripts and their Latin look-alikes, members of visual classes, letter groups.
SCRIPT = ("аеорсухѕіјӏԁɡոνοαкмтвнıɩƅԛԝүһѡɑερτυχ", "aeopcyxsijldgnvoakmtbhiibqwyhwaeptux")
CLASSES = ("l1|!03457$@", "iiiioeastsa")
GROUPS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
#: Address ranges that are not public (first address, prefix length).
RESERVED = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def skeleton(s, normalise: bool = True):
    """Confusable skeleton (C01). Only rows with other than ASCII characters carry a value through the Arrow function."""
    if normalise:
        other = s.rlike(r"[^\x00-\x7F]")
        s = F.coalesce(nfkc(F.when(other, s)), s)
    out = F.translate(F.lower(s), SCRIPT[0] + CLASSES[0], SCRIPT[1] + CLASSES[1])
    for a, b in GROUPS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _skeleton_sql(s: str) -> str:
    out = f"translate(lower({s}), '{SCRIPT[0] + CLASSES[0]}', '{SCRIPT[1] + CLASSES[1]}')"
    for a, b in GROUPS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(f"SELECT page_id, {_skeleton_sql('host')} AS skeleton FROM {HOSTS}")
def c01_skeleton(spark, sf):
    return hosts(spark, sf).select("page_id", skeleton(F.col("host")).alias("skeleton"))


@query(f"WITH s AS (SELECT DISTINCT segment, {_skeleton_sql('segment')} AS skeleton FROM (SELECT unnest({SEG}) AS segment FROM {HOSTS})) SELECT skeleton, count(*) AS segments, min(segment) AS first FROM s GROUP BY 1")
def j04_skeleton_classes(spark, sf):
    """Segments that look alike fall on one skeleton: the equi join of names and tokens on it, as classes."""
    s = hosts(spark, sf).select(F.explode(F.split("host", "[._-]+")).alias("segment")).filter("segment <> ''").distinct()
    return s.groupBy(skeleton(F.col("segment"), False).alias("skeleton")).agg(F.count("*").alias("segments"), F.min("segment").alias("first"))


@query(f"WITH e AS (SELECT page_id, suffix FROM {ETLD_SQL}), a AS (SELECT suffix FROM e GROUP BY 1 HAVING count(*) >= 80) SELECT page_id, suffix IN (SELECT suffix FROM a) AS allowed FROM e")
def j01_allowlist(spark, sf):
    """Names under a popular suffix are allowed before any scoring."""
    e = etld1(hosts(spark, sf), suffix_table(spark)).select("page_id", "suffix")
    popular = e.groupBy("suffix").agg(F.count("*").alias("n")).filter("n >= 80").select("suffix", F.lit(True).alias("allowed"))
    return e.join(popular, "suffix", "left").select("page_id", F.col("allowed").isNotNull().alias("allowed"))


def first_rule(column, rules: tuple[tuple[str, str], ...], other: str):
    """The label of the first pattern that matches."""
    out = F
    for pattern, label in rules:
        out = out.when(column.rlike(pattern), label)
    return out.otherwise(other)


def _first_rule_sql(column: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{label}'" for p, label in rules) + f" ELSE '{other}' END"


ZONES = (("[.]example[.]com$", "Commercial"), ("^th.*[.]example[.]", "Northern"), ("[.]example[.]net$", "Network"), ("[.]org$", "Organisation"))
CAUSES = (('"k": 4[0-9][}]', "http_4xx"), ('"k": 5[0-9][}]', "http_5xx"), ('"k": [0-9][}]', "dns"), ('"k": 1', "timeout"), ('"k": [67]', "reset"))


@query(f"SELECT {_first_rule_sql('host', ZONES, 'Other')} AS zone, count(*) AS n FROM {HOSTS} GROUP BY 1")
def c33_operator_rules(spark, sf):
    return hosts(spark, sf).groupBy(first_rule(F.col("host"), ZONES, "Other").alias("zone")).agg(F.count("*").alias("n"))


@query(f"SELECT event_type, {_first_rule_sql('props', CAUSES, 'other')} AS cause, count(*) AS n, count(DISTINCT user_id) AS sites FROM events GROUP BY 1, 2")
def c34_failure_causes(spark, sf):
    """Causes by ordered rules, with rows and distinct sites for each operator."""
    return table(spark, sf, "events").groupBy("event_type", first_rule(F.col("props"), CAUSES, "other").alias("cause")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sites"))


@query("""WITH s AS (SELECT user_id AS site, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), t AS (SELECT * FROM s ORDER BY n DESC, site LIMIT 5)
 SELECT (SELECT sum(n)::BIGINT FROM s) AS n, (SELECT count(*) FROM s) AS sites, (SELECT string_agg(site || ':' || n, ',' ORDER BY n DESC, site) FROM t) AS top_sites, (SELECT sum(n) - max(n) FROM s)::BIGINT AS without_top""")
def a27_unreachable_sites(spark, sf):
    """Failures, distinct sites, the five sites with most failures and the failures without the first of them."""
    n = table(spark, sf, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("site")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "site").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "site"))).alias("top"))
    listed = F.array_join(F.transform("top", lambda x: F.concat_ws(":", x.site.cast("string"), (-x.less).cast("string"))), ",").alias("top_sites")
    return n.agg(F.sum("n").alias("n"), F.count("*").alias("sites"), (F.sum("n") - F.max("n")).alias("without_top")).crossJoin(top.select(listed))


def _bounds(cidr: str) -> tuple[int, int]:
    at, bits = cidr.split("/")
    low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(at.split(".")))
    return low, low + (1 << 32 - int(bits)) - 1


NOT_PUBLIC = " OR ".join("n BETWEEN {} AND {}".format(*_bounds(c)) for c in RESERVED)
ADDRESS4 = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"


@query(f"""WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{ADDRESS4}')) AS ip FROM documents), p AS (SELECT doc_id, ip, list_transform(str_split(ip, '.'), lambda x: x::BIGINT) AS o FROM a), q AS (SELECT doc_id, ip, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS n FROM p WHERE list_max(o) <= 255)
 SELECT doc_id, ip, NOT ({NOT_PUBLIC}) AS public FROM q""")
def c45_public_addresses(spark, sf):
    """Addresses of all texts; a part above 255 is none."""
    a = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ADDRESS4), F.lit(0)))).alias("ip")).distinct()
    o = F.transform(F.split("ip", "[.]"), lambda x: x.cast("long"))
    n = F.aggregate("o", F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    return a.withColumn("o", o).filter(F.array_max("o") <= 255).withColumn("n", n).select("doc_id", "ip", (~F.expr(NOT_PUBLIC)).alias("public"))


LONG_TOKENS = [t for t in TOKENS if len(t) > 3]
TITLE = "<title>([^<]*)</title>"


@query(f"SELECT page_id, {' OR '.join(f'''contains(lower(regexp_extract(html, '{TITLE}', 1)), '{t}')''' for t in LONG_TOKENS)} AS hit FROM pages")
def c27_token_in_title(spark, sf):
    title = F.lower(F.regexp_extract("html", TITLE, 1))
    return table(spark, sf, "pages").select("page_id", F.exists(F.array(*map(F.lit, LONG_TOKENS)), lambda t: F.contains(title, t)).alias("hit"))


@query(f"SELECT name, strength, CASE WHEN name = 'icon' AND strength = 'strong' THEN 'moderate' WHEN name = 'form' THEN 'weak' ELSE strength END AS effective, count(*) AS n FROM {SIGNALS} GROUP BY 1, 2, 3")
def c28_effective_strength(spark, sf):
    """A configured ceiling can lower a signal, never raise it."""
    order = F.array(*map(F.lit, ("weak", "moderate", "strong")))
    top = F.coalesce(F.try_element_at(F.create_map(F.lit("icon"), F.lit(2), F.lit("form"), F.lit(1)), F.col("name")), F.lit(3))
    lowered = F.get(order, F.least(F.array_position(order, F.col("strength")).cast("int"), top) - 1)
    return signals(spark, sf).groupBy("name", "strength", lowered.alias("effective")).agg(F.count("*").alias("n"))


@query(f"WITH k AS (SELECT DISTINCT suffix FROM {ETLD_SQL}), m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{ADDRESS}', 1))) AS suffix FROM documents) SELECT doc_id, count(k.suffix) AS confirmed, CASE WHEN count(k.suffix) > 0 THEN 'clean,malicious' ELSE 'clean' END AS history FROM m LEFT JOIN k USING (suffix) GROUP BY 1")
def j18_rescored_mail(spark, sf):
    """Mail is judged anew where a sender's domain is among the confirmed ones; the history grows by one entry."""
    known = etld1(hosts(spark, sf), suffix_table(spark)).select("suffix").distinct().withColumn("hit", F.lit(1))
    found = F.transform(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(1)), F.lower)
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("suffix")).distinct()
    out = m.join(known, "suffix", "left").groupBy("doc_id").agg(F.count("hit").alias("confirmed"))
    return out.select("doc_id", "confirmed", F.when(F.col("confirmed") > 0, "clean,malicious").otherwise("clean").alias("history"))


KITS = f"(SELECT page_id, url, sha256(array_to_string({TAGS}, ' ')) AS kit FROM pages)"


def kits(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.sha2(F.array_join(tags("html"), " "), 256).alias("kit"))


@query(f"SELECT kit, min(page_id) AS label, count(*) AS pages FROM {KITS} GROUP BY 1")
def g08_kit_registration(spark, sf):
    """First label wins."""
    return kits(spark, sf).groupBy("kit").agg(F.min("page_id").alias("label"), F.count("*").alias("pages"))


@query(f"SELECT page_id, nullif(min(page_id) OVER (PARTITION BY kit), page_id) AS known FROM {KITS}")
def j19_known_kit(spark, sf):
    k = kits(spark, sf)
    known = k.groupBy("kit").agg(F.min("page_id").alias("label"))
    return k.join(known, "kit", "left").select("page_id", F.nullif("label", F.col("page_id")).alias("known"))


@query(f"SELECT page_id FROM {KITS} WHERE kit IS NULL OR kit NOT IN (SELECT kit FROM {KITS} WHERE contains(url, 'ref=') AND kit IS NOT NULL)")
def l10_disjoint_kits(spark, sf):
    """Pages whose kit no evaluated page has."""
    k = kits(spark, sf)
    return k.join(k.filter("contains(url, 'ref=')").select("kit"), "kit", "left_anti").select("page_id")


@query("WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), t AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT t.l_suppkey, count(r.l_partkey) AS exact, count(a.l_partkey) AS any_brand FROM t LEFT JOIN r ON r.l_suppkey = t.l_suppkey AND r.l_partkey = t.l_partkey LEFT JOIN (SELECT DISTINCT l_partkey FROM r) a ON a.l_partkey = t.l_partkey GROUP BY 1")
def j20_icon_matches(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    seen = l.filter("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct()
    tested = l.filter("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    j = tested.join(seen.withColumn("e", F.lit(1)), ["l_suppkey", "l_partkey"], "left").join(seen.select("l_partkey").distinct().withColumn("a", F.lit(1)), "l_partkey", "left")
    hits = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return j.groupBy("l_suppkey").agg(hits("e").alias("exact"), hits("a").alias("any_brand"))


@query(f"SELECT domain, sum(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS points FROM {SIGNALS} GROUP BY 1")
def f01_sql_function(spark, sf):
    """A temporary SQL function, inlined by the optimizer."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strength_points(s STRING) RETURNS INT RETURN CASE s WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END")
    return signals(spark, sf).groupBy("domain").agg(F.sum(F.expr("strength_points(strength)")).alias("points"))


@query(f"SELECT idx, '{{\"operator\":\"' || operator || '\",\"cert\":' || cert || '}}' AS value FROM {MESSAGES}")
def s20_feed_rows(spark, sf):
    return messages(spark, sf).select("idx", F.to_json(F.struct("operator", "cert")).alias("value"))
