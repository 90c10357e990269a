"""Forms and credential inputs of pages; dictionaries, identifiers and documents over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import DEPENDENCIES, dependencies, table
from .plans import GREEDY2, greedy

#: Attributes and words that mark an input for a one-time code.
CODE_ATTRIBUTES, CODE_WORDS = ("name", "id", "placeholder", "aria-label"), ("otp", "one time", "one-time")
INPUT = r"(?is)<input\b[^>]*>"
FORM = r"(?is)<form\b.*?(?=</form|<form\b|$)"


def attribute(tag, name: str):
    """Value of an attribute of a start tag, quoted or bare; null where it is missing."""
    at = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.when(tag.rlike(at), F.concat(*[F.regexp_extract(tag, at, k) for k in (1, 2, 3)]))


def forms(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, form, action, method, has_password, host) of every form (C18); ``form`` counts from 0 within its page.

    A missing or empty action is the page itself; absolute, scheme-relative, rooted and relative ones are resolved
    against the page's URL. Null pages have no forms."""
    found = pages.select(F.col(id_col), F.col(url_col).alias("base"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(FORM), F.lit(0))).alias("form", "tag"))
    action = F.trim(F.coalesce(attribute(F.col("tag"), "action"), F.lit("")))
    base = F.regexp_replace("base", r"[?#].*$", "")
    origin = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(base == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(base, r"[^/]*$", ""))
    resolved = (
        F.when(action == "", F.col("base"))
        .when(action.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), action)
        .when(action.startswith("//"), F.concat(F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), action))
        .when(action.startswith("/"), F.concat(origin, action))
        .when(action.rlike(r"^[?#]"), F.concat(base, action))
        .otherwise(F.concat(folder, action))
    )
    out = found.select(F.col(id_col), "form", resolved.alias("action"), F.lower(F.coalesce(F.nullif(attribute(F.col("tag"), "method"), F.lit("")), F.lit("get"))).alias("method"), F.exists(F.regexp_extract_all("tag", F.lit(INPUT), F.lit(0)), asks_password).alias("has_password"))
    return out.withColumn("host", F.lower(F.regexp_extract("action", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)))


def foreign_credential_posts(found: DataFrame, sites: DataFrame, own: DataFrame, legitimate: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, form, site): each page's first password form that goes to another site than its own and no brand's.

    ``sites`` maps host to site, ``own`` id to site, ``legitimate`` lists (site) of brands; hosts without a site are their own."""
    posts = found.filter("has_password and host <> ''").join(sites.select("host", F.col("site").alias("target")), "host", "left").withColumn("target", F.coalesce("target", "host"))
    posts = posts.join(own.select(id_col, "site"), id_col).filter("target <> site").join(legitimate.select(F.col("site").alias("target")), "target", "left_anti")
    return posts.groupBy(id_col).agg(F.min(F.struct("form", "target")).alias("first")).select(id_col, "first.form", F.col("first.target").alias("site"))


@query("SELECT page_id, coalesce(len(regexp_extract_all(html, '<form\\b', 0, 'i')), 0) AS n_forms FROM pages")
def c18_form_counts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    n = forms(pages).groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_forms"))


def asks_password(tag):
    return F.coalesce(F.startswith(F.lower(attribute(tag, "type")), F.lit("password")), F.lit(False))


def asks_code(tag):
    words = "(?i)(?<!\\w)(?:" + "|".join(CODE_WORDS) + ")(?!\\w)"
    named = [F.coalesce(attribute(tag, a).rlike(words), F.lit(False)) for a in CODE_ATTRIBUTES]
    out = F.coalesce(F.startswith(F.lower(attribute(tag, "autocomplete")), F.lit("one-time-code")), F.lit(False))
    for n in named:
        out = out | n
    return out


def credential_input(html):
    """Whether an input of a page asks for a password or one-time code; null pages do not."""
    return F.coalesce(F.exists(F.regexp_extract_all(html, F.lit(INPUT), F.lit(0)), lambda t: asks_password(t) | asks_code(t)), F.lit(False))


@query("SELECT page_id, coalesce(regexp_matches(html, '<input[^>]*(password|one-time-code|otp)', 'i'), false) AS asks FROM pages")
def c24_credential_input(spark, sf):
    return table(spark, sf, "pages").select("page_id", credential_input(F.col("html")).alias("asks"))


def auth_results(headers, received_spf):
    """spf, dkim and dmarc of the top-most results header (C36): the last value of a method counts, ``none`` where it is
    missing and ``absent`` without a header; the Received-SPF header stands in for a missing spf.

    ``headers`` is an array of header values, newest first; both arguments may be null."""
    top = F.try_element_at(headers, F.lit(1))

    def method(name: str):
        values = F.regexp_extract_all(top, F.lit(rf"(?i)\b{name}\s*=\s*([A-Za-z]+)"), F.lit(1))
        return F.when(top.isNull(), "absent").otherwise(F.coalesce(F.lower(F.try_element_at(values, F.lit(-1))), F.lit("none")))

    spf = method("spf")
    other = F.nullif(F.lower(F.regexp_extract(received_spf, r"^\s*(\S+)", 1)), F.lit(""))
    spf = F.when(spf.isin("absent", "none"), F.coalesce(other, spf)).otherwise(spf)
    return F.struct(spf.alias("spf"), method("dkim").alias("dkim"), method("dmarc").alias("dmarc"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'softfail' WHEN o_orderstatus = 'O' THEN 'none' ELSE 'pass' END AS spf,
 CASE WHEN o_orderstatus = 'P' THEN 'absent' WHEN o_orderpriority = '1-URGENT' THEN 'fail' ELSE 'none' END AS dkim FROM orders""")
def c36_auth_results(spark, sf):
    """Header values derived from each order's status and priority."""
    spf = F.when(F.col("o_orderstatus") == "O", "").otherwise(" spf=fail; SPF = Pass")
    dkim = F.when(F.col("o_orderpriority") == "1-URGENT", "; dkim=fail").otherwise("")
    header = F.when(F.col("o_orderstatus") != "P", F.array(F.concat(F.lit("mx.example;"), spf, dkim), F.lit("old; spf=neutral dkim=pass")))
    received = F.when(F.col("o_orderstatus") == "P", "SoftFail (mx: domain of example)")
    return table(spark, sf, "orders").select("o_orderkey", auth_results(header, received).alias("r")).select("o_orderkey", "r.spf", "r.dkim")


def byte_count(text):
    """``12.5 MB`` as a number of bytes, null where it is none."""
    form = r"^\s*([0-9.]+)\s*([kMG]?B)"
    unit = F.regexp_extract(text, form, 2)
    scale = F.when(unit == "B", 1.0).when(unit == "kB", 1e3).when(unit == "MB", 1e6).when(unit == "GB", 1e9)
    return F.regexp_extract(text, form, 1).try_cast("double") * scale


@query("SELECT l_orderkey, l_linenumber, l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 1000000.0 ELSE 1000000000.0 END AS bytes FROM lineitem")
def c48_byte_units(spark, sf):
    units = F.element_at(F.array(*map(F.lit, ("B", "kB", "MB", "GB"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    said = F.concat_ws(" ", F.col("l_quantity").cast("string"), units)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", byte_count(said).alias("bytes"))


def node_ids(nodes: DataFrame) -> DataFrame:
    """Distinct (kind, value) with an id that depends on them alone, so that repeated upserts agree."""
    name = F.md5(F.concat_ws("\x1f", "kind", "value").cast("binary"))
    return nodes.select("kind", "value").distinct().withColumn("id", F.conv(F.left(name, F.lit(15)), 16, 10).cast("long"))


NODES = "(SELECT DISTINCT 'part' AS kind, l_partkey::VARCHAR AS value FROM lineitem UNION SELECT DISTINCT 'supplier', l_suppkey::VARCHAR FROM lineitem)"


@query(f"SELECT kind, value, ('0x' || left(md5(kind || chr(31) || value), 15))::BIGINT AS id FROM {NODES}")
def g02_node_upsert(spark, sf):
    of = lambda kind, c: table(spark, sf, "lineitem").select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")).distinct()
    return node_ids(of("part", "l_partkey").unionByName(of("supplier", "l_suppkey")))


@query(f"{GREEDY2}, t AS (SELECT campaign, node FROM p1 UNION ALL SELECT campaign, node FROM p2), r AS (SELECT campaign, node, gain, 1 AS rank FROM p1 UNION ALL SELECT campaign, node, gain, 2 FROM p2) SELECT campaign, rank, node, gain AS kills FROM r")
def i07_ranked_targets(spark, sf):
    """Chosen targets by marginal kills: the greedy order within the chosen nodes alone, whose kills sum to all killed."""
    dep = dependencies(spark, sf)
    chosen = greedy(dep, 2).select("campaign", "node")
    own = dep.join(chosen, ["campaign", "node"], "left_semi")
    return greedy(own, 2).select("campaign", "rank", "node", F.col("gain").alias("kills"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS kit, l_suppkey AS reporter FROM lineitem), c AS (SELECT l_partkey AS kit, l_suppkey AS reporter, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS by FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
 SELECT p.kit, p.reporter, n_name AS organisation, n_regionkey = 3 AS own, coalesce(c.by, '') AS corroborated FROM p JOIN supplier ON s_suppkey = reporter JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c ON c.kit = p.kit AND c.reporter = p.reporter""")
def j21_inheritance(spark, sf):
    """Publications under each kit with their reporter, whether it is one's own organisation, and who corroborated them."""
    flags = F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))), ",")
    published = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("kit"), F.col("l_suppkey").alias("reporter")).agg(flags.alias("corroborated"))
    who = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("reporter"), F.col("n_name").alias("organisation"), (F.col("n_regionkey") == 3).alias("own"))
    return published.join(who, "reporter").select("kit", "reporter", "organisation", "own", "corroborated")


def duplicate_tokens(brands: DataFrame) -> DataFrame:
    """(token, n) of tokens that several brands claim; a dictionary that has any is rejected."""
    return brands.select("name", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count_distinct("name").alias("n")).filter("n > 1")


@query("SELECT token, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(list_distinct(str_split(p_name, ' '))) AS token FROM part) GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def s07_duplicate_tokens(spark, sf):
    return duplicate_tokens(table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.split("p_name", " ").alias("tokens")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def s15_json_rows(spark, sf):
    """Bulk rows sent as one JSON array an order, taken apart again."""
    line = F.struct("l_linenumber", "l_partkey")
    sent = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(line)).alias("body"))
    return sent.select("l_orderkey", F.inline(F.from_json("body", "array<struct<l_linenumber: int, l_partkey: bigint>>")))


@query("""SELECT o_custkey, '{"customer":' || o_custkey || ',"orders":[' || string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS snapshot FROM orders GROUP BY 1""")
def s21_snapshot(spark, sf):
    """One document a customer, its orders by key."""
    orders = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(orders.alias("orders")).select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders")).alias("snapshot"))
