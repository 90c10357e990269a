"""Why pages could not be judged, whose log a certificate came from, what the weaker page signals say, and whether a model may replace the rules
(A27, C27, C33, C34, L09, P03, S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import HOSTS, MESSAGES, hosts, messages, table
from .enrichment import public_address
from .names import read_names
from .triage import FREE_ISSUERS, RULES, THRESHOLD, _table, with_suffix

#: Operators of logs in order of precedence, and the words of a log's address or name that tell them.
LOG_OPERATORS = (("Google", "googleapis"), ("Google", ".goog"), ("Google", "google"), ("Cloudflare", "cloudflare"), ("DigiCert", "digicert"), ("Sectigo", "sectigo"), ("Let's Encrypt", "letsencrypt"), ("Let's Encrypt", "let's encrypt"), ("TrustAsia", "trustasia"), ("Geomys", "geomys"), ("IPng Networks", "ipng"))
#: Causes of fetches that failed in order of precedence, and the words that tell them.
UNRESOLVED, GUARDED, RESOLVES = "dns: name does not resolve", "ssrf guard: non-public address", "resolves publicly now (was not, or DNS changed)"
DNS_LEAD = "could not fetch: dns:"
FETCH_CAUSES = (
    ("hosting provider phishing interstitial", ("interstitial",)),
    (UNRESOLVED, ()),
    (GUARDED, ("non-public address",)),
    ("timeout", ("Timeout", "timed out", "TimeoutError")),
    ("tls / http protocol error", ("ERR_SSL", "ERR_HTTP2", "SSL", "ProtocolError", "ERR_CERT")),
    ("redirect loop", ("redirect", "ERR_TOO_MANY_REDIRECTS")),
    (UNRESOLVED, ("getaddrinfo failed", "ERR_NAME_NOT_RESOLVED")),
    ("connection refused / reset", ("ConnectError", "ERR_CONNECTION", "refused", "reset")),
    ("response too large", ("too large", "cap")),
)
#: Status codes that are named each, and the characters of an unknown detail that are kept.
NAMED_CODES, OTHER_CHARS = (401, 403, 404), 60
#: Calls that decode what a script hides, coded bytes in a row, characters of base64 in a row, characters of evidence, days of youth.
DECODERS, HEX_RUN, BASE64_RUN, EVIDENCE, YOUNG_DAYS = ("eval", "atob", "unescape"), 21, 2048, 40, 30
#: Limits of the release gate.
POPULAR, LEGITIMATE_SCORE, HARD_RATE, TOP_SHARE = 1000, 0.1, 0.05, 0.40


def log_operator(url, name):
    """The operator of a log by the first rule whose word its address or name has, ``Other`` if none; nulls have no words."""
    text = F.lower(F.concat_ws(" ", url, name))
    out = F
    for operator, word in LOG_OPERATORS:
        out = out.when(text.contains(word), operator)
    return out.otherwise("Other")


def failure_cause(detail):
    """The cause of a failed fetch from its stored detail: error pages by their status, then the first rule whose word the detail has.
    A null detail is an empty one."""
    detail = F.coalesce(detail, F.lit(""))
    digits = F.regexp_extract(detail, "^HTTP ([0-9]+); parked or error page", 1)
    code = digits.try_cast("int")
    page = F.when(code < 400, "parked page (HTTP 2xx/3xx)").when(code.isin(*NAMED_CODES), F.concat(F.lit("HTTP "), digits, F.lit(" error page"))).otherwise(F.concat(F.lit("HTTP "), F.floor(code / 100).cast("string"), F.lit("xx error page ("), digits, F.lit(")")))
    out = F.when(code.isNotNull(), page)
    for cause, words in FETCH_CAUSES:
        told = F.startswith(detail, F.lit(DNS_LEAD)) if not words else F.lit(False)
        for word in words:
            told = told | detail.contains(word)
        out = out.when(told, cause)
    return out.otherwise(F.concat(F.lit("other: "), F.left(detail, F.lit(OTHER_CHARS))))


def unreachable(verdicts: DataFrame, resolved: DataFrame, rules: DataFrame, top: int = 5) -> DataFrame:
    """(part, item, n) of the unreachable among (name, status, detail, source) rows (A27): ``cause`` rows; ``relabelled`` ones, those of addresses
    that were not public and say nothing of DNS, judged again by ``resolved`` (name, address); ``total``; ``sites``, how many there are; ``top_site``
    rows, ties by name; ``excluding_top``, what is left without the first site. Seeds are left out; a null source is none. Without unreachable rows there
    are the total and the sites, both 0.

    Sites are looked up once for each distinct name, and what is kept between the aggregates is one row for each name and cause."""
    rows = verdicts.filter((F.col("status") == "unreachable") & (F.coalesce("source", F.lit("")) != "seed"))
    guarded = (F.col("cause") == GUARDED) & ~F.coalesce(F.col("detail"), F.lit("")).contains("dns:")
    rows = rows.withColumn("cause", failure_cause(F.col("detail"))).select("name", "cause", guarded.alias("again"))
    counts = rows.groupBy("name", "cause", "again").agg(F.count("*").alias("n"))
    asked = counts.filter("again").select("name").distinct()
    address = resolved.select("name", "address").join(asked, "name", "left_semi")
    public = address.select("name", public_address(F.col("address")).alias("public")).groupBy("name").agg(F.bool_and("public").alias("public"))
    counts = counts.join(public, "name", "left")
    now = F.when(F.col("public").isNull(), UNRESOLVED).when(F.col("public"), RESOLVES).otherwise(GUARDED)
    counts = counts.withColumn("cause", F.when(F.col("again"), now).otherwise(F.col("cause")))
    sites = with_suffix(counts.select("name").filter("name is not null").distinct(), rules).select("name", F.col("etld1").alias("site"))
    counts = counts.join(sites, "name", "left")
    part = lambda name, item: F.struct(F.lit(name).alias("part"), item.alias("item"))
    parts = F.array_compact(F.array(part("cause", F.col("cause")), F.when(F.col("again"), part("relabelled", F.col("cause"))), part("site", F.coalesce("site", F.lit("")))))
    sums = counts.select("n", F.explode(parts).alias("p")).groupBy("p").agg(F.sum("n").alias("n")).select("p.part", "p.item", "n")
    named = sums.filter("part <> 'site'")
    by_site = sums.filter("part = 'site'")
    ranked = by_site.orderBy(F.desc("n"), "item").limit(top)
    whole = by_site.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sites"), F.min(F.struct((-F.col("n")).alias("less"), "item")).alias("first"))
    row = lambda name, item, n: F.struct(F.lit(name).alias("part"), item.cast("string").alias("item"), n.alias("n"))
    left = F.when(F.col("first").isNotNull(), row("excluding_top", F.col("first.item"), F.col("n") + F.col("first.less")))
    totals = whole.select(F.inline(F.array_compact(F.array(row("total", F.lit(None), F.col("n")), row("sites", F.lit(None), F.col("sites")), left))))
    return named.unionByName(ranked.select(F.lit("top_site").alias("part"), "item", "n")).unionByName(totals)


def inline_scripts(html):
    """What stands in the script elements of a page that name no source."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script"), F.lit(0))
    head = lambda x: F.substring_index(x, ">", 1)
    own = F.filter(whole, lambda x: ~head(x).rlike(r"(?i)\bsrc="))
    return F.transform(own, lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - 1 - len("</script")))


def hidden_code(code):
    """What shows that a script hides what it does, cut to 40 characters: the first call of a decoder or long run of coded bytes, else a long run
    of base64. Null if there is none (C27)."""
    call = rf"\b(?:{'|'.join(DECODERS)})\s*\(|String\.fromCharCode\s*\(|(?:\\x[0-9a-f]{{2}}){{{HEX_RUN}}}"
    # a run is tried from its first character only, so long texts take linear time
    run = rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{BASE64_RUN}}}"
    found = lambda pattern: F.nullif(F.left(F.regexp_extract(code, pattern, 0), F.lit(EVIDENCE)), F.lit(""))
    return F.coalesce(found("(?i)" + call), found(run))


def weaker_signals(pages: DataFrame, scripts: DataFrame, words: DataFrame, owned: DataFrame, now) -> DataFrame:
    """(page_id, name, strength, detail) of the moderate and weak signals of pages (C27): a title that names the brand a page is not of, a script that hides
    what it does, a password input, a young registration, a free certificate.

    ``pages`` is (page_id, html, title, site, brand, registered, issuer), a row for each page; ``scripts`` (page_id, code) what pages load;
    ``words`` (brand, word) names and tokens of brands, those of over three letters count; ``owned`` (brand, site). Nulls give no signal."""
    title = pages.join(owned.select("brand", "site").distinct(), ["brand", "site"], "left_anti").select("page_id", "brand", F.lower("title").alias("low"), "title")
    listed = words.select("brand", F.lower("word").alias("word")).filter(F.length("word") > 3)
    named = title.join(listed, "brand").filter(F.contains("low", F.col("word"))).select("page_id", F.format_string("title '%s' names %s", F.left("title", F.lit(80)), "brand").alias("detail")).distinct()
    own = pages.select("page_id", F.posexplode(inline_scripts(F.col("html"))).alias("at", "code"))
    loaded = scripts.select("page_id", F.lit(-1).alias("at"), "code").join(pages.select("page_id"), "page_id", "left_semi")
    code = loaded.unionByName(own).select("page_id", "at", hidden_code(F.col("code")).alias("hit")).filter("hit is not null")
    hidden = code.groupBy("page_id").agg(F.min(F.struct("at", "hit")).hit.alias("hit")).select("page_id", F.format_string("script contains '%s'", "hit").alias("detail"))
    days = F.floor((F.unix_seconds(now) - F.unix_seconds("registered")) / 86_400)
    free = F.lit(False)
    for lead in FREE_ISSUERS:
        free = free | F.startswith(F.lower("issuer"), F.lit(lead))
    one = lambda name, strength, detail: F.struct(F.lit(name).alias("name"), F.lit(strength).alias("strength"), detail.alias("detail"))
    plain = F.array_compact(
        F.array(
            F.when(F.col("html").rlike("(?i)<input[^>]+type=[\"']?password"), one("password_field_present", "moderate", F.lit("page asks for a password"))),
            F.when(days < YOUNG_DAYS, one("recently_registered", "weak", F.concat(F.lit("registered "), days.cast("string"), F.lit(" days ago")))),
            F.when(free, one("issuer_is_free_ca", "weak", F.concat(F.lit("certificate issued by "), F.col("issuer")))),
        )
    )
    labelled = lambda df, name: df.select("page_id", F.lit(name).alias("name"), F.lit("moderate").alias("strength"), "detail")
    return pages.select("page_id", F.inline(plain)).unionByName(labelled(named, "title_impersonates_brand")).unionByName(labelled(hidden, "obfuscated_js"))


def release_gate(popular: DataFrame, legitimate: DataFrame, hard: DataFrame, coefficients: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rule, offenders, measure, passed, adopted) of the five checks a model must pass before it replaces the rules.

    ``popular`` is (rank, score), of which the first thousand ranks stay below the threshold; ``legitimate`` (score), all below 0.1; ``hard``
    (score), under 5 % reach the threshold; ``coefficients`` (feature, value), none has 40 % of their sum; ``known`` (bad, score), none on the wrong side.
    A measure of no rows passes nothing; a null score is on the wrong side. ``adopted`` is true if every check passed."""
    at, below = (F.coalesce(F.col("score") >= x, F.lit(True)) for x in (threshold, LEGITIMATE_SCORE))
    n = lambda test: F.count_if(test)
    ranked = popular.filter(F.col("rank") <= POPULAR).agg(n(at).alias("popular"))
    sure = legitimate.agg(n(below).alias("legitimate"))
    rate = hard.agg(n(at).alias("hard"), F.avg(at.cast("double")).alias("rate"))
    share = coefficients.agg((F.max(F.abs("value")) / F.nullif(F.sum(F.abs("value")), F.lit(0.0))).alias("share"))
    sides = known.agg(n(F.col("bad") & F.coalesce(F.col("score") < threshold, F.lit(True))).alias("missed"), n(~F.col("bad") & at).alias("flagged"))
    row = lambda name, offenders, measure, passed: F.struct(F.lit(name).alias("rule"), F.lit(offenders).cast("long").alias("offenders") if offenders is None else F.col(offenders).alias("offenders"), measure.cast("double").alias("measure"), F.coalesce(passed, F.lit(False)).alias("passed"))
    nothing = F.lit(None)
    none = lambda c: F.col(c) == 0
    rules = F.array(
        row("popular_below_threshold", "popular", nothing, none("popular")),
        row("legitimate_below_0.1", "legitimate", nothing, none("legitimate")),
        row("hard_rate_below_0.05", "hard", F.round("rate", 9), F.col("rate") < HARD_RATE),
        row("top_share_below_0.40", None, F.round("share", 9), F.col("share") < TOP_SHARE),
        row("known_bad_missed", "missed", nothing, none("missed")),
        row("known_good_flagged", "flagged", nothing, none("flagged")),
    )
    one = ranked.crossJoin(sure).crossJoin(rate).crossJoin(share).crossJoin(sides).select(rules.alias("rules"))  # one row each
    return one.select(F.forall("rules", lambda r: r.passed).alias("adopted"), F.inline("rules")).select("rule", "offenders", "measure", "passed", "adopted")


#: What the queries write: log addresses and names with their operators, stored details with their causes.
LOGS = (
    ("https://ct.googleapis.com/logs/eu1/", "Argon", "Google"), ("https://Sub.CT.GOOG/x", "", "Google"), ("https://ct.example/1", "google mirror of cloudflare", "Google"), ("https://ct.CLOUDFLARE.com/n", None, "Cloudflare"),
    ("https://wyvern.ct.digicert.com/", "w", "DigiCert"), ("https://mammoth.ct.Sectigo.com", "m", "Sectigo"), ("https://oak.ct.letsencrypt.org", "o", "Let's Encrypt"), ("https://x.example", "Let's Encrypt Oak", "Let's Encrypt"),
    ("https://x.example/trustasia", "t", "TrustAsia"), (None, "Geomys Tuscolo", "Geomys"), ("https://x.example", "IPng Halloumi", "IPng Networks"), ("https://own.example", "own", "Other"), (None, None, "Other"),
)
DETAILS = (
    ("HTTP 404; parked or error page", "HTTP 404 error page"), ("HTTP 503; parked or error page", "HTTP 5xx error page (503)"), ("HTTP 200; parked or error page", "parked page (HTTP 2xx/3xx)"), ("could not fetch: dns: timed out", UNRESOLVED), ("could not fetch: non-public address", None),
    ("could not fetch: Timeout 30000ms exceeded", "timeout"), ("ERR_SSL_PROTOCOL_ERROR", "tls / http protocol error"), ("too many redirects", "redirect loop"), ("getaddrinfo failed", UNRESOLVED), ("ConnectError: reset by peer", "connection refused / reset"),
    ("body too large", "response too large"), ("suspected phishing interstitial, HTTP 403", "hosting provider phishing interstitial"), ("something else that is written in a good many more words than are ever kept", "other: something else that is written in a good many more words tha"), (None, "other: "),
)
_sql = lambda x: "NULL" if x is None else "'{}'".format(x.replace("'", "''"))
_at = lambda xs, n: "[" + ", ".join(map(_sql, xs)) + f"][({n})::INT + 1]"
_one = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))


@query(f"SELECT {_at([x[2] for x in LOGS], f'cert % {len(LOGS)}')} AS log_operator, count(*) AS n FROM {MESSAGES} GROUP BY 1")
def c33_log_operators(spark, sf):
    """Certificates by the operator of their log, the logs' addresses and names as they are written by them."""
    k = F.col("cert") % len(LOGS)
    return messages(spark, sf).groupBy(log_operator(_one([x[0] for x in LOGS], k), _one([x[1] for x in LOGS], k)).alias("log_operator")).agg(F.count("*").alias("n"))


_V = f"""(SELECT o_orderkey AS k, 's' || o_custkey % 40 || CASE o_custkey % 3 WHEN 0 THEN '.co.in' ELSE '.com' END AS site, o_custkey % 4 AS a, {_at([x[1] for x in DETAILS], f'o_orderkey % {len(DETAILS)}')} AS told FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 10 > 0)"""


@query(f"""WITH v AS (SELECT *, told IS NULL AS again, coalesce(told, CASE a WHEN 0 THEN '{UNRESOLVED}' WHEN 1 THEN '{RESOLVES}' ELSE '{GUARDED}' END) AS cause FROM {_V}), s AS (SELECT site, count(*) AS n FROM v GROUP BY 1), t AS (SELECT * FROM s ORDER BY n DESC, site LIMIT 5)
 SELECT 'cause' AS part, cause AS item, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'relabelled', cause, count(*) FROM v WHERE again GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM v UNION ALL SELECT 'sites', NULL, count(*) FROM s
 UNION ALL SELECT 'top_site', site, n FROM t UNION ALL SELECT 'excluding_top', (SELECT site FROM t LIMIT 1), (SELECT sum(n) - max(n) FROM s)::BIGINT""")
def a27_unreachable_causes(spark, sf):
    """Verdicts made from orders: two thirds unreachable, a tenth of the customers seeds; a customer's name has no, public, mixed or private addresses."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("www"), c, F.lit(".s"), (c % 40).cast("string"), F.when(c % 3 == 0, ".co.in").otherwise(".com"))
    rows = table(spark, sf, "orders").select(
        c, name.alias("name"), F.when(k % 3 > 0, "unreachable").otherwise("candidate").alias("status"), F.when(c % 10 == 0, "seed").alias("source"), _one([x[0] for x in DETAILS], k % len(DETAILS)).alias("detail"),
    )
    address = F.when(c % 4 == 1, F.array(F.lit("8.8.8.8"), F.lit("2606:4700::1111"))).when(c % 4 == 2, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).when(c % 4 == 3, F.array(F.lit("fe80::1"))).otherwise(F.array().cast("array<string>"))
    resolved = rows.select("name", F.explode(address).alias("address")).distinct()
    rules = _table(spark, [("com", "exact"), ("in", "exact"), ("co.in", "exact")], "suffix string, kind string")
    return unreachable(rows, resolved, rules)


ADDED = ("<script>x=1;eval (y)</script>", "<script>medieval(y)</script>", "", '<script SRC="a.js">eval(1)</script>', "<script>z='" + "\\x4F" * 21 + "'</script>", "<script>z='" + "\\x4f" * 20 + "'</script>", '<script>b="' + "Ab9+" * 512 + '"</script>', '<script>b="' + ("Ab9+" * 512)[1:] + '"</script>')
BRAND_WORDS, BRAND_SITES = (("Ther", "ther"), ("Ther", "the"), ("Anat Heed", "anat"), ("Anat Heed", "Anat Heed")), (("Ther", "example.com"),)
_TITLE = "<title>([^<]*)</title>"
_P = f"""(SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Ther' WHEN 1 THEN 'Anat Heed' END AS brand, array_to_string(str_split(host, '.')[-2:], '.') AS site, regexp_extract(html, '{_TITLE}', 1) AS title FROM {HOSTS} JOIN (SELECT page_id, html FROM pages) USING (page_id))"""


@query(f"""WITH p AS {_P} SELECT page_id, 'title_impersonates_brand' AS name, 'moderate' AS strength, 'title ''' || left(title, 80) || ''' names ' || brand AS detail FROM p WHERE contains(lower(title), CASE brand WHEN 'Ther' THEN 'ther' ELSE 'anat' END) AND brand IS NOT NULL AND NOT (brand = 'Ther' AND site = 'example.com')
 UNION ALL SELECT page_id, 'obfuscated_js', 'moderate', 'script contains ''' || CASE page_id % 8 WHEN 0 THEN 'eval (' WHEN 2 THEN 'ATOB(' WHEN 4 THEN repeat('\\x4F', 10) ELSE repeat('Ab9+', 10) END || '''' FROM p WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, 'password_field_present', 'moderate', 'page asks for a password' FROM p WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'recently_registered', 'weak', 'registered ' || page_id % 60 || ' days ago' FROM p WHERE page_id % 60 < 30 AND page_id % 7 > 0
 UNION ALL SELECT page_id, 'issuer_is_free_ca', 'weak', 'certificate issued by ' || CASE page_id % 4 WHEN 0 THEN 'Let''s Encrypt R3' ELSE 'ZeroSSL X' END FROM p WHERE page_id % 4 < 2""")
def c27_weaker_signals(spark, sf):
    """Pages with a script, an input, a registration and an issuer of their own added."""
    k, now = F.col("page_id"), F.lit("2025-10-06 00:00:00").cast("timestamp")
    html = F.concat(_one(ADDED, k % len(ADDED)), F.when(k % 5 == 0, "<INPUT name=p Type='Password'>").otherwise(""), F.coalesce("html", F.lit("")))
    site = F.substring_index("host", ".", -2)
    pages = hosts(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").select(
        k, html.alias("html"), F.regexp_extract("html", _TITLE, 1).alias("title"), site.alias("site"), F.when(k % 3 == 0, "Ther").when(k % 3 == 1, "Anat Heed").alias("brand"),
        F.when(k % 7 > 0, F.timestamp_seconds(F.unix_seconds(now) - (k % 60) * 86_400 - 43_200)).alias("registered"), _one(("Let's Encrypt R3", "ZeroSSL X", "Big CA", None), k % 4).alias("issuer"),
    )
    scripts = pages.filter(k % 8 == 2).select("page_id", F.lit('f(ATOB("x"))').alias("code"))
    return weaker_signals(pages, scripts, _table(spark, BRAND_WORDS, "brand string, word string"), _table(spark, BRAND_SITES, "brand string, site string"), now)


@query("""WITH s AS (SELECT d.doc_id, d.lang, d.n_chars / 20000.0 AS score, l.quality = 1 AS good, l.toxic = 1 AS bad FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT lang, avg(score) AS v FROM s GROUP BY 1),
 r AS (SELECT 'popular_below_threshold' AS rule, count(*) FILTER (score >= 0.35 AND doc_id <= 1000) AS offenders, NULL::DOUBLE AS measure FROM s UNION ALL SELECT 'legitimate_below_0.1', count(*) FILTER (good AND score >= 0.1), NULL FROM s
 UNION ALL SELECT 'hard_rate_below_0.05', count(*) FILTER (bad AND score >= 0.35), round(avg((score >= 0.35)::INT) FILTER (bad), 9) FROM s UNION ALL SELECT 'top_share_below_0.40', NULL, round(max(abs(v)) / sum(abs(v)), 9) FROM c
 UNION ALL SELECT 'known_bad_missed', count(*) FILTER (bad AND score < 0.35), NULL FROM s UNION ALL SELECT 'known_good_flagged', count(*) FILTER (NOT bad AND score >= 0.35), NULL FROM s),
 p AS (SELECT *, coalesce(CASE rule WHEN 'hard_rate_below_0.05' THEN measure < 0.05 WHEN 'top_share_below_0.40' THEN measure < 0.4 ELSE offenders = 0 END, false) AS passed FROM r)
 SELECT rule, offenders, measure, passed, (SELECT bool_and(passed) FROM p) AS adopted FROM p""")
def l09_five_checks(spark, sf):
    """The five checks over scores of labelled documents by their length, ranked by id; the mean of a language stands for a coefficient."""
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("rank"), "lang", (F.col("n_chars") / 20000.0).alias("score"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    return release_gate(s, s.filter("good"), s.filter("bad"), s.groupBy(F.col("lang").alias("feature")).agg(F.avg("score").alias("value")), s)


RAW = ("' *.*.XN--BCHER-KVA.' || upper(host) || '..'", "'10.0.' || page_id % 256 || '.1'", "'fe80::' || page_id % 10", "'*.1.2.' || page_id % 9 || '.3.4'", "host || ':443'", "'localhost'", "''", "'*.xn--zz--.' || host")
READ = ("'bücher.' || host", "NULL", "NULL", "'1.2.' || page_id % 9 || '.3.4'", "host || ':443'", "NULL", "NULL", "'xn--zz--.' || host")


@query("SELECT page_id, unnest(range({})) AS at, unnest([{}]) AS name FROM {} WHERE host LIKE '%.%'".format(len(RAW), ", ".join(READ), HOSTS))
def p03_read_names(spark, sf):
    """Names of certificates in odd forms as they read: encoded labels, addresses of both families, what only looks like one, single labels."""
    raw = F.array(*[F.expr(x) for x in RAW])
    return hosts(spark, sf).filter(F.contains("host", F.lit("."))).select("page_id", F.posexplode(read_names(raw)).alias("at", "name")).withColumn("at", F.col("at").cast("long"))
