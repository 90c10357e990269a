"""Triage of names: suffix rules, brand dictionary, the twelve features, rule score with its reasons.

The brand dictionary is an index of keys: the first letters of tokens, their skeletons, and what is left of them after up to two deletions. A name
is looked up by the same keys of its own in one equi-join, and only what shares a key is compared, so the work for a name does not grow with the
dictionary. The index is broadcast up to a checked number of keys; beyond that it is shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..catalog import query
from ..tables import HOSTS, hosts
from .names import KEYWORDS, RISKY, read_label
from .signals import _skeleton_sql, skeleton

#: Beginnings of issuers of free certificates.
FREE_ISSUERS = ("let's encrypt", "zerossl")
#: Contributions of the rules, and the score from which a name is a candidate.
WEIGHTS = {"brand_token_exact": 0.35, "skeleton_exact": 0.75, "lookalike": 0.30, "homoglyph_hit": 0.30, "tld_risk": 0.15, "keyword_count": 0.15, "shape": 0.10}
THRESHOLD = 0.35
SHORT, NEAR = 3, 5
#: The features of a name, in order.
FEATURES = ("brand_token_exact", "min_edit_distance", "homoglyph_hit", "tld_risk", "keyword_count", "hyphen_count", "max_label_len", "digit_ratio", "subdomain_depth", "entropy", "issuer_is_free_ca", "san_count")
#: Letters of a token by which it is found inside a name.
GRAM = 4
#: Keys up to which the index of a dictionary goes to every task.
BROADCAST_KEYS = 1_000_000


@F.pandas_udf(StringType())
def _decoded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else ".".join(map(read_label, n.split("."))))


def decoded(raw):
    """Trimmed, in lower case, without final dots; punycode labels as they read. Only names with such labels go through Python."""
    n = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    coded = n.contains("xn--")
    return F.when(coded, _decoded(F.when(coded, n))).otherwise(n)


def with_suffix(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``labels``, ``suffix``, ``known`` (a rule says so) and ``etld1`` to distinct ``name``s (P05, P06). Rules are (suffix, kind): ``exact``, private
    ones included; ``wildcard``, under which any one label more is a suffix; ``exception``, which is none although a wildcard says so. The
    longest rule counts, an exception before all; a last label without a rule is its own suffix."""
    labels = F.split("name", r"\.")
    tail = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = names.select("name", F.size(labels).alias("n"), F.posexplode(tail).alias("at", "suffix")).join(rules, "suffix")
    length = F.col("n") - F.col("at") + F.when(F.col("kind") == "wildcard", 1).when(F.col("kind") == "exception", -1).otherwise(0)
    found = tails.withColumn("length", length).filter(F.col("length").between(1, F.col("n"))).groupBy("name").agg(F.max(F.struct(F.col("kind") == "exception", "length")).alias("m"))
    out = names.join(found.select("name", F.col("m.length").alias("length")), "name", "left").withColumn("labels", labels)
    last = lambda k: F.array_join(F.slice("labels", -F.least(k, F.size("labels")), F.least(k, F.size("labels"))), ".")
    size = F.coalesce("length", F.lit(1))
    return out.withColumn("suffix", last(size)).withColumn("etld1", F.when(F.col("length") == F.size("labels"), F.col("name")).otherwise(last(size + 1))).withColumn("known", F.col("length").isNotNull()).drop("length")


def edits(s, t, most=None):
    """Damerau-Levenshtein distance up to 2; 3 for all beyond, or beyond ``most`` (C11)."""
    swaps = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.lit(1)), x.substr(i, F.lit(1)), x.substr(i + 2, F.length(x))))
    plain = F.levenshtein(s, t)
    one = (plain == 1) | (plain == 2) & F.exists(swaps(s), lambda x: x == t)
    # a swap is at most two plain edits
    two = (plain == 2) | (plain <= 4) & (F.exists(swaps(s), lambda x: F.levenshtein(x, t) <= 1) | F.exists(swaps(t), lambda y: F.levenshtein(s, y) <= 1) | F.arrays_overlap(swaps(s), swaps(t)))
    return F.when(s == t, 0).when(one, 1).when(two if most is None else (most > 1) & two, 2).otherwise(3)


def deletions(s, most):
    """A text, and what is left of it after one deletion, or after one and two where ``most`` is 2. Texts at a distance of k share one that takes at most k
    from either; a swap of neighbours counts as one."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
    once = one(s)
    twice = F.when(most == 2, F.flatten(F.transform(F.array_distinct(once), one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(s), once, twice))


def _ascii(c):
    return ~c.rlike(r"[^\x00-\x7F]")


class Dictionary:
    """Brand tokens and the keys by which names find them. ``tokens`` is (token, brand); a token of two brands is an error.

    Keys are a letter and a text: ``g`` first letters of a token of more than SHORT, ``e`` a whole shorter one, ``d`` rests of one of NEAR or more after
    deletions, ``k`` a skeleton, ``h`` first letters of a skeleton, ``x`` the skeleton of a short one. Of tokens with one skeleton the first counts."""

    def __init__(self, tokens: DataFrame):
        size = F.length("token")
        first = tokens.select("token", "brand", skeleton(F.col("token")).alias("skeleton"))
        first = first.withColumn("own", F.min("token").over(Window.partitionBy("skeleton")) == F.col("token"))
        most = F.when(size >= 8, 2).otherwise(1)
        key = lambda kind, text: F.array(F.concat(F.lit(kind), text))
        none = F.array().cast("array<string>")
        keys = F.concat(
            F.when(size > SHORT, F.concat(key("g", F.left("token", F.lit(GRAM))))).otherwise(key("e", F.col("token"))),
            F.when(size >= NEAR, F.transform(deletions(F.col("token"), most), lambda t: F.concat(F.lit("d"), t))).otherwise(none),
            F.when(F.col("own"), F.concat(key("k", F.col("skeleton")), F.when(size > SHORT, key("h", F.left("skeleton", F.lit(GRAM)))).otherwise(key("x", F.col("skeleton"))))).otherwise(none),
        )
        index = first.select("token", "brand", "skeleton", F.explode(keys).alias("key"))
        grams = F.collect_set(F.when(size > SHORT, F.least(F.length("skeleton"), F.lit(GRAM))))  # at most GRAM numbers
        known = first.agg(F.count("*").alias("n"), F.count_distinct("token").alias("distinct"), F.max(size).alias("longest"), F.sum(3 + size + F.when(most == 2, size * size / 2).otherwise(0)).alias("keys"), grams.alias("grams")).first()
        if known["n"] > known["distinct"]:
            raise ValueError("a token of two brands")
        self.longest, self.grams = known["longest"] or 0, sorted(known["grams"])
        self.index = F.broadcast(index) if (known["keys"] or 0) <= BROADCAST_KEYS else index


def _texts(words):
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _split(c):
    return F.filter(F.split(c, "[._-]+"), lambda x: x != "")


def _edges(segments):
    """Segments, and what they are without digits at their ends."""
    return F.array_distinct(F.filter(F.concat(segments, F.transform(segments, lambda x: F.regexp_replace(x, "^[0-9]+|[0-9]+$", ""))), lambda x: x != ""))


def _probes(words: Dictionary):
    """(key, at, text) of a name: the keys by which it may find a token, where they stand and what they are made of; and one empty key."""
    probe = lambda kind, text, at, of: F.struct(F.concat(F.lit(kind), text).alias("key"), at.cast("int").alias("at"), of.alias("text"))
    nothing, none = F.lit(None).cast("string"), F.array().cast("array<struct<key string, at int, text string>>")

    def inside(kind, c, size):
        return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: probe(kind, c.substr(i, F.lit(size)), i, nothing))).otherwise(none)

    def whole(kind, texts, of=lambda x: x):
        return F.transform(texts, lambda x, i: probe(kind, of(x), i, x))

    def near(s, i):
        most = F.when(F.length(s) >= 8, 2).otherwise(1)
        fits = F.length(s).between(NEAR - 1, words.longest + 2)
        return F.when(fits, F.transform(deletions(s, most), lambda t: probe("d", t, i, s))).otherwise(none)

    body, changed = F.col("body"), F.col("skeleton") != F.col("body")
    hidden = F.when(changed, F.concat(*[inside("h", F.col("skeleton"), g) for g in words.grams], whole("k", F.col("segments"), lambda x: skeleton(x, False)))).otherwise(none)
    shorts = F.when(~_ascii(body), whole("x", F.filter(_edges(_split("skeleton")), lambda x: F.length(x) <= SHORT))).otherwise(none)
    return F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("at"), nothing.alias("text"))), inside("g", body, GRAM), whole("e", F.filter("edges", lambda x: F.length(x) <= SHORT)), F.flatten(F.transform("segments", near)), hidden, shorts)


def matches(names: DataFrame, words: Dictionary) -> DataFrame:
    """Names (``name``, ``body``, ``segments``, ``edges``, ``skeleton`` and whatever else) with the tokens they hold, found by keys and then compared."""
    kept = names.columns
    rows = names.withColumn("probe", F.explode(_probes(words))).select(*kept, "probe.key", "probe.at", "probe.text").join(words.index.withColumnRenamed("skeleton", "sk"), "key", "left")
    kind, token, text, body, size = F.left("key", F.lit(1)), F.col("token"), F.col("text"), F.col("body"), F.length("token")
    limit = F.when((F.length(text) >= size) & (size >= 8), 2).otherwise(1)
    rows = rows.withColumn("d", F.when((kind == "d") & (F.abs(F.length(text) - size) <= 2), edits(text, token, limit)))
    right = (
        F.when(kind == "g", body.substr(F.col("at"), size) == token).when(kind == "e", text == token).when(kind == "d", (F.col("d") > 0) & (F.col("d") <= limit))
        .when(kind == "k", (text != token) & (~_ascii(text) | (size >= NEAR))).when(kind == "h", F.col("skeleton").substr(F.col("at"), F.length("sk")) == F.col("sk")).when(kind == "x", ~F.array_contains("edges", token))
    )
    rows = rows.filter((F.col("key") == "") | F.coalesce(right & token.isNotNull(), F.lit(False)))
    of = lambda k, *columns: F.when(kind == k, F.struct(*columns))
    found = rows.groupBy("name").agg(
        F.first(F.when(F.col("key") == "", F.struct(*kept)), ignorenulls=True).alias("row"),
        F.min(of("g", "at", (-size).alias("less"), "token", "brand")).alias("inside"), F.collect_set(F.when(kind == "g", token)).alias("exact"), F.min(of("e", "token", "brand")).alias("brief"),
        F.min(of("k", "at", "token", "brand")).alias("tricked"), F.collect_set(of("d", "d", "at", "token", "brand", "text")).alias("near"),
        F.collect_set(of("h", "at", (-F.length("sk")).alias("less"), "token", "brand", F.contains(body, token).alias("open"))).alias("hidden"), F.min(of("x", "token", "brand")).alias("shorts"),
    )
    return found.select("row.*", *[c for c in found.columns if c not in ("name", "row")])


def features(names: DataFrame, words: Dictionary) -> DataFrame:
    """Distinct names with suffixes (``with_suffix``), ``issuer`` and ``san_count``, and their features."""
    f = names.withColumn("tld", F.element_at(F.split("suffix", r"\."), -1))
    f = f.withColumn("body", F.when(F.col("suffix") == F.col("name"), F.col("name")).otherwise(F.expr("substring(name, 1, length(name) - length(suffix) - 1)")))
    f = f.withColumn("segments", _split("body")).withColumn("edges", _edges(F.col("segments"))).withColumn("skeleton", skeleton(F.col("body")))
    f = matches(f, words)
    hit = lambda c: F.struct(c["token"].alias("token"), c["brand"].alias("brand"))
    f = f.withColumn("match", F.when(F.col("inside").isNotNull(), hit(F.col("inside"))).when(F.col("brief").isNotNull(), hit(F.col("brief"))))
    changed = F.col("skeleton") != F.col("body")
    f = f.withColumn("trick", F.when(changed & F.col("match").isNull() & F.col("tricked").isNotNull(), hit(F.col("tricked"))))
    # a segment that holds a whole token is no lookalike of another
    best = F.array_min(F.filter("near", lambda h: ~F.exists("exact", lambda t: F.contains(h["text"], t))))
    f = f.withColumn("near", F.when(F.col("trick").isNull(), best))
    # hidden tokens from left to right, the longest first, each letter once
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("struct<token string, brand string>").alias("hit"))
    step = lambda x, h: F.when(h["at"] < x["end"], x).otherwise(F.struct((h["at"] - h["less"]).alias("end"), F.when(x["hit"].isNotNull() | h["open"], x["hit"]).otherwise(hit(h)).alias("hit")))
    hidden = F.aggregate(F.array_sort("hidden"), start, step)["hit"]
    f = f.withColumn("hide", F.when(changed & F.col("trick").isNull(), F.coalesce(hidden, F.when(F.col("shorts").isNotNull(), hit(F.col("shorts"))))))
    f = f.withColumns({"matched": F.col("match.token"), "skeleton_exact": F.col("trick.token"), "lookalike": F.col("near.token"), "homoglyph": F.col("hide.token")})
    label = F.when(F.col("etld1") == F.col("suffix"), F.col("etld1")).otherwise(F.expr("substring(etld1, 1, length(etld1) - length(suffix) - 1)"))
    letters = F.filter(F.split(label, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    brand = F.coalesce("match.brand", "trick.brand", "near.brand", "hide.brand")
    return f.select(
        "name", "etld1", "suffix", "tld", "known", "matched", "skeleton_exact", "lookalike", "homoglyph", brand.alias("brand"), F.col("matched").isNotNull().alias("brand_token_exact"),
        F.when(F.col("matched").isNotNull(), 0).otherwise(F.coalesce("near.d", F.lit(99))).alias("min_edit_distance"), F.col("homoglyph").isNotNull().alias("homoglyph_hit"), F.col("tld").isin(*RISKY).alias("tld_risk"),
        sum((F.col("body").contains(k).cast("int") for k in KEYWORDS), F.lit(0)).alias("keyword_count"), F.regexp_count("name", F.lit("-")).alias("hyphen_count"), F.array_max(F.transform("labels", F.length)).alias("max_label_len"),
        (F.regexp_count("name", F.lit("[0-9]")) / F.greatest(F.length("name"), F.lit(1))).alias("digit_ratio"), F.greatest(F.size("labels") - F.size(F.split("suffix", r"\.")), F.lit(0)).alias("subdomain_depth"), F.round(entropy, 6).alias("entropy"),
        F.coalesce(F.exists(_texts(list(FREE_ISSUERS)), lambda x: F.startswith(F.lower("issuer"), x)), F.lit(False)).alias("issuer_is_free_ca"), "san_count",
    )


def scored(f: DataFrame, allowed: DataFrame, brand_tlds: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``reasons`` (feature, value, contribution; they sum to the score), ``score`` and ``candidate``. Public suffixes come first, then names
    whose registrable domain is in ``allowed`` or whose top-level domain a brand owns: both score 0, whatever else they hold."""
    c, reason = F.col, lambda k, v, w: F.struct(F.lit(k).alias("feature"), v.cast("string").alias("value"), w.alias("contribution"))
    rules = [("brand_token_exact", c("matched"), c("matched").isNotNull()), ("skeleton_exact", c("skeleton_exact"), c("skeleton_exact").isNotNull()), ("lookalike", c("lookalike"), c("lookalike").isNotNull()), ("homoglyph_hit", c("homoglyph"), c("homoglyph").isNotNull()), ("tld_risk", F.concat(F.lit("."), "tld"), c("tld_risk")), ("keyword_count", c("keyword_count"), c("keyword_count") > 0), ("shape", F.concat_ws(",", c("hyphen_count").cast("string"), c("max_label_len").cast("string")), (c("hyphen_count") > 3) | (c("max_label_len") > 25))]
    made = F.array_compact(F.array(*[F.when(test, reason(k, v, F.lit(WEIGHTS[k]))) for k, v, test in rules]))
    total = F.round(F.aggregate("made", F.lit(0.0), lambda s, x: s + x.contribution), 6)
    capped = F.when(total > 1, F.concat("made", F.array(reason("cap", F.lit("1.0"), F.round(1 - total, 6))))).otherwise(F.col("made"))
    stop = lambda k: F.array(reason(k, c("etld1"), F.lit(0.0)))
    j = f.join(allowed.select("etld1").distinct().withColumn("listed", F.lit(True)), "etld1", "left").withColumn("made", made)
    listed = F.coalesce("listed", F.lit(False)) | c("tld").isin(*brand_tlds)
    j = j.withColumn("reasons", F.when(c("known") & (c("suffix") == c("name")), stop("public_suffix")).when(listed, stop("allowlisted")).otherwise(capped))
    j = j.withColumn("score", F.round(F.aggregate("reasons", F.lit(0.0), lambda s, x: s + x.contribution), 6))
    return j.withColumn("candidate", c("score") >= THRESHOLD).drop("made", "listed")


def ordered(reasons):
    """Features of a breakdown, by falling contribution, then by name."""
    return F.array_join(F.transform(F.array_sort(F.transform(reasons, lambda r: F.struct((-r.contribution).alias("w"), r.feature.alias("f")))), lambda x: x.f), ",")


def allowlist(ranked: DataFrame, legitimate: DataFrame, rules: DataFrame) -> DataFrame:
    """(etld1) of ranked and legitimate names; names that are public suffixes themselves are skipped."""
    every = ranked.select(decoded(F.col("name")).alias("name")).union(legitimate.select(decoded(F.col("name")).alias("name"))).filter("name <> ''").distinct()
    return with_suffix(every, rules).filter("not (known and suffix = name)").select("etld1").distinct()


#: Dictionary of the queries: tokens that hosts of the given pages hold.
BRANDS = {"tionsh": "Tionsh", "tiontion": "Tion", "tionble": "Tionble", "andble": "Andble", "the": "The", "ththan": "Thanth", "cheap": "Cheap"}
RULES = (("com", "exact"), ("org", "exact"), ("net", "exact"), ("top", "exact"), ("example.com", "exact"), ("example.net", "wildcard"), ("ththan.example.net", "exception"))
LEGITIMATE = ("shop.theres.example.com", "example.net", "www.ththed.example.org")
ISSUERS = ("Let's Encrypt R3", "ZeroSSL CA", "Some Trust CA", "")


def _table(spark: SparkSession, rows, columns: str) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


def variants(spark, sf) -> DataFrame:
    """Distinct names made from each host of ``pages``: itself, and what registrants make of its longest label."""
    h = hosts(spark, sf).filter("host like '%.%'").select("host", F.regexp_extract("host", "([a-z-]+)[.]example", 1).alias("w")).distinct()
    w = F.col("w")
    made = F.array(F.col("host"), F.concat(F.translate(w, "io", "10"), F.lit("-login.top")), F.concat(w.substr(F.lit(2), F.lit(1)), w.substr(F.lit(1), F.lit(1)), w.substr(F.lit(3), F.lit(99)), F.lit(".kyc-update.com")), F.concat(F.translate(w, "oea", "оеа"), F.lit("1-verify.xyz")), F.concat(F.lit("the9."), w, F.lit("s-x-y-z-account.net")), F.concat(F.lit("www"), F.lit("."), F.expr("substring(w, 2)"), F.lit("ab.org")), F.concat(F.lit("xn--he-kyc-4nf2kf."), w, F.lit(".com")))
    return h.select(F.explode(made).alias("name")).select(decoded(F.col("name")).alias("name")).distinct()


def _rule_names(spark, names: DataFrame) -> DataFrame:
    return with_suffix(names, _table(spark, RULES, "suffix string, kind string"))


def triage(spark, sf, names: DataFrame | None = None) -> DataFrame:
    """Features, score and candidate flag of each distinct (name), those of ``variants`` if none are given."""
    issuer = F.element_at(_texts(list(ISSUERS)), F.length("name") % 4 + 1)
    rules = _table(spark, RULES, "suffix string, kind string")
    names = (variants(spark, sf) if names is None else names).select(decoded(F.col("name")).alias("name")).distinct()
    names = _rule_names(spark, names).withColumn("issuer", issuer).withColumn("san_count", F.length("name") % 7 + 1)
    f = features(names, Dictionary(_table(spark, BRANDS.items(), "token string, brand string")))
    popular = hosts(spark, sf).groupBy(F.col("host").alias("name")).agg(F.count("*").alias("n")).filter("n >= 9")
    return scored(f, allowlist(popular, _table(spark, ((x,) for x in LEGITIMATE), "name string"), rules), ("brandtld",))


_lit = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_VARIANTS = f"""(WITH h AS (SELECT DISTINCT host, regexp_extract(host, '([a-z-]+)[.]example', 1) AS w FROM {HOSTS} WHERE host LIKE '%.%')
 SELECT DISTINCT unnest([host, translate(w, 'io', '10') || '-login.top', substring(w, 2, 1) || substring(w, 1, 1) || substring(w, 3) || '.kyc-update.com', translate(w, 'oea', 'оеа') || '1-verify.xyz', 'the9.' || w || 's-x-y-z-account.net', 'www.' || substring(w, 2) || 'ab.org', 'сheар-kyc.' || w || '.com']) AS name FROM h)"""
_RULES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") r(rule, kind)"


def _suffixed(names: str) -> str:
    return f"""(WITH v AS (SELECT name, str_split(name, '.') AS labels FROM {names}), t AS (SELECT name, labels, unnest(range(1, len(labels) + 1)) AS i FROM v),
 m AS (SELECT name, max(((kind = 'exception')::INT) * 1000 + len(labels) - i + 1 + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END) AS x FROM t JOIN {_RULES} ON array_to_string(labels[i:], '.') = rule WHERE len(labels) - i + 1 + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END BETWEEN 1 AND len(labels) GROUP BY 1),
 s AS (SELECT v.name, labels, coalesce(x % 1000, 1) AS k, x IS NOT NULL AS known FROM v LEFT JOIN m USING (name))
 SELECT name, labels, known, array_to_string(labels[len(labels) - k + 1:], '.') AS suffix, array_to_string(labels[greatest(1, len(labels) - k):], '.') AS etld1 FROM s)"""


_SKELETONS = "(SELECT token, {} AS sk FROM (VALUES {}) t(token))".format(_skeleton_sql("token"), ", ".join(f"('{t}')" for t in BRANDS))
_LONG = "|".join(sorted((t for t in BRANDS if len(t) > SHORT), key=lambda w: (-len(w), w)))
TRIAGE_SQL = rf"""WITH s AS {_suffixed(_VARIANTS)}, a AS (SELECT DISTINCT etld1 FROM {_suffixed(f"(SELECT host AS name FROM {HOSTS} GROUP BY 1 HAVING count(*) >= 9 UNION SELECT unnest({_lit(LEGITIMATE)}))")} WHERE NOT (known AND suffix = name)),
 b AS (SELECT *, str_split(suffix, '.')[-1] AS tld, CASE WHEN suffix = name THEN name ELSE left(name, (length(name) - length(suffix) - 1)::INT) END AS body FROM s),
 c AS (SELECT *, regexp_extract_all(body, '[^._-]+') AS segs, {_skeleton_sql('body')} AS sk FROM b),
 d AS (SELECT *, coalesce(nullif(regexp_extract(body, '{_LONG}'), ''), list_min(list_filter(list_concat(segs, list_transform(segs, lambda x: regexp_replace(x, '^[0-9]+|[0-9]+$', '', 'g'))), lambda x: x IN ('the')))) AS matched FROM c),
 g AS (SELECT name, unnest(segs) AS seg, unnest(range(1, len(segs) + 1)) AS pos FROM d),
 e AS (SELECT g.name, arg_min(t.token, pos) AS tricked FROM g JOIN {_SKELETONS} t ON {_skeleton_sql('seg')} = t.sk WHERE seg <> token AND (regexp_matches(seg, '[^\x00-\x7F]') OR length(token) >= 5) GROUP BY 1),
 n AS (SELECT g.name, min((damerau_levenshtein(seg, token), pos, token)) AS near FROM g JOIN {_SKELETONS} t ON abs(length(seg) - length(token)) <= 2 WHERE length(token) >= 5 AND length(seg) >= 4 AND NOT regexp_matches(seg, '{_LONG}')
 AND damerau_levenshtein(seg, token) BETWEEN 1 AND CASE WHEN length(seg) >= length(token) AND length(token) >= 8 THEN 2 ELSE 1 END GROUP BY 1),
 o AS (SELECT d.*, CASE WHEN sk <> body AND matched IS NULL THEN tricked END AS skeleton_exact, near FROM d LEFT JOIN e USING (name) LEFT JOIN n USING (name)),
 p AS (SELECT *, CASE WHEN skeleton_exact IS NULL THEN near[3] END AS lookalike, CASE WHEN skeleton_exact IS NULL THEN near[1] END AS distance,
 CASE WHEN sk <> body AND skeleton_exact IS NULL THEN coalesce((SELECT arg_min(t.token, instr(o.sk, t.sk)) FROM {_SKELETONS} t WHERE length(t.token) > 3 AND contains(o.sk, t.sk) AND NOT contains(body, t.token)),
 CASE WHEN regexp_matches(body, '[^\x00-\x7F]') AND list_contains(list_concat(regexp_extract_all(sk, '[^._-]+'), list_transform(regexp_extract_all(sk, '[^._-]+'), lambda x: regexp_replace(x, '^[0-9]+|[0-9]+$', '', 'g'))), 'the') AND NOT list_contains(list_concat(segs, list_transform(segs, lambda x: regexp_replace(x, '^[0-9]+|[0-9]+$', '', 'g'))), 'the') THEN 'the' END) END AS homoglyph FROM o),
 f AS (SELECT *, {' + '.join(f"contains(body, '{k}')::INT" for k in KEYWORDS)} AS keyword_count, length(name) - length(replace(name, '-', '')) AS hyphen_count, list_max(list_transform(labels, lambda x: length(x))) AS max_label_len FROM p),
 w AS (SELECT *, list_filter([CASE WHEN matched IS NOT NULL THEN (-0.35, 'brand_token_exact') END, CASE WHEN skeleton_exact IS NOT NULL THEN (-0.75, 'skeleton_exact') END, CASE WHEN lookalike IS NOT NULL THEN (-0.30, 'lookalike') END, CASE WHEN homoglyph IS NOT NULL THEN (-0.30, 'homoglyph_hit') END,
 CASE WHEN tld IN {RISKY} THEN (-0.15, 'tld_risk') END, CASE WHEN keyword_count > 0 THEN (-0.15, 'keyword_count') END, CASE WHEN hyphen_count > 3 OR max_label_len > 25 THEN (-0.10, 'shape') END], lambda x: x IS NOT NULL) AS why FROM f),
 x AS (SELECT *, CASE WHEN known AND suffix = name THEN 'public_suffix' WHEN etld1 IN (SELECT etld1 FROM a) THEN 'allowlisted' END AS stop, round(-list_sum(list_transform(why, lambda x: x[1])), 6) AS total FROM w),
 z AS (SELECT *, CASE WHEN stop IS NOT NULL THEN 0 ELSE least(coalesce(total, 0), 1)::DOUBLE END AS score, CASE WHEN stop IS NOT NULL THEN stop ELSE array_to_string(list_transform(list_sort(CASE WHEN total > 1 THEN list_append(why, (total - 1, 'cap')) ELSE why END), lambda x: x[2]), ',') END AS reasons FROM x)"""


@query(f"SELECT name, suffix, etld1, known AND suffix = name AS is_suffix FROM {_suffixed(_VARIANTS)}")
def p06_suffix_rules(spark, sf):
    """Registrable domains under exact, private, wildcard and exception rules, and which names are suffixes themselves."""
    return _rule_names(spark, variants(spark, sf)).select("name", "suffix", "etld1", (F.col("known") & (F.col("suffix") == F.col("name"))).alias("is_suffix"))


@query(f"{TRIAGE_SQL} SELECT name, score, score >= 0.35 AS candidate FROM z")
def c13_rule_score(spark, sf):
    """Rule score after the short circuits."""
    return triage(spark, sf).select("name", "score", "candidate")


@query(f"{TRIAGE_SQL} SELECT name, reasons FROM z")
def k08_ordered_reasons(spark, sf):
    """Reasons by falling contribution, equal ones by name."""
    return triage(spark, sf).select("name", ordered(F.col("reasons")).alias("reasons"))


@query(f"{TRIAGE_SQL} SELECT name, matched, skeleton_exact, lookalike, homoglyph, coalesce(CASE WHEN matched IS NOT NULL THEN 0 ELSE distance END, 99) AS min_edit_distance FROM z")
def c04_token_matches(spark, sf):
    """Exact tokens, segments that only look like one, near ones and hidden ones of each name."""
    return triage(spark, sf).select("name", "matched", "skeleton_exact", "lookalike", "homoglyph", "min_edit_distance")


@query(f"{TRIAGE_SQL} SELECT name, tld, tld IN {RISKY} AS tld_risk, keyword_count, hyphen_count, max_label_len, round(len(regexp_extract_all(name, '[0-9]')) / length(name), 9) AS digit_ratio, len(labels) - len(str_split(suffix, '.')) AS subdomain_depth, length(name) % 4 < 2 AS issuer_is_free_ca, length(name) % 7 + 1 AS san_count FROM z")
def l06_feature_matrix(spark, sf):
    """Shape, keyword, issuer and suffix features."""
    return triage(spark, sf).select("name", "tld", "tld_risk", "keyword_count", "hyphen_count", "max_label_len", F.round("digit_ratio", 9).alias("digit_ratio"), "subdomain_depth", "issuer_is_free_ca", "san_count")


@query(f"{TRIAGE_SQL}, u1 AS (SELECT DISTINCT CASE WHEN etld1 = suffix THEN etld1 ELSE left(etld1, (length(etld1) - length(suffix) - 1)::INT) END AS label FROM z), u2 AS (SELECT label, unnest(str_split(label, '')) AS ch FROM u1), q AS (SELECT label, count(*) / length(label) AS p FROM u2 WHERE ch <> '' GROUP BY label, ch) SELECT label, round(-sum(p * log2(p)), 6) AS entropy FROM q GROUP BY 1")
def c10_label_entropy(spark, sf):
    """Entropy of the registrable label."""
    label = F.when(F.col("etld1") == F.col("suffix"), F.col("etld1")).otherwise(F.expr("substring(etld1, 1, length(etld1) - length(suffix) - 1)"))
    return triage(spark, sf).select(label.alias("label"), "entropy").distinct()


@query(f"{TRIAGE_SQL} SELECT coalesce(matched, skeleton_exact, lookalike, homoglyph) AS token, count(*) AS names, count(*) FILTER (score >= 0.35) AS candidates FROM z WHERE coalesce(matched, skeleton_exact, lookalike, homoglyph) IS NOT NULL GROUP BY 1")
def a10_brand_candidates(spark, sf):
    t = triage(spark, sf).withColumn("token", F.coalesce("matched", "skeleton_exact", "lookalike", "homoglyph")).filter("token is not null")
    return t.groupBy("token").agg(F.count("*").alias("names"), F.count_if("candidate").alias("candidates"))
