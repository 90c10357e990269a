"""Host names: normalising, suffixes, tokens, lookalikes, scores."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..catalog import query
from ..tables import HOSTS, hosts

#: Keywords and risky top-level domains.
KEYWORDS = ("verify", "kyc", "secure", "login", "update", "netbanking", "account")
RISKY = ("top", "xyz", "click", "cf", "tk", "gq", "buzz", "rest")
TOKENS = ("tionsh", "tionble", "blogs", "exmaple", "andble", "ingha", "the", "est")


def normalise_name(raw):
    """Lower case without white space around, final dots and leading ``*.``; null for addresses of version 4, single labels and empties. Encoded labels
    and addresses of version 6 are left to ``read_names`` (P03)."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"\.+$", ""), r"^(\*\.)+", "")
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(n.contains(".") & ~n.rlike(rf"^{part}(?:\.{part}){{3}}$"), n)


def read_label(x: str) -> str:
    """A punycode label as it reads; others, and those that cannot be decoded, unchanged."""
    try:
        return x.encode("ascii").decode("idna") if x.startswith("xn--") else x
    except (UnicodeError, ValueError):
        return x


def _read(n: str | None) -> str | None:
    if n and ":" in n:
        try:
            ipaddress.ip_address(n)
            return None
        except ValueError:
            pass
    return n and ".".join(map(read_label, n.split(".")))


@F.pandas_udf(ArrayType(StringType()))
def _read_names(lists: pd.Series) -> pd.Series:
    return lists.map(lambda names: None if names is None else [_read(n) for n in names])


def read_names(raw):
    """A list of names, each normalised and with its labels as they read; null for those that are none, addresses of either version included.
    Only lists with an encoded label or a colon go through Python."""
    names = F.transform(raw, normalise_name)
    odd = F.exists(names, lambda n: F.coalesce(n.contains("xn--") | n.contains(":"), F.lit(False)))
    return F.when(odd, _read_names(F.when(odd, names))).otherwise(names)


def etld1(names: DataFrame, suffixes: DataFrame, name: str = "host") -> DataFrame:
    """Adds ``suffix`` and ``etld1``: the longest listed suffix of each distinct name and one label more (P05, P06). Each
    distinct name is looked up once; an unlisted top-level domain is its own suffix."""
    one = names.select(F.col(name).alias("n")).distinct()
    labels = F.split("n", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = one.select("n", F.posexplode(tails).alias("at", "suffix")).join(suffixes.select("suffix"), "suffix").groupBy("n").agg(F.min_by("suffix", "at").alias("suffix"))
    out = one.join(found, "n", "left").withColumn("suffix", F.coalesce("suffix", F.element_at(labels, -1)))
    more = F.expr("substring_index(n, '.', -(size(split(suffix, '[.]')) + 1))")
    return names.join(out.select(F.col("n").alias(name), "suffix", more.alias("etld1")), name)


def one_swap(s):
    """All strings with two neighbouring characters of ``s`` exchanged."""
    at = F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(1)), s.substr(i, F.lit(1)), s.substr(i + 2, F.length(s))))


def near_token(segment, token):
    """Damerau-Levenshtein distance of at most one (C11)."""
    return (F.levenshtein(segment, token) <= 1) | F.exists(one_swap(segment), lambda x: x == token)


SUFFIXES = ("com", "org", "net", "example.com", "example.net", "example.org", "example")


def suffix_table(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("suffix"))


SUFFIX_SQL = "(VALUES " + ", ".join(f"('{s}')" for s in SUFFIXES) + ") s(suffix)"
ETLD_SQL = f"""(SELECT h.page_id, h.host, coalesce(max_by(suffix, length(suffix)), split_part(host, '.', -1)) AS suffix FROM {HOSTS} h LEFT JOIN {SUFFIX_SQL} ON h.host = suffix OR h.host LIKE '%.' || suffix GROUP BY 1, 2)"""


@query(f"SELECT page_id, suffix, array_to_string(list_slice(str_split(host, '.'), greatest(1, len(str_split(host, '.')) - len(str_split(suffix, '.'))), len(str_split(host, '.'))), '.') AS etld1 FROM {ETLD_SQL}")
def p05_registrable_domain(spark, sf):
    return etld1(hosts(spark, sf), suffix_table(spark)).select("page_id", "suffix", "etld1")


@query(f"SELECT page_id, CASE WHEN host LIKE '%.%' THEN rtrim(ltrim(lower(host), '*.'), '.') END AS name FROM {HOSTS}")
def p03_normalised_name(spark, sf):
    return hosts(spark, sf).select("page_id", normalise_name(F.concat(F.lit("*.*."), F.upper("host"), F.lit("."))).alias("name"))


SEG = r"regexp_extract_all(host, '[^._-]+')"


@query(f"""SELECT page_id, len({SEG}) AS segments, split_part(host, '.', -1) AS tld, len(regexp_extract_all(host, '-')) AS hyphens, list_max(list_transform(str_split(host, '.'), lambda x: length(x))) AS longest, len(str_split(host, '.')) AS depth,
 round(len(regexp_extract_all(host, '[0-9]')) / length(host), 9) AS digit_ratio, regexp_replace(host, '[0-9]+', '#', 'g') AS campaign_key, split_part(host, '.', -1) IN {RISKY} AS risky, {' + '.join(f"contains(host, '{k}')::INT" for k in KEYWORDS)} AS keywords FROM {HOSTS}""")
def c02_name_features(spark, sf):
    """Segments, shape, keywords, risky top-level domain and campaign key."""
    h, labels = F.col("host"), F.split("host", r"\.")
    return hosts(spark, sf).select(
        "page_id", F.size(F.filter(F.split("host", "[._-]+"), lambda x: x != "")).alias("segments"), F.element_at(labels, -1).alias("tld"), F.regexp_count("host", F.lit("-")).alias("hyphens"), F.array_max(F.transform(labels, F.length)).alias("longest"), F.size(labels).alias("depth"),
        F.round(F.regexp_count("host", F.lit("[0-9]")) / F.length("host"), 9).alias("digit_ratio"), F.regexp_replace("host", "[0-9]+", "#").alias("campaign_key"), F.element_at(labels, -1).isin(*RISKY).alias("risky"), sum((h.contains(k).cast("int") for k in KEYWORDS), F.lit(0)).alias("keywords"),
    )


@query(f"""WITH c AS (SELECT DISTINCT host, unnest(str_split(host, '')) AS ch, length(host) AS n FROM (SELECT DISTINCT host FROM {HOSTS}) WHERE host <> ''), p AS (SELECT h.host, c.ch, (length(h.host) - length(replace(h.host, c.ch, ''))) / length(h.host) AS p FROM (SELECT DISTINCT host FROM {HOSTS}) h JOIN c ON c.host = h.host WHERE c.ch <> '')
 SELECT host, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY host""")
def c10_entropy(spark, sf):
    h = hosts(spark, sf).select("host").distinct()
    letters = h.select("host", F.length("host").alias("n"), F.explode(F.filter(F.split("host", ""), lambda c: c != "")).alias("ch"))
    p = letters.groupBy("host", "ch").agg((F.count("*") / F.max("n")).alias("p"))
    return p.groupBy("host").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


TOKEN_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in TOKENS) + ") t(token)"


def tokens(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in TOKENS])).alias("token"))


@query(f"SELECT page_id, token FROM {HOSTS}, {TOKEN_SQL} WHERE (length(token) > 3 AND contains(host, token)) OR (length(token) <= 3 AND list_contains({SEG}, token))")
def j02_token_containment(spark, sf):
    short = F.array_contains(F.split("host", "[._-]+"), F.col("token"))
    hit = F.when(F.length("token") > 3, F.col("host").contains(F.col("token"))).otherwise(short)
    return hosts(spark, sf).join(F.broadcast(tokens(spark)), hit).select("page_id", "token")  # the token list is a fixed dimension


@query(f"SELECT DISTINCT segment, token FROM (SELECT unnest({SEG}) AS segment FROM {HOSTS}), {TOKEN_SQL} WHERE length(token) >= 5 AND segment <> token AND damerau_levenshtein(segment, token) <= 1")
def j03_lookalikes(spark, sf):
    """Equi join on the token's length, one apart at most, before the distance is computed."""
    segments = hosts(spark, sf).select(F.explode(F.split("host", "[._-]+")).alias("segment")).distinct().withColumn("size", F.explode(F.sequence(F.length("segment") - 1, F.length("segment") + 1)))
    listed = tokens(spark).filter("length(token) >= 5").withColumn("size", F.length("token"))
    return segments.join(listed, "size").filter((F.col("segment") != F.col("token")) & near_token(F.col("segment"), F.col("token"))).select("segment", "token").distinct()


@query(f"SELECT token, count(DISTINCT host) AS n FROM {HOSTS}, {TOKEN_SQL} WHERE contains(host, token) GROUP BY 1 ORDER BY n DESC, token LIMIT 5")
def a10_top_brands(spark, sf):
    j = hosts(spark, sf).select("host").distinct().join(F.broadcast(tokens(spark)), F.col("host").contains(F.col("token")))
    return j.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(5)


@query(f"SELECT page_id, CASE WHEN length(split_part(host, '.', 1)) > 7 THEN left(host, 5) ELSE left(split_part(host, '.', 1), (length(split_part(host, '.', 1)) // 2)::INT) END || '***' AS masked FROM {HOSTS}")
def c31_mask(spark, sf):
    first = F.substring_index("host", ".", 1)
    cut = F.when(F.length(first) > 7, F.lit(5)).otherwise(F.floor(F.length(first) / 2).cast("int"))
    return hosts(spark, sf).select("page_id", F.concat(first.substr(F.lit(1), cut), F.lit("***")).alias("masked"))


@query(f"""WITH l AS (SELECT host AS name, min(page_id) AS first_seen FROM {HOSTS} GROUP BY 1) SELECT h.page_id, min(l.first_seen) AS earliest FROM {HOSTS} h JOIN l ON h.host = l.name OR h.host LIKE '%.' || l.name GROUP BY 1""")
def j13_suffix_join(spark, sf):
    h = hosts(spark, sf)
    listed = h.groupBy(F.col("host").alias("tail")).agg(F.min("page_id").alias("first_seen"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return h.select("page_id", F.explode(tails).alias("tail")).join(listed, "tail").groupBy("page_id").agg(F.min("first_seen").alias("earliest"))
