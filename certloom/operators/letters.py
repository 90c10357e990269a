"""Whole e-mails: headers, hops, links, claimed brands, the twelve signals and the verdict.

A raw message is parsed by expressions; only encoded ones (several parts, base64 or quoted-printable bodies, encoded words in names) carry a value through
the Arrow functions that decode them. Signals parse each message once, into a stored table of its few domains; suffixes, confirmed domains and candidates are
settled for each distinct domain, and messages look theirs up."""

from __future__ import annotations

import functools
import operator
import re
from binascii import a2b_base64
from email import message_from_bytes
from email.errors import HeaderParseError
from email.header import decode_header
from functools import lru_cache
from quopri import decodestring as unquoted

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..catalog import query
from ..functions.storage import materialise
from ..tables import dealt, table
from .forms import auth_results
from .triage import BRANDS, RULES, Dictionary, _table, allowlist, features, scored, with_suffix

#: Headers whose absence is recorded, and how many links are kept.
TRACKED = ("From", "Reply-To", "Return-Path", "Message-ID", "Authentication-Results", "Received", "DKIM-Signature")
MAX_LINKS = 200
STRONG = ("dmarc_fail_brand_from", "display_name_brand_spoof", "link_domain_confirmed", "sender_domain_confirmed")
MODERATE = ("lookalike_sender_domain", "reply_to_mismatch", "spf_fail", "dkim_fail")
WEAK = ("return_path_mismatch", "message_id_mismatch", "received_anomaly", "auth_results_missing")


def domain_of(address):
    """What stands after the last @, without closing signs; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(address, r"@([^@\s<>]+?)[>.\s]*$", 1)), r"\.+$", ""), F.lit(""))


def _as_text(content: bytes, charset: str | None) -> str:
    try:
        return content.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):  # a character set that does not exist
        return content.decode("utf-8", "replace")


def _walked(content: bytes) -> list[str]:
    said, waiting = [], [message_from_bytes(content)]
    while waiting:
        part = waiting.pop()
        if part.is_multipart():
            waiting += reversed(part.get_payload())
        elif part.get_content_type().startswith("text/"):
            said.append(_as_text(part.get_payload(decode=True) or b"", part.get_content_charset()))
    return said


#: Headers as the email package reads them line by line; those of content; and what it needs more care for.
_HEAD = re.compile(r"(?:[!-9;-~]+:[^\n]*\n(?:[ \t][^\n]*\n)*)+")
_CONTENT = re.compile(r"(?im)^content-(?:type|transfer-encoding):[^\n]*\n(?:[ \t][^\n]*\n)*")
_PLAIN, _UNUSUAL = ("", "7bit", "8bit", "binary"), re.compile(r"[^\x00-\x7f]|[\r\x0b\x0c\x1c-\x1e]")


@lru_cache(4096)
def _content(lines: str) -> tuple[str, str | None, str, str | None]:
    """(type, character set, transfer encoding, boundary) that headers of content tell, by the email package; many messages share them."""
    part = message_from_bytes(lines.encode())
    return part.get_content_type(), part.get_content_charset(), str(part.get("content-transfer-encoding", "")).lower(), part.get_boundary()


@lru_cache(4096)
def _separator(boundary: str) -> re.Pattern:
    return re.compile(r"(?m)^--" + re.escape(boundary) + r"(--)?[ \t]*$\n?")


def _regular(raw: str, inner: bool = False) -> list[str] | None:
    """The text parts of an ordinary message: headers and a body, or one level of parts that all have both and are closed; else null."""
    cut = raw.find("\n\n")
    if cut < 0 or not _HEAD.fullmatch(raw, 0, cut + 1):
        return None
    kind, charset, encoding, boundary = _content("".join(_CONTENT.findall(raw, 0, cut + 1)))
    if kind.startswith("multipart/"):
        if inner or not boundary or kind == "multipart/digest" or encoding not in _PLAIN:
            return None
        marks = list(_separator(boundary).finditer(raw, cut + 2))
        if len(marks) < 2 or [m[1] for m in marks] != [None] * (len(marks) - 1) + ["--"]:
            return None
        parts = [_regular(raw[a.end() : b.start() - 1], True) if a.end() < b.start() else None for a, b in zip(marks, marks[1:])]
        return None if None in parts else [said for part in parts for said in part]
    if kind.startswith("message/"):
        return None
    if not kind.startswith("text/"):
        return []
    body = raw[cut + 2 :].encode()
    if encoding == "base64":
        letters = b"".join(body.split())
        if len(letters) % 4 or not re.fullmatch(rb"[A-Za-z0-9+/]*={0,2}", letters):
            return None
        return [_as_text(a2b_base64(letters), charset)]
    if encoding == "quoted-printable":
        return [_as_text(unquoted(body), charset)]
    return [_as_text(body, charset)] if encoding in _PLAIN else None


def text_parts(raw: str) -> str:
    """What the text parts of a message say, decoded, one after another; parts within parts count, other media do not. Ordinary messages are cut at their
    marks, all others go through the email package."""
    said = None if _UNUSUAL.search(raw) else _regular(raw)
    return "\n".join(_walked(raw.encode("utf-8", "replace")) if said is None else said)


def decoded_words(header: str) -> str:
    """A header with its encoded words as they read; as it stands where they are malformed."""
    try:
        return "".join(x if isinstance(x, str) else _as_text(x, charset) for x, charset in decode_header(header))
    except (HeaderParseError, ValueError):
        return header


@F.pandas_udf(StringType())
def _text_parts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else text_parts(x))


@F.pandas_udf(StringType())
def _decoded_words(header: pd.Series) -> pd.Series:
    return header.map(lambda x: None if x is None else decoded_words(x))


def parsed(mails: DataFrame, raw_col: str = "raw", *keep: str) -> DataFrame:
    """Fields of raw messages. Folded lines are joined, names of headers compared without case; a missing header is recorded in ``absent`` and
    gives null. Hops come oldest first. Null messages have no header at all."""
    raw = F.coalesce(F.regexp_replace(F.col(raw_col), "\r\n", "\n"), F.lit(""))
    head = F.regexp_replace(F.regexp_extract(raw, r"(?s)^(.*?)(?:\n\n|$(?!\n))", 1), r"\n[ \t]+", " ")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    m = mails.select(*keep, raw.alias("raw"), head.alias("head"), F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))).alias("headers"))
    head = F.col("head")
    media = F.regexp_extract(F.lower(head), r"(?m)^content-type:\s*([^;\s]+)", 1)
    coded = F.lower(head).rlike(r"(?m)^content-transfer-encoding:\s*(?:base64|quoted-printable)") | media.rlike("^(?:multipart|message)/")
    m = m.withColumn("coded", coded).withColumn("other", (media != "") & ~F.startswith(media, F.lit("text/")))
    plain = F.when(~F.col("other"), F.regexp_extract("raw", r"(?s)\n\n(.*)$", 1)).otherwise("")
    every = lambda name: F.transform(F.filter("headers", lambda h: h["name"] == name), lambda h: h["value"])
    one = lambda name: F.get(every(name), F.lit(0))
    m = m.withColumn("display", F.translate(F.regexp_extract(one("from"), r"^([^<]*)<", 1), '"', ""))
    worded = F.contains("display", F.lit("=?"))
    body = F.when(F.col("coded"), _text_parts(F.when(F.col("coded"), F.col("raw")))).otherwise(plain)
    m = m.withColumns({"body": body, "display": F.when(worded, _decoded_words(F.when(worded, F.col("display")))).otherwise(F.col("display"))})
    display = F.nullif(F.trim("display"), F.lit(""))
    names = F.transform("headers", lambda h: h["name"])
    # no names inside a function of the tracked ones: they would be read again for each
    absent = F.transform(F.array_except(F.array(*[F.lit(t.lower()) for t in TRACKED]), names), lambda t: F.element_at(F.create_map(*[F.lit(x) for t in TRACKED for x in (t.lower(), t)]), t))
    hop = lambda v: F.struct(F.nullif(F.regexp_extract(v, r"(?i)\bfrom\s+([^\s;]+)", 1), F.lit("")).alias("from_host"), F.nullif(F.regexp_extract(v, r"(?i)\bby\s+([^\s;]+)", 1), F.lit("")).alias("by_host"), F.nullif(F.regexp_extract(v, r"[\[(]([0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-fA-F]*:[0-9a-fA-F:.]+)[\])]", 1), F.lit("")).alias("ip"), F.try_to_timestamp(F.regexp_extract(v, r";\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1), F.lit("d MMM yyyy HH:mm:ss Z")).alias("at"))
    links = F.slice(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"""https?://[^\s<>"']+"""), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))), 1, MAX_LINKS)
    m = m.withColumn("links", links)
    hosts = F.array_distinct(F.filter(F.transform("links", lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), lambda h: h != ""))
    return m.select(
        *keep, display.alias("display"), domain_of(one("from")).alias("sender"), domain_of(one("reply-to")).alias("reply"), domain_of(one("return-path")).alias("back"), domain_of(one("message-id")).alias("message"),
        auth_results(every("authentication-results"), one("received-spf")).alias("auth"), F.transform(F.reverse(every("received")), hop).alias("hops"), "links", hosts.alias("link_hosts"), absent.alias("absent"),
    )


def claimed_brand(display, brands: dict[str, str]):
    """Brand that a display name claims: squashed of all but letters and digits it contains the brand's name or a token of more than three
    characters, or a shorter token is one of its words (C41). ``brands`` maps tokens to names; brands are tried in order of their first token."""
    low = F.lower(display)
    squashed, words = F.regexp_replace(low, "[^a-z0-9]+", ""), F.split(low, "[^a-z0-9]+")
    rules: dict[str, list[str]] = {}
    for token, brand in brands.items():
        rules.setdefault(brand, []).append(token)
    out = F
    for brand, tokens in rules.items():
        name = "".join(c for c in brand.lower() if c.isalnum())
        test = squashed.contains(name)
        for t in tokens:
            test = test | (squashed.contains(t) if len(t) > 3 else F.array_contains(words, t))
        out = out.when(test, brand)
    return out.otherwise(None)


def signals(mails: DataFrame, key: str, brands: dict[str, str], legitimate: DataFrame, confirmed: DataFrame, candidates, rules: DataFrame) -> DataFrame:
    """(key, signals): names of the signals of each parsed message, which is read once. ``legitimate`` is (brand, site), ``confirmed`` (site), ``candidates`` a function
    of distinct (name) to those among them that triage holds for candidates."""
    times = F.filter(F.transform("hops", lambda h: h["at"]), lambda t: t.isNotNull())
    backwards = F.exists(F.zip_with(times, F.slice(times, 2, F.size(times)), lambda a, b: F.coalesce(b < a, F.lit(False))), lambda x: x)
    own = mails.select(key, claimed_brand(F.col("display"), brands).alias("brand"), "auth", backwards.alias("backwards"), F.array_contains("absent", "Authentication-Results").alias("unchecked"), "sender", "reply", "back", "message", "link_hosts")
    own = materialise(own, "mails")
    roles = F.array(*[F.struct(F.col(r).alias("name"), F.lit(r != "back").alias("asked")) for r in ("sender", "reply", "back")])
    names = own.select(F.inline(F.concat(roles, F.transform("link_hosts", lambda h: F.struct(h.alias("name"), F.lit(False).alias("asked")))))).filter("name is not null").groupBy("name").agg(F.bool_or("asked").alias("asked"))
    names = materialise(names, "names")
    sites = materialise(names.join(with_suffix(names.select("name"), rules).select("name", F.col("etld1").alias("site")), "name"), "sites")
    near = candidates(sites.filter("asked").select(F.col("site").alias("name")).distinct()).select(F.col("name").alias("site"), F.lit(True).alias("near"))
    owned = legitimate.select("site").distinct().withColumn("owned", F.lit(True))
    bad = confirmed.select("site").distinct().withColumn("bad", F.lit(True))
    # stored, so that few names are known for few when the messages look theirs up
    known = materialise(sites.join(near, "site", "left").join(bad, "site", "left").join(owned, "site", "left").select("name", F.struct("site", "near", "bad", "owned").alias("known")), "known")
    lists = own.select("link_hosts").filter("size(link_hosts) > 0").distinct().select("link_hosts", F.explode("link_hosts").alias("name"))
    lists = materialise(lists.join(known.filter("known.bad").select("name"), "name", "left_semi").select("link_hosts").distinct(), "lists").withColumn("bad_link", F.lit(True))
    found = own.join(lists, "link_hosts", "left")
    for role in ("sender", "reply", "back"):
        found = found.join(known.select(F.col("name").alias(role), F.col("known").alias(f"{role}_known")), role, "left")
    is_ = lambda mark, *of: functools.reduce(operator.or_, [F.coalesce(F.col(f"{r}_known.{mark}"), F.lit(False)) for r in of])
    marks = {"bad_sender": is_("bad", "sender", "reply", "back"), "near": is_("near", "sender", "reply"), "owned": is_("owned", "sender")}
    found = found.withColumns(marks | {r: F.col(f"{r}_known.site") for r in ("sender", "reply", "back")})
    same = legitimate.select("brand", F.col("site").alias("sender"), F.lit(True).alias("own_site")).distinct()
    found = found.join(same, ["brand", "sender"], "left")
    apart = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    unproved = F.col("auth.dmarc") != "pass"
    tests = {
        "dmarc_fail_brand_from": (F.col("auth.dmarc") == "fail") & F.col("owned"), "display_name_brand_spoof": F.col("brand").isNotNull() & F.col("sender").isNotNull() & F.col("own_site").isNull(),
        "link_domain_confirmed": F.col("bad_link"), "sender_domain_confirmed": F.col("bad_sender"), "lookalike_sender_domain": F.col("near"), "reply_to_mismatch": apart("reply", "sender"),
        "spf_fail": F.col("auth.spf").isin("fail", "softfail"), "dkim_fail": F.col("auth.dkim") == "fail", "return_path_mismatch": apart("back", "sender") & unproved, "message_id_mismatch": apart("message", "sender") & unproved,
        "received_anomaly": F.col("backwards"), "auth_results_missing": F.col("unchecked") & F.col("sender").isNotNull(),
    }
    return found.select(key, F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items()]))).alias("signals"))


def verdict(found):
    """Two strong signals are malicious, any signal is suspicious."""
    strong = F.size(F.filter(found, lambda s: s.isin(*STRONG)))
    return F.when(strong >= 2, "malicious").when(F.size(found) > 0, "suspicious").otherwise("clean")


#: What the queries write: a message of each order, its fields by the order's key.
DOMAINS = ("tionsh.com", "tionhs-login.top", "plain.org", "bad.example.com")
DISPLAYS = ('"Tionsh Care" ', "Plain Shop ", "")


def written(keys: DataFrame) -> DataFrame:
    """A message (o_orderkey, raw) for each (o_orderkey)."""
    k, text = F.col("o_orderkey"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    of = lambda n: F.floor(k / n)
    line = lambda test, *xs: F.when(test, text(*xs)).otherwise("")
    at = lambda minute: text("Received: from mx", F.lit(minute[0]), ".example.net (mx [192.0.2.", F.lit(minute[0]), "]) by in.example.net;\r\n Mon, 6 Oct 2025 10:", F.lit(minute[1]), ":00 +0000\r\n")
    hops = F.when(k % 13 == 0, text(at(("2", "01")), at(("1", "09")))).otherwise(text(at(("2", "09")), at(("1", "01"))))
    body = text("Hello, see ", F.when(k % 6 == 0, "https://bad.example.com/x?y=1.").otherwise("https://plain.org/a, then https://plain.org/a and (https://plain.org/b)!"), "\r\n")
    name = F.trim(F.translate(pick(DISPLAYS, k % 3), '"', ""))
    shown = F.when((of(5) % 2 == 1) & (name != ""), text("=?utf-8?B?", F.base64(name.cast("binary")), "?= ")).otherwise(pick(DISPLAYS, k % 3))
    quoted = F.replace(F.replace(body, F.lit("="), F.lit("=3D")), F.lit("https://"), F.lit("https:=\r\n//"))
    packed = F.base64(body.cast("binary"))
    decoy = F.base64(F.lit("https://bad.example.com/decoy").cast("binary"))
    part = lambda kind, how, x: text("--b1\r\nContent-Type: ", kind, "\r\nContent-Transfer-Encoding: ", how, "\r\n\r\n", x, "\r\n")
    coded = (
        F.when(of(7) % 4 == 1, text("Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", packed))
        .when(of(7) % 4 == 2, text("Content-Type: text/plain;\r\n charset=no-such-set\r\nContent-Transfer-Encoding: Quoted-Printable\r\n\r\n", quoted))
        .when(of(7) % 4 == 3, text('Content-Type: multipart/mixed; boundary="b1"\r\n\r\n', part("application/octet-stream", "base64", decoy), part("text/plain; charset=iso-8859-1", "quoted-printable", quoted), "--b1--\r\n"))
        .otherwise(text("\r\n", body))
    )
    raw = text(
        line(k % 11 != 0, "Authentication-Results: mx; spf=", pick(("pass", "fail", "softfail", "none"), of(2) % 4), "; dkim=", pick(("pass", "fail"), k % 2), "; dmarc=", pick(("pass", "fail", "none"), of(5) % 3), "\r\n"), hops,
        "From: ", shown, "<care@", pick(DOMAINS, k % 4), ">\r\n", line(of(16) % 2 == 0, "Reply-To: x@", pick(DOMAINS, of(4) % 4), "\r\n"),
        "Return-Path: <b@", pick(DOMAINS, of(3) % 4), ">\r\nMessage-ID:\r\n <id1@", F.when(k % 7 == 0, "plain.org").otherwise(pick(DOMAINS, k % 4)), ">\r\n", coded,
    )
    return keys.select("o_orderkey", raw.alias("raw"))


def mails_of_orders(spark, sf) -> DataFrame:
    """The parsed message of each order; keys are dealt first, since a file of keys is small and its messages are not."""
    return parsed(written(dealt(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")), "raw", "o_orderkey")


_pick = lambda xs, n: "[" + ", ".join("'{}'".format(x.replace("'", "''")) for x in xs) + f"][({n})::INT + 1]"
_MAIL = f"""(SELECT k, {_pick(DOMAINS, 'k % 4')} AS f, CASE WHEN k // 16 % 2 = 0 THEN {_pick(DOMAINS, 'k // 4 % 4')} END AS r, {_pick(DOMAINS, 'k // 3 % 4')} AS b, CASE WHEN k % 7 = 0 THEN 'plain.org' ELSE {_pick(DOMAINS, 'k % 4')} END AS m,
 CASE WHEN k % 11 = 0 THEN 'absent' ELSE {_pick(('pass', 'fail', 'softfail', 'none'), 'k // 2 % 4')} END AS spf, CASE WHEN k % 11 = 0 THEN 'absent' ELSE {_pick(('pass', 'fail'), 'k % 2')} END AS dkim, CASE WHEN k % 11 = 0 THEN 'absent' ELSE {_pick(('pass', 'fail', 'none'), 'k // 5 % 3')} END AS dmarc FROM (SELECT o_orderkey AS k FROM orders))"""
_SIGNALS = f"""(SELECT k, list_sort(list_filter([CASE WHEN dmarc = 'fail' AND f = 'tionsh.com' THEN 'dmarc_fail_brand_from' END, CASE WHEN k % 3 = 0 AND f <> 'tionsh.com' THEN 'display_name_brand_spoof' END, CASE WHEN k % 6 = 0 THEN 'link_domain_confirmed' END,
 CASE WHEN 'bad.example.com' IN (f, coalesce(r, ''), b) THEN 'sender_domain_confirmed' END, CASE WHEN 'tionhs-login.top' IN (f, coalesce(r, '')) THEN 'lookalike_sender_domain' END, CASE WHEN r <> f THEN 'reply_to_mismatch' END, CASE WHEN spf IN ('fail', 'softfail') THEN 'spf_fail' END,
 CASE WHEN dkim = 'fail' THEN 'dkim_fail' END, CASE WHEN b <> f AND dmarc <> 'pass' THEN 'return_path_mismatch' END, CASE WHEN m <> f AND dmarc <> 'pass' THEN 'message_id_mismatch' END, CASE WHEN k % 13 = 0 THEN 'received_anomaly' END, CASE WHEN k % 11 = 0 THEN 'auth_results_missing' END], lambda x: x IS NOT NULL)) AS s FROM {_MAIL})"""


def mail_signals(spark, sf, mails: DataFrame | None = None) -> DataFrame:
    """Signals of parsed mails, those of all orders if none are given."""
    rules = _table(spark, RULES, "suffix string, kind string")
    legitimate = _table(spark, [("Tionsh", "tionsh.com")], "brand string, site string")

    def candidates(names: DataFrame) -> DataFrame:
        f = features(with_suffix(names, rules).withColumn("issuer", F.lit(None).cast("string")).withColumn("san_count", F.lit(1)), Dictionary(_table(spark, BRANDS.items(), "token string, brand string")))
        none = _table(spark, [], "name string")
        return scored(f, allowlist(none, legitimate.select(F.col("site").alias("name")), rules)).filter("candidate")

    mails = mails_of_orders(spark, sf) if mails is None else mails
    return signals(mails, "o_orderkey", BRANDS, legitimate, _table(spark, [("bad.example.com",)], "site string"), candidates, rules)


@query(f"SELECT k AS o_orderkey, array_to_string(s, ',') AS signals FROM {_SIGNALS}")
def c42_mail_signals(spark, sf):
    """Four strong, four moderate and four weak signals of each message."""
    return mail_signals(spark, sf).select("o_orderkey", F.array_join("signals", ",").alias("signals"))


@query(f"SELECT k AS o_orderkey, CASE WHEN len(list_filter(s, lambda x: x IN {STRONG})) >= 2 THEN 'malicious' WHEN len(s) > 0 THEN 'suspicious' ELSE 'clean' END AS verdict FROM {_SIGNALS}")
def c43_mail_verdict(spark, sf):
    return mail_signals(spark, sf).select("o_orderkey", verdict(F.col("signals")).alias("verdict"))


@query("SELECT o_orderkey, hop, 'mx' || (hop + 1) || '.example.net' AS from_host, 'in.example.net' AS by_host, '192.0.2.' || (hop + 1) AS ip, CASE WHEN (o_orderkey % 13 = 0) = (hop = 0) THEN 9 ELSE 1 END AS minute FROM orders, (VALUES (0), (1)) h(hop)")
def c37_reversed_hops(spark, sf):
    """Hops of each message, oldest first, with hosts, address and time."""
    m = mails_of_orders(spark, sf).select("o_orderkey", F.posexplode("hops").alias("hop", "h"))
    return m.select("o_orderkey", "hop", "h.from_host", "h.by_host", "h.ip", F.minute("h.at").alias("minute"))


@query(f"SELECT k AS o_orderkey, concat_ws(',', CASE WHEN r IS NULL THEN 'Reply-To' END, CASE WHEN spf = 'absent' THEN 'Authentication-Results' END, 'DKIM-Signature') AS absent FROM {_MAIL}")
def c40_absent_headers(spark, sf):
    return mails_of_orders(spark, sf).select("o_orderkey", F.array_join("absent", ",").alias("absent"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'https://bad.example.com/x?y=1' ELSE 'https://plain.org/a https://plain.org/b)' END AS links, CASE WHEN o_orderkey % 6 = 0 THEN 'bad.example.com' ELSE 'plain.org' END AS hosts FROM orders")
def c39_links(spark, sf):
    """Distinct links in order, without closing punctuation, and their hosts."""
    return mails_of_orders(spark, sf).select("o_orderkey", F.array_join("links", " ").alias("links"), F.array_join("link_hosts", " ").alias("hosts"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Tionsh' END AS brand FROM orders")
def c41_claimed_brand(spark, sf):
    return mails_of_orders(spark, sf).select("o_orderkey", claimed_brand(F.col("display"), BRANDS).alias("brand"))
