"""Edges from enrichment records and the parsers behind them."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..catalog import query
from ..tables import table

#: How strongly a shared attribute ties names together; the kinds that can be taken down.
EDGE_WEIGHTS = {"kit_hash": 1.0, "favicon_hash": 0.85, "ip": 0.80, "nameserver": 0.60, "asn": 0.35, "cert_issuer": 0.15, "registrar": 0.15}
TAKEDOWN = ("ip", "nameserver", "registrar")
#: Networks and name servers that unrelated sites share by the million.
SHARED_ASNS = (13335, 16509, 14618, 15169, 54113, 20940, 16625, 8075)
SHARED_DNS = ("cloudflare.com", "domaincontrol.com", "registrar-servers.com", "googledomains.com", "google.com", "nsone.net", "azure-dns.com", "azure-dns.net", "azure-dns.org", "azure-dns.info", "dnsmadeeasy.com", "ultradns.net", "akam.net", "dynect.net", "name-services.com", "hostinger.com", "dns-parking.com", "digitalocean.com", "vercel-dns.com", "netlify.com", "wixdns.net", "squarespacedns.com")
SHARED_LABELS = ("awsdns-",)


def server_name(ns):
    return F.regexp_replace(F.lower(ns), r"\.+$", "")


def shared_dns(ns):
    """Whether a name server is a managed provider's, by its last two labels or the beginning of one."""
    n = server_name(ns)
    out = F.substring_index(n, ".", -2).isin(*SHARED_DNS)
    for label in SHARED_LABELS:
        out = out | F.exists(F.split(n, r"\."), lambda x: F.startswith(x, F.lit(label)))
    return out


def edges_of(records: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, value, weight) of enrichment records with ip_addresses, nameservers, asn, cert_issuer, registrar, kit_hash and favicon_hash.
    Addresses and the number of a shared network, and shared name servers, make no edge; neither do missing values."""
    apart = F.coalesce(~F.col("asn").isin(*SHARED_ASNS), F.lit(True))
    row = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"), F.lit(EDGE_WEIGHTS[kind]).alias("weight"))
    none = F.array().cast("array<string>")
    lists = {"ip": F.when(apart, F.col("ip_addresses")), "nameserver": F.transform(F.filter("nameservers", lambda n: ~shared_dns(n)), server_name), "asn": F.when(apart, F.array_compact(F.array(F.col("asn").cast("string"))))}
    lists |= {k: F.array_compact(F.array(F.nullif(F.col(k), F.lit("")))) for k in ("cert_issuer", "registrar", "kit_hash", "favicon_hash")}
    return records.select(F.col(id_col), F.inline(F.concat(*[F.transform(F.coalesce(v.cast("array<string>"), none), row(k)) for k, v in lists.items()]))).distinct()


def targets(edges: DataFrame) -> DataFrame:
    """The edges to what can be taken down."""
    return edges.filter(F.col("kind").isin(*TAKEDOWN))


@F.pandas_udf(BooleanType())
def _public(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False
        return a.is_global and not (a.is_multicast or a.is_reserved or a.is_loopback or a.is_link_local)

    for s in batches:
        yield s.map(one)


def public_address(ip):
    """Whether an IPv4 or IPv6 address is public; what is no address is not."""
    return F.coalesce(_public(F.coalesce(ip, F.lit(""))), F.lit(False))


def registration(document):
    """(registrar, abuse, registered) of a registration document in JSON (C46): the registrar's name and its abuse contact's address from the
    entities' cards, the time of the registration event."""
    card = "vcardArray string"
    entity = f"array<struct<roles array<string>, {card}, entities array<struct<roles array<string>, {card}>>>>"
    doc = F.from_json(document, f"entities {entity}, events array<struct<eventAction string, eventDate string>>")
    field = lambda c, name: F.nullif(F.regexp_extract(c, rf'\["{name}",\{{[^}}]*\}},"[a-z]+","([^"]*)"\]', 1), F.lit(""))
    role = lambda es, r: F.get(F.filter(es, lambda e: F.array_contains(e["roles"], r)), F.lit(0))
    registrar = role(doc["entities"], "registrar")
    abuse = F.coalesce(role(registrar["entities"], "abuse")["vcardArray"], role(doc["entities"], "abuse")["vcardArray"])
    event = F.get(F.filter(doc["events"], lambda e: e["eventAction"] == "registration"), F.lit(0))
    return F.struct(field(registrar["vcardArray"], "fn").alias("registrar"), field(abuse, "email").alias("abuse"), F.try_to_timestamp(event["eventDate"]).alias("registered"))


def network(record):
    """(asn, prefix, country) of a ``number | prefix | country | ...`` text record; of several numbers the first."""
    parts = F.transform(F.split(F.translate(record, '"', ""), r"\|"), lambda x: F.trim(x))
    return F.struct(F.substring_index(F.get(parts, F.lit(0)), " ", 1).try_cast("long").alias("asn"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("prefix"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("country"))


def origin(url):
    """scheme://host[:port] of an absolute URL, in lower case."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?[^/?#]+)", 1), "//[^/@]*@", "//")), F.lit(""))


def public_host(host):
    """Whether a host is a name that can be reached: several labels of legal form, the last of letters."""
    low = F.lower(host)
    labels = F.split(low, r"\.")
    legal = lambda x: F.length(x).between(1, 63) & ~x.rlike("[^a-z0-9-]") & ~F.startswith(x, F.lit("-")) & ~F.endswith(x, F.lit("-"))
    last = F.element_at(labels, -1)
    return F.length(low).between(4, 253) & (F.size(labels) > 1) & F.forall(labels, legal) & ~last.rlike("[^a-z]") & (F.length(last) > 1)


def records(spark, sf) -> DataFrame:
    """An enrichment record of each supplier."""
    k = F.col("s_suppkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        k, F.array(F.concat(F.lit("198.18.0."), k % 50), F.concat(F.lit("198.18.1."), k % 7)).alias("ip_addresses"), F.array(F.concat(F.lit("NS1."), pick(("cloudflare.com", "own.example.net", "plain.org"), k % 3), F.lit(".")), F.concat(F.lit("ns-1."), pick(("awsdns-01.org", "other.org"), k % 2))).alias("nameservers"),
        F.when(k % 5 != 0, pick((13335, 64500, 64501, 8075), k % 4)).alias("asn"), pick(("", "Some CA"), k % 2).alias("cert_issuer"), F.when(k % 3 == 0, "Registrar One").alias("registrar"), F.concat(F.lit("kit"), k % 9).alias("kit_hash"), F.lit(None).cast("string").alias("favicon_hash"),
    )


_E = """(WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN [13335, 64500, 64501, 8075][s_suppkey % 4 + 1] END AS asn FROM supplier), u AS (SELECT *, coalesce(asn NOT IN (13335, 8075), true) AS apart FROM s)
 SELECT k AS s_suppkey, 'ip' AS kind, '198.18.0.' || k % 50 AS value, 0.8 AS weight FROM u WHERE apart UNION SELECT k, 'ip', '198.18.1.' || k % 7, 0.8 FROM u WHERE apart UNION SELECT k, 'asn', asn::VARCHAR, 0.35 FROM u WHERE apart AND asn IS NOT NULL
 UNION SELECT k, 'nameserver', 'ns1.' || ['', 'own.example.net', 'plain.org'][k % 3 + 1], 0.6 FROM u WHERE k % 3 <> 0 UNION SELECT k, 'nameserver', 'ns-1.other.org', 0.6 FROM u WHERE k % 2 = 1
 UNION SELECT k, 'cert_issuer', 'Some CA', 0.15 FROM u WHERE k % 2 = 1 UNION SELECT k, 'registrar', 'Registrar One', 0.15 FROM u WHERE k % 3 = 0 UNION SELECT k, 'kit_hash', 'kit' || k % 9, 1.0 FROM u)"""


@query(f"SELECT s_suppkey, kind, value, weight::DOUBLE AS weight FROM {_E}")
def g01_edges_from_enrichment(spark, sf):
    """Edges of seven kinds with their weights; shared networks and name servers make none."""
    return edges_of(records(spark, sf), "s_suppkey")


@query(f"SELECT s_suppkey, kind, value FROM {_E} WHERE kind IN {TAKEDOWN}")
def i01_takedown_targets(spark, sf):
    return targets(edges_of(records(spark, sf), "s_suppkey")).select("s_suppkey", "kind", "value")


@query("SELECT s_suppkey, 'Registrar ' || s_nationkey AS registrar, CASE WHEN s_suppkey % 2 = 0 THEN 'abuse@r' || s_nationkey || '.example' END AS abuse, 2000 + s_nationkey AS year FROM supplier")
def c46_document_fields(spark, sf):
    """Registration documents of suppliers, written as JSON and read back."""
    n = F.col("s_nationkey").cast("string")
    card = lambda name, v: F.concat(F.lit('["vcard",[["version",{},"text","4.0"],["' + name + '",{},"text","'), v, F.lit('"]]]'))
    abuse = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"roles":["abuse"],"vcardArray":'), card("email", F.concat(F.lit("abuse@r"), n, F.lit(".example"))), F.lit("}"))).otherwise("")
    doc = F.concat(F.lit('{"entities":[{"roles":["technical"]},{"roles":["registrar"],"vcardArray":'), card("fn", F.concat(F.lit("Registrar "), n)), F.lit(',"entities":['), abuse, F.lit(']}],"events":[{"eventAction":"expiration","eventDate":"2031-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"'), F.col("s_nationkey") + 2000, F.lit('-05-06T07:08:09Z"}]}'))
    return table(spark, sf, "supplier").select("s_suppkey", registration(doc).alias("r")).select("s_suppkey", "r.registrar", "r.abuse", F.year("r.registered").alias("year"))


@query("SELECT s_suppkey, (64000 + s_nationkey)::BIGINT AS asn, '198.51.' || s_nationkey || '.0/24' AS prefix, CASE WHEN s_suppkey % 3 > 0 THEN 'IN' END AS country FROM supplier")
def c47_record_fields(spark, sf):
    country = F.when(F.col("s_suppkey") % 3 > 0, " IN ").otherwise("  ")
    record = F.concat(F.lit('"'), F.col("s_nationkey") + 64000, F.lit(" 64999 | 198.51."), F.col("s_nationkey"), F.lit(".0/24 |"), country, F.lit('| apnic | 2001-01-01"'))
    return table(spark, sf, "supplier").select("s_suppkey", network(record).alias("r")).select("s_suppkey", "r.asn", "r.prefix", "r.country")


@query("SELECT page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,63}$') AS reachable FROM pages")
def c44_origins(spark, sf):
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", origin(F.col("url")).alias("origin"), public_host(host).alias("reachable"))
