"""Streaming forms (T01-T05, T13-T16) and file sources and sinks (S01-S05, S17, S19): the batch expressions over unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import read_names

MESSAGE = """message_type string, received double, data struct<seen: double, cert_index: bigint, source: struct<name: string, url: string>,
 leaf_cert: struct<sha256: string, fingerprint: string, serial_number: string, not_before: double, not_after: double, all_domains: array<string>, issuer: struct<O: string>>>"""
#: Names that a record keeps; further ones are counted.
MAX_NAMES = 200


def read_messages(spark: SparkSession, path: str, stream: bool = False, files: int = 16) -> DataFrame:
    """JSON lines, plain or gzip; lines that cannot be read stay in ``_bad``, blank ones are skipped; the file is the capture run.

    Lines are read as text and parsed by an expression, so readable and unreadable ones can be used apart without a cache. A torn line keeps
    the fields before the tear; ``records`` and the raw capture leave it out."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read
    modes = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = reader.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", MESSAGE + ", _bad string", modes).alias("m"), F.col("_metadata.file_path").alias("run"))
    return parsed.select("m.message_type", "m.received", "m.data", "m._bad", "run")


def records(messages: DataFrame) -> DataFrame:
    """Certificate records of the usable messages (P01-P04): normalised names in first-seen order, at most MAX_NAMES, overflow counted.

    The fingerprint is the first non-empty one of sha256 and fingerprint; records without any are keyed by log and index. Messages without a
    usable name give none. Encoded labels are kept as they read. ``received`` is our own time of arrival, where the capture has it."""
    leaf = F.col("data.leaf_cert")
    raw = F.coalesce(leaf.all_domains, F.array().cast("array<string>"))
    names = F.array_distinct(F.array_compact(read_names(raw)))
    fingerprint = F.coalesce(F.nullif(leaf.sha256, F.lit("")), F.nullif(leaf.fingerprint, F.lit("")))
    key = F.coalesce(F.concat(F.lit("fp:"), fingerprint), F.concat(F.lit("ix:"), F.col("data.source.url"), F.lit("#"), F.col("data.cert_index").cast("string")))
    at = lambda c: F.timestamp_micros(F.round(c * 1_000_000).cast("long"))
    usable = messages.filter(F.col("_bad").isNull() & (F.col("message_type") == "certificate_update") & leaf.isNotNull())
    out = usable.select(
        key.alias("key"), names.alias("all"), at(F.col("data.seen")).alias("seen"), F.col("data.source.name").alias("source"), leaf.issuer.O.alias("issuer"),
        leaf.serial_number.alias("serial"), at(leaf.not_before).alias("not_before"), at(leaf.not_after).alias("not_after"), F.size(raw).alias("san_count"),
        at(F.col("received")).alias("received"),
    )
    kept = [F.slice("all", 1, MAX_NAMES).alias("names"), F.greatest(F.size("all") - MAX_NAMES, F.lit(0)).alias("overflow")]
    return out.filter(F.size("all") > 0).select("key", *kept, "seen", "source", "issuer", "serial", "not_before", "not_after", "san_count", "received")


def deduplicate(rows: DataFrame, delay: str = "90 minutes") -> DataFrame:
    """One copy of each certificate within the watermark (T01); state is bounded by time."""
    return rows.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["key"]) if rows.isStreaming else rows.dropDuplicates(["key"])


def rates(rows: DataFrame, width: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Certificates and names in tumbling windows."""
    return rows.withWatermark("seen", delay).groupBy(F.window("seen", width)).agg(F.count("*").alias("certs"), F.sum(F.size("names")).alias("names"))


def first_seen(rows: DataFrame) -> DataFrame:
    """First sighting of each name, kept up to date."""
    return rows.select(F.explode("names").alias("name"), "seen").groupBy("name").agg(F.min("seen").alias("first_seen"))


def dead_letters(messages: DataFrame) -> DataFrame:
    """Unreadable lines, cut to 10,000 characters as the sink's record format has it."""
    return messages.filter(F.col("_bad").isNotNull()).select("run", F.left("_bad", F.lit(10_000)).alias("raw"))
