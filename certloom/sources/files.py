"""File sources and sinks beside the message stream: feeds, ranked lists, counters, recorder logs, mail, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import file_system, qualified
from ..tables import dealt

#: The counter line, the recorder's stamp, the share of an hour a clock may run back without a new day.
COUNTER = r'certs_by_log_total\{url="([^"]+)",operator="([^"]+)"\} (\d+)'
STAMP = r"^\[(\d\d):(\d\d)\] (.*)$"
BACK_MINUTES = 60


def host_of(url):
    """Host of a URL in lower case; null where there is none."""
    return F.nullif(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), F.lit(""))


def read_feed(spark: SparkSession, path: str, since) -> DataFrame:
    """Reports of a CSV feed (url, submission_time, target) not older than ``since``; rows without a host or a valid time are skipped."""
    seen = F.try_to_timestamp("submission_time")
    rows = spark.read.option("header", True).csv(path).select(host_of(F.col("url")).alias("host"), seen.alias("seen"), F.coalesce("target", F.lit("")).alias("target"))
    return rows.filter(F.col("host").isNotNull() & (F.col("seen") >= F.lit(since)))


def read_urls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One URL a line, with the time its file was written (S10); lines without a host are skipped."""
    reader = spark.readStream if stream else spark.read
    rows = reader.text(path).select(F.trim("value").alias("url"), host_of(F.col("value")).alias("host"), F.col("_metadata.file_modification_time").alias("seen"))
    return rows.filter(F.col("host").isNotNull())


def first_listed(listings: DataFrame) -> DataFrame:
    """When each URL was first listed, over any number of feed snapshots (T16); on a stream, kept up to date."""
    return listings.groupBy("url", "host").agg(F.min("seen").alias("first_listed"))


def read_ranked(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(rank, domain) of a ranked list, names trimmed and in lower case (S11); ``most`` keeps the ranks up to it."""
    rows = spark.read.schema("rank long, domain string").csv(path).select("rank", F.lower(F.trim("domain")).alias("domain"))
    rows = rows.filter(F.col("domain").isNotNull())
    return rows.filter(F.col("rank") <= most) if most else rows


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, url, operator, n) of metric text files (S12); URLs without final slashes."""
    part = lambda k: F.regexp_extract("value", COUNTER, k)
    rows = spark.read.text(path).filter(F.col("value").rlike(COUNTER))
    return rows.select(F.col("_metadata.file_path").alias("snapshot"), F.regexp_replace(part(1), "/+$", "").alias("url"), part(2).alias("operator"), part(3).cast("long").alias("n"))


#: Causes of service errors in order of precedence, and the words that tell them.
SERVICE_CAUSES = {
    "connection closed by the server (EOF)": ("unexpected EOF",),
    "timeout": ("Client.Timeout", "context deadline exceeded", "i/o timeout", "TLS handshake timeout"),
    "DNS failure": ("no such host",),
    "connection reset or refused": ("connection reset", "connection refused"),
    "HTTP error status": (),
}


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    """(operator, cause) of each error line of service logs (S13, C34): the last two labels of the log's host and the first cause that the
    line tells, ``other`` if it tells none. A final EOF closes a connection; a status code, or 429 or 5xx standing alone, is an HTTP error."""
    value = F.col("value")
    host = F.lower(F.regexp_extract(value, r"Error processing [^\n]*? for 'https?://([^/']+)", 1))
    also = {"connection closed by the server (EOF)": value.rlike(r":\s*EOF\s*$"), "HTTP error status": value.rlike(r"status code [0-9]|(?<!\w)(?:429|5[0-9]{2})(?!\w)")}
    told = F.lit("other")
    for cause, words in reversed(SERVICE_CAUSES.items()):
        hit = also.get(cause, F.lit(False))
        for w in words:
            hit = hit | value.contains(w)
        told = F.when(hit, cause).otherwise(told)
    return spark.read.text(path).filter(host != "").select(F.substring_index(host, ".", -2).alias("operator"), told.alias("cause"))


def log_times(lines: DataFrame) -> DataFrame:
    """(log, line, at, kind) of recorder lines (log, line, day0, value): ``at`` counts days where the clock wraps.

    One log file is one window; its stamped lines are few against its bytes. ``kind`` is poll, stats or other.
    Lines without a stamp give reconnect and poll_failed rows with a null time; other lines give none."""
    hour, minute, rest = (F.regexp_extract("value", STAMP, k) for k in (1, 2, 3))
    stamped = lines.filter(F.col("value").rlike(STAMP)).withColumn("minutes", hour.cast("int") * 60 + minute.cast("int"))
    order = Window.partitionBy("log").orderBy("line")
    wrapped = (F.col("minutes") < F.lag("minutes").over(order) - BACK_MINUTES).cast("int")
    stamped = stamped.withColumn("wrapped", F.coalesce(wrapped, F.lit(0)))
    days = F.sum("wrapped").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.unix_date("day0").cast("long") * 86_400 + days * 86_400 + F.col("minutes") * 60
    kind = F.when(rest.contains("openphish:"), "poll").when(rest.startswith("{"), "stats").otherwise("other")
    loose = F.when(F.col("value").startswith("reconnecting after"), "reconnect").when(F.col("value").startswith("openphish poll failed"), "poll_failed")
    bare = lines.filter(~F.col("value").rlike(STAMP)).select("log", "line", F.lit(None).cast("long").alias("at"), loose.alias("kind")).filter("kind is not null")
    return stamped.select("log", "line", at.cast("long").alias("at"), kind.alias("kind")).unionByName(bare)


#: Mails that a task reads or writes between two batches, and those that one task reads.
MAILS_AT_ONCE, MAILS_A_TASK = 256, 2_000


def write_mails(mails: DataFrame, folder: str) -> None:
    """Write each of (file, raw) as a file of that name, in a folder for each task. A task that is tried again replaces its files."""
    base = qualified(mails.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(base)
        own, n = f"{path}/part-{TaskContext.get().partitionId():05d}", 0
        fs.create_dir(own, recursive=True)
        for batch in batches:
            for file, raw in zip(batch.column("file").to_pylist(), batch.column("raw").cast(pa.binary()).to_pylist()):
                with fs.open_output_stream(f"{own}/{file}", compression=None) as out:
                    out.write(raw or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    mails.select("file", "raw").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _listed(batches: Iterator[pa.RecordBatch], base: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """(path, folder) of what is in a folder (of all below it, if ``deep``); hidden names and those that Spark writes for itself are left out."""
    fs, _ = file_system(base)
    for batch in batches:
        for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
            found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=deep)) if folder else fs.get_file_info([path])
            seen = [(i.path, i.type == pyarrow.fs.FileType.Directory) for i in found if not i.path[len(path) :].lstrip("/").startswith(("_", ".")) and "/_" not in i.path[len(path) :] and "/." not in i.path[len(path) :]]
            for at in range(0, len(seen), 10_000):
                part = seen[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], names=["path", "folder"])


def read_mails(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Mails of a folder with the labels of their file names (S18); a label row is (file, label). Where mails were written by Spark, each in a folder
    ``file=<name>``, that names them. A mail without a label is left out, and its file is not opened. Folders are listed by tasks, those in the given one each by its own."""
    base = qualified(spark, path)
    top = file_system(base)[1]
    first = spark.createDataFrame([(top, True)], "path string, folder boolean").mapInArrow(lambda it: _listed(it, base, False), "path string, folder boolean")
    below = first.repartition("path").mapInArrow(lambda it: _listed(it, base, True), "path string, folder boolean").filter("not folder")
    last = F.element_at(F.split("path", "/"), -1)
    name = F.coalesce(F.nullif(F.regexp_extract("path", "/file=([^/]+)/[^/]+$", 1), F.lit("")), last)
    named = below.select("path", name.alias("file")).join(labels, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(base)
        for batch in batches:
            for at in range(0, batch.num_rows, MAILS_AT_ONCE):
                part, read = batch.slice(at, MAILS_AT_ONCE), []
                for p in part.column("path").to_pylist():
                    with fs.open_input_stream(p, compression=None) as source:
                        read.append(source.read().decode("utf-8", "replace"))
                columns = [c for c in part.schema.names if c != "path"]
                yield pa.RecordBatch.from_arrays([*map(part.column, columns), pa.array(read, pa.string())], names=[*columns, "raw"])

    kept = [c for c in named.columns if c != "path"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name in kept)
    return dealt(named, "path", rows=MAILS_A_TASK).mapInArrow(run, schema + ", raw string").select("file", "raw", *[c for c in kept if c != "file"])


def export(df: DataFrame, path: str) -> int:
    """Write gzip CSV with a header; returns the number of rows written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("header", True).option("compression", "gzip").csv(path)
    return seen.get["rows"]
