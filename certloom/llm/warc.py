"""WARC archives: writing, normalising monolithic gzip files, reading back by offset.

Crawlers often compress a whole archive as one gzip stream, which no reader can enter at a record. The *normaliser*
inflates such a file once, as a stream, cuts it into records, writes each as its own gzip member and puts a sidecar
index of offsets beside the archive. Records are then read by seeking.

Tasks write to new names in the shared folder and tell their files as rows; the rows are written as a table before they
are used, so files of lost or repeated attempts are never read. No file or payload passes through the driver. A task holds
a few rows at a time: ROWS_AT_ONCE when it writes, and when it reads the records since OUT_BYTES of them went on, beside Spark's own batch.

Defined cases: a null payload is empty; of records with equal payloads the one with the smallest page_id (null last, then
any one of repeated rows) is the response and the others revisit it; payloads shorter than ``least`` bytes are
all responses; line breaks and spaces in URLs are percent-encoded and a null URL is left out; a null page_id stays null;
very long payloads are one record each, held whole; other columns are not read, whatever their names; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import SCHEMES, delete, file_system, forget, qualified  # noqa: F401
from .common import materialise, shared_dir, slices

#: Inflated bytes after which a task starts another archive.
ARCHIVE_BYTES = 128 << 20
CHUNK = 1 << 20
ROWS_AT_ONCE, OUT_BYTES = 32, 8 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes | None, size: int, digest: str, name: str, refers_id, refers_name) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_name else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_name:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_name}>")]
        if refers_id is not None:
            fields.append(("Page-Refers-To", str(refers_id)))
    return record(fields, http + (payload or b""))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with its closing line breaks."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the archive ends inside a record ({len(held)} bytes are left)")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    member = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            out = member.decompress(raw, CHUNK)
            if out:
                yield out
            raw = member.unconsumed_tail
            if member.eof:
                raw = member.unused_data
                member = zlib.decompressobj(31)
    if out := member.flush():
        yield out


def normalise_file(source: str, target: str) -> list[dict]:
    """Rewrite one archive with a gzip member for each record, and its sidecar index; the index entries."""
    fs, path = file_system(source)
    out_fs, out_path = file_system(target)
    entries, at = [], 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(out_path, compression=None) as out:
        for raw in records(inflated(stream)):
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = pack.compress(raw) + pack.flush()
            out.write(member)
            fields = dict(x.split(": ", 1) for x in raw[: raw.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
            entries.append({"path": target, "offset": at, "length": len(member), "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"]})
            at += len(member)
    with out_fs.open_output_stream(out_path + ".index.jsonl", compression=None) as side:
        side.write("".join(json.dumps({k: v for k, v in e.items() if k != "path"}) + "\n" for e in entries).encode())
    return entries


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, size, digest, name, refers_id, refers_name) rows as monolithic gzip archives; their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        out = pack = None
        done, size = [], 0
        for batch in slices(batches, ROWS_AT_ONCE):
            for row in batch.to_pylist():
                if out is None:
                    name = f"raw-{uuid.uuid4().hex}.warc.gz"
                    out, pack, size = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    done.append(f"{folder}/{name}")
                    out.write(pack.compress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                row["digest"] = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                raw = page_record(**row)
                out.write(pack.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    return materialise(rows.mapInArrow(run, "path string"), "archives")


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """(path, offset, length, type, id) of every record, after rewriting each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                entries = normalise_file(path, f"{folder}/members-{uuid.uuid4().hex}.warc.gz")
                yield pa.RecordBatch.from_pylist(entries, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string())]))

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(paths.repartition(parts, "path").mapInArrow(run, "path string, offset long, length long, type string, id string"), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Page records read by offset: page_id, url, payload (null for revisits), sizes, digests, type and what they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if opened[0] != row["path"]:
                    if opened[1]:
                        opened[1].close()
                    fs, path = file_system(row["path"])
                    opened = (row["path"], fs.open_input_file(path))
                opened[1].seek(row["offset"])
                fields, block = parse(zlib.decompress(opened[1].read(row["length"]), 31))
                head, _, payload = block.partition(b"\r\n\r\n")
                revisit = fields["WARC-Type"] == "revisit"
                size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if not revisit and size != len(payload):
                    raise ValueError(f"record {fields['WARC-Record-ID']} has {len(payload)} of {size} bytes")
                out.append({
                    "page_id": int(fields["Page-ID"]) if "Page-ID" in fields else None,
                    "url": fields.get("WARC-Target-URI"),
                    "payload": None if revisit else payload,
                    "payload_bytes": size,
                    "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
                    "record_type": fields["WARC-Type"],
                    "refers_to": int(fields["Page-Refers-To"]) if "Page-Refers-To" in fields else None,
                })
                held += 0 if revisit else size
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = index.filter(F.col("type").isin("response", "revisit")).repartition(parts, "path", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("path", "offset")
    return pages.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Archive ``pages``, normalise the archives and read them back (see ``read_records``)."""
    folder = qualified(pages.sparkSession, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "payloads")
    order = F.struct(F.col("page_id").isNull(), "page_id", "row")
    first = materialise(rows.groupBy("sha1").agg(F.min(order).alias("first")), "firsts")
    name = lambda sha, row: F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(F.lpad(F.hex(row), 16, "0"), 1, 4), F.substring(F.lpad(F.hex(row), 16, "0"), 5, 12))
    both = rows.join(first, "sha1")
    again = (F.col("row") != F.col("first.row")) & (F.col("size") >= least)
    out = both.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", F.col("sha1").alias("digest"),
        name(F.col("sha1"), F.col("row")).alias("name"), F.when(again, F.col("first.page_id")).alias("refers_id"), F.when(again, name(F.col("sha1"), F.col("first.row"))).alias("refers_name"),
    )
    # what is written is deleted as soon as what is made of it is written: the payloads, then the monolithic archives
    paths = write_archives(out, f"{folder}/raw")
    forget(rows)
    forget(first)
    index = normalise(paths, folder)
    delete(pages.sparkSession, f"{folder}/raw")
    return read_records(index)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
