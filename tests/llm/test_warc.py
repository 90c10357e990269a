import base64
import gzip
import hashlib
import json

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from certloom.llm import warc


def brute(rows):
    first, out, taken = {}, [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        p = (h or "").encode()
        new = first[h or ""] == i and (h or "") not in taken
        if new:
            taken.add(h or "")
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if new else "revisit", None if new else first[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(5, "http://a/ b\r\nX: y", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, None), (2, "v", ""), (7, "w", "x" * 3_000_000), (8, "w", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (3, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "only"), (11, "a", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("x")).repartition(3)
    got = warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted({(h or "").encode() for _, _, h in rows})
    assert warc.archive(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive(df.filter("page_id in (2, 9)"), least=1).collect()} == {"response"}


def test_normaliser_members_and_index(tmp_path):
    raw = [warc.page_record(i, "u", b"p" * i, i, "D", f"n{i}", None, None) for i in range(50)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(raw[:30])) + gzip.compress(b"".join(raw[30:])))
    entries = warc.normalise_file(str(tmp_path / "a.gz"), str(tmp_path / "b.gz"))
    data = (tmp_path / "b.gz").read_bytes()
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries] == raw
    assert gzip.decompress(data) == b"".join(raw)
    assert [json.loads(x)["offset"] for x in (tmp_path / "b.gz.index.jsonl").read_text().splitlines()] == [e["offset"] for e in entries]


def test_folders_are_resolved_as_spark_does(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert warc.qualified(spark, f"{tmp_path}/x") == f"file:{tmp_path}/x" and warc.qualified(spark, f"file://{tmp_path}") == f"file:{tmp_path}"
    conf.set("fs.defaultFS", "viewfs://c/")
    conf.set("fs.viewfs.mounttable.c.link./data", f"file://{tmp_path}")
    try:
        assert warc.qualified(spark, "/data/x") == "viewfs://c/data/x"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(pa.ArrowInvalid):
        warc.file_system("nosuch://c/data/x")


def test_object_store_schemes():
    for scheme in ("s3a", "s3"):
        fs, path = warc.file_system(f"{scheme}://k:p@bucket/a/b?region=eu-west-1")
        assert isinstance(fs, pyarrow.fs.S3FileSystem) and path == "bucket/a/b"
    assert warc.file_system("file:/a/b")[1] == warc.file_system("file:///a/b")[1] == "/a/b"


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.op4_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
