import gzip
import json

from pyspark.sql import functions as F

from certloom.operators.evidence import merkle_roots
from certloom.operators.names import normalise_name
from certloom.operators.relational import keyset_page
from certloom.streaming import stream as S


def message(i, seen, names, sha=None, kind="certificate_update"):
    return json.dumps({"message_type": kind, "data": {"seen": seen, "cert_index": i, "source": {"name": "log", "url": "u"}, "leaf_cert": {"sha256": sha or "", "all_domains": names, "issuer": {"O": "CA"}}}})


def capture(folder):
    lines = [message(1, 1000.0, ["A.example", "a.example", "b.example"], "x"), "{torn", message(2, 1001.0, ["a.example"], "x"), message(7, 1002.5, ["c.example"]), message(9, 1003.0, [], "y"), message(10, 1004.0, ["d.example"], "z", "heartbeat")]
    (folder / "a.json").write_text("\n".join(lines[:3]))
    (folder / "b.json.gz").write_bytes(gzip.compress("\n".join(lines[3:]).encode()))
    return str(folder)


def test_batch_and_stream_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = capture(tmp_path / "in")
    batch = S.records(S.read_messages(spark, path))
    assert sorted(r.key for r in S.deduplicate(batch).collect()) == ["fp:x", "ix:u#7"]
    assert batch.filter("key = 'fp:x'").orderBy("seen").first().names == ["a.example", "b.example"]
    assert S.dead_letters(S.read_messages(spark, path).cache()).count() == 1
    stream = S.deduplicate(S.records(S.read_messages(spark, path, stream=True)))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["fp:x", "ix:u#7"]
    seen = {r.name: r.first_seen for r in S.first_seen(batch).collect()}
    assert set(seen) == {"a.example", "b.example", "c.example"}
    assert sum(r.certs for r in S.rates(batch).collect()) == 3


def test_records_of_odd_messages(spark, tmp_path):
    whole = message(1, 1000.000001, [" *.B.example. ", "localhost", "10.0.0.1", None, "b.example", *[f"n{i}.example" for i in range(230)]])
    other = json.loads(message(2, 1001.0, ["c.example"]))
    other["data"]["leaf_cert"] |= {"fingerprint": "f", "serial_number": "07", "not_before": 5.5}
    lines = [whole, json.dumps(other), message(3, 1002.0, ["d.example"], "x")[:-1], "", "[]", message(4, 1003.0, ["localhost"], "y"), message(5, 1004.0, None, "z"), '{"message_type": "certificate_update"}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = {r.key: r for r in S.records(S.read_messages(spark, str(tmp_path))).select("*", F.unix_micros("seen").alias("us")).collect()}
    assert set(rows) == {"ix:u#1", "fp:f"}
    first, second = rows["ix:u#1"], rows["fp:f"]
    assert (first.names[:2], len(first.names), first.overflow, first.san_count, first.us) == (["b.example", "n0.example"], 200, 31, 235, 1_000_000_001)
    assert (second.serial, second.not_before.microsecond, second.not_after, second.names) == ("07", 500_000, None, ["c.example"])
    assert S.dead_letters(S.read_messages(spark, str(tmp_path))).count() >= 1


def test_names(spark):
    rows = spark.createDataFrame([("*.A.Example.com.",), ("",), ("10.0.0.1",), ("2001:db8::1",), ("localhost",)], "raw string")
    assert [r[0] for r in rows.select(normalise_name(F.col("raw"))).collect()] == ["a.example.com", None, None, None, None]


def test_merkle_levels(spark):
    import hashlib

    leaves = [(b, f"n{i}", hashlib.sha256(bytes([i])).hexdigest()) for b, n in (("five", 5), ("one", 1)) for i in range(n)]

    def root(items):
        level = [hashlib.sha256(b"\0" + n.encode() + b"\0" + bytes.fromhex(s)).digest() for _, n, s in sorted(items)]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0].hex()

    got = {r.b: r.root for r in merkle_roots(spark.createDataFrame(leaves, "b string, name string, sha string"), "b", "name", "sha").collect()}
    assert got == {b: root([x for x in leaves if x[0] == b]) for b in ("five", "one")}


def test_pages_give_each_row_once(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(23)], "a long, b long")
    cursor, seen = None, []
    while True:
        page = keyset_page(rows, ["a", "b"], cursor, 4).collect()
        seen += [tuple(r) for r in page[:4]]
        if len(page) <= 4:
            break
        cursor = tuple(page[3])
    assert seen == sorted({(i % 5, i) for i in range(23)}, reverse=True)
