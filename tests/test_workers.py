"""Streaming jobs over small captures."""

import json

from pyspark.sql import functions as F

from certloom.streaming import stream as S
from certloom.streaming import workers as W

from .test_streaming import capture


def test_capture_scoring_and_fixture(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = capture(tmp_path / "in")
    W.write_capture(S.read_messages(spark, path, stream=True), str(tmp_path / "raw"), str(tmp_path / "c1")).awaitTermination()
    raw = S.read_messages(spark, str(tmp_path / "raw"))
    assert raw.count() == 4 and {r.message_type for r in raw.collect()} == {"certificate_update"}
    score = lambda names: names.select("name", F.length("name").cast("double").alias("score"), F.col("name").startswith("b").alias("candidate"))
    for _ in range(2):  # a second run finds nothing new and publishes nothing again
        W.score_batches(S.records(S.read_messages(spark, path, stream=True)), score, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out/candidates")).collect()] == ["b.example"]
    assert spark.read.parquet(str(tmp_path / "out/feed")).count() == 4
    rows = W.with_received(S.records(S.read_messages(spark, path)))
    assert all(r.delay_us > 0 for r in rows.collect())
    counts = W.write_fixture(S.records(S.read_messages(spark, path)), str(tmp_path / "fixture")).collect()
    assert [tuple(r) for r in counts] == [("log", 3, 2)]


def test_delays_of_messages_seen_at_one_time(spark, tmp_path):
    """Copies of events with other keys and values have the times of the first ones."""
    import duckdb

    from certloom import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 1000, "value": F.col("value") + 7.25})
    events.union(copies).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select source, n, least_us, most_us from ({catalog.ORACLES['t04_delays']})").fetchall()
    got = catalog.QUERIES["t04_delays"](spark, str(tmp_path)).select("source", "n", "least_us", "most_us").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rechecks_climb_the_ladder(spark, tmp_path):
    folder = tmp_path / "attempts"
    folder.mkdir()
    minute = 60_000_000

    def turn(k, rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"key": a, "at": t * minute, "ok": ok}) for a, t, ok in rows))
        stream = spark.readStream.schema("key string, at long, ok boolean").json(str(folder))
        out = tmp_path / f"out{k}"
        got = []
        query = W.rechecks(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.key: (r.tries, r.due and r.due // minute, r.state) for r in got}

    assert turn(0, [("a", 0, False), ("b", 0, True)]) == {"a": (1, 5, "waiting"), "b": (0, None, "done")}
    assert turn(1, [("a", 5, False), ("a", 20, False), ("b", 9, False)]) == {"a": (3, 80, "waiting"), "b": (1, 14, "waiting")}
    assert turn(2, [("a", 80, True), ("b", 14, False), *[("b", 20 + k, False) for k in range(5)]]) == {"a": (0, None, "done"), "b": (6, None, "given up")}


def test_routing_and_headers(spark):
    c = spark.createDataFrame([("x.top", "A"), ("y.top", "B"), ("z.top", None)], "name string, brand string")
    sectors = spark.createDataFrame([("A", "bank"), ("B", "shop")], "brand string, sector string")
    orgs = spark.createDataFrame([("o1", "bank", True, 5), ("o2", "bank", True, 3), ("o0", "bank", False, 1)], "organisation string, sector string, active boolean, created int")
    assert {r.name: r.organisation for r in W.routed(c, sectors, orgs).collect()} == {"x.top": "o2", "y.top": None, "z.top": None}
    spark.udtf.register("message_headers", W.MessageHeaders)
    spark.createDataFrame([(1, "From: a@b.c\nSubject: x\n  y\n\nbody: no"), (2, None)], "id int, raw string").createOrReplaceTempView("mails")
    rows = spark.sql("SELECT id, h.* FROM mails, LATERAL message_headers(raw) h").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "From", "a@b.c"), (1, 1, "Subject", "x y")]
