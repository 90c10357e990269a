"""Timers fire when event time passes them, although their own key is not heard of again."""

import json

import pytest
from pyspark.sql import functions as F

from certloom.streaming import timers as T

MINUTE = 60_000_000


@pytest.fixture
def run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def turn(k, rows, schema, stream_of):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(schema).json(str(folder)).withColumn("time", F.timestamp_micros("at"))
        got = []
        stream_of(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in got]

    with T.state_store(spark):
        yield turn


def test_due_rechecks(run):
    turn = lambda k, rows: run(k, [{"key": a, "at": t * MINUTE, "ok": ok} for a, t, ok in rows], "key string, at long, ok boolean", T.due_rechecks)
    at = lambda m: m and m * MINUTE
    # each turn is a new query from the checkpoint: state and timers outlive a restart
    assert sorted(turn(0, [("a", 100, False), ("b", 100, True)])) == [("a", 1, at(105), "waiting"), ("b", 0, None, "done")]
    assert turn(1, [("c", 104, False)]) == [("c", 1, at(109), "waiting")]
    # time passes by another key: a is due by itself, c is not yet
    assert sorted(turn(2, [("d", 106, True)])) == [("a", 1, at(105), "due"), ("d", 0, None, "done")]
    # c fails before it is due: its timer moves up the ladder and the old one never fires
    assert turn(3, [("c", 107, False)]) == [("c", 2, at(122), "waiting")]
    assert sorted(turn(4, [("d", 121, True)])) == [("d", 0, None, "done")]
    assert sorted(turn(5, [("d", 123, True)])) == [("c", 2, at(122), "due"), ("d", 0, None, "done")]
    # success clears the timer
    assert turn(6, [("a", 124, True)]) == [("a", 0, None, "done")]
    assert turn(7, [("d", 5000, True)]) == [("d", 0, None, "done")]


def test_silent_sources(run):
    second = 1_000_000
    turn = lambda k, rows: sorted(run(k, [{"source": a, "at": t * second} for a, t in rows], "source string, at long", T.silent_sources))
    assert turn(0, [("x", 100), ("y", 100), ("x", 101)]) == [("x", 101 * second, "up"), ("y", 100 * second, "up")]
    assert turn(1, [("y", 110)]) == []
    assert turn(2, [("y", 117)]) == [("x", 101 * second, "down")]
    assert turn(3, [("x", 130)]) == [("x", 130 * second, "up")]
    assert turn(4, [("x", 133)]) == [("y", 117 * second, "down")]
