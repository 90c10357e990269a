"""The source over landed segments: each line once, through restarts, growing and torn segments and any size of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from certloom.sources import segments as S


def every(folder, reader, start, end):
    got = []
    for block in reader.partitions(start, end):
        for batch in reader.read(block):
            got += [(n, a, v) for v, n, a in zip(*(batch.column(k).to_pylist() for k in range(3)))]
    return got


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_blocks_of_any_size(tmp_path, monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(S, "READ_BYTES", 5)
    want = []
    for k in range(3):
        texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 0, 1, 4, 30]))) for _ in range(40)]
        body = "\n".join(texts).encode() + (b"\n" if k != 1 else b"")
        if k == 1 and not texts[-1]:
            texts.pop()
        (tmp_path / f"{k:03d}.txt").write_bytes(body)
        at = 0
        for t in texts:
            want.append((f"{k:03d}.txt", at, t))
            at += len(t.encode()) + 1
    (tmp_path / "_hidden").write_text("x\n")
    (tmp_path / "003.txt").write_text("whole\ntorn")
    reader = S.SegmentReader(str(tmp_path), size)
    end = reader.latestOffset()
    assert end == {"segment": "003.txt", "bytes": 6}
    got = every(tmp_path, reader, reader.initialOffset(), end)
    assert got == [*want, ("003.txt", 0, "whole")]
    # the torn line goes on, then a later segment closes the last one without a line break
    (tmp_path / "003.txt").write_text("whole\ntorn no more\nend")
    (tmp_path / "004.txt").write_text("")
    later = reader.latestOffset()
    assert every(tmp_path, reader, end, later) == [("003.txt", 6, "torn no more"), ("003.txt", 19, "end")]
    assert every(tmp_path, reader, later, later) == []


def test_missing_segments(tmp_path):
    reader = S.SegmentReader(str(tmp_path / "none"), 10)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions({"segment": "", "bytes": 0}, reader.latestOffset()) == []
    (tmp_path / "b").write_text("x\n")
    reader = S.SegmentReader(str(tmp_path), 10)
    with pytest.raises(ValueError):
        reader.partitions(reader.initialOffset(), {"segment": "b", "bytes": 9})
    with pytest.raises(ValueError):
        reader.partitions({"segment": "b", "bytes": 5}, {"segment": "b", "bytes": 2})
    # read segments may be deleted
    assert reader.partitions({"segment": "a", "bytes": 4}, {"segment": "b", "bytes": 2})


def test_ended_queries_go_on(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def rows():
        return sorted(r.value for r in spark.read.schema(S.SCHEMA).parquet(out).collect())

    def run(fail=False):
        stream = S.read_segments(spark, str(folder), task_bytes=64)
        if fail:
            stream = stream.withColumn("value", F.when(F.col("value") == "line 57", F.raise_error(F.lit("ended"))).otherwise(F.col("value")))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    text = lambda a, b: "".join(f"line {i}\n" for i in range(a, b))
    (folder / "000").write_text(text(0, 30))
    run()
    (folder / "000").write_text(text(0, 40) + "line 4")  # the segment grows and is torn
    run()
    assert rows() == sorted(f"line {i}" for i in range(40))
    (folder / "000").write_text(text(0, 50))
    (folder / "001").write_text(text(50, 70))
    with pytest.raises(Exception, match="ended"):
        run(fail=True)  # dies in the middle of a batch
    (folder / "002").write_text(text(70, 80) + "�\n\n")
    run()  # the batch that was ended, with the bounds it had
    assert rows() == sorted(f"line {i}" for i in range(70))
    run()
    assert rows() == sorted([f"line {i}" for i in range(80)] + ["", "�"])
