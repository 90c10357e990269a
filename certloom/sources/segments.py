"""A stream source over landed segments that keeps its place in bytes.

A recorder appends lines to a segment and goes on to the next one, whose name sorts after it; only the last segment grows. The place of the stream is
the segment and the byte after its last whole line, which Spark keeps in the checkpoint, so a query that was ended goes on with the next line,
reads none twice and leaves out none. A line that is still being written waits until its line break is there, or until a later segment exists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, segment string, at bigint"
#: Bytes of a segment that one task reads, of one read, and lines of one Arrow batch.
TASK_BYTES, READ_BYTES, LINES = 64 << 20, 1 << 20, 4096


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; ``file:`` and plain paths are local, others go by their scheme."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.FileSystem.from_uri(uri)) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(folder: str) -> list[tuple[str, int]]:
    """(name below the folder, bytes) of each segment in order; names with a part that starts with ``_`` or ``.`` are none."""
    system, root = file_system(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = ((f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
    return sorted((n, size) for n, size in names if not any(part[:1] in "_." for part in n.split("/")))


def whole_lines(folder: str, name: str, size: int) -> int:
    """The byte after the last line break of a segment, read backwards from its end; 0 if it has none."""
    system, root = file_system(folder)
    with system.open_input_file(f"{root}/{name}") as file:
        end = size
        while end > 0:
            start = max(0, end - READ_BYTES)
            file.seek(start)
            k = file.read(end - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            end = start
    return 0


@dataclass
class Block(InputPartition):
    """The lines that start in bytes [start, stop) of a segment; the lines of the batch lie in [low, high)."""

    name: str
    start: int
    stop: int
    low: int
    high: int


def lines(folder: str, block: Block) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a block, a read at a time; a line that starts in another block is that one's."""
    system, root = file_system(folder)
    with system.open_input_file(f"{root}/{block.name}") as file:
        at = block.start
        skip = at > block.low
        if skip:  # the line that holds the byte before the block is not its own
            at -= 1
        file.seek(at)
        held, read = b"", at
        while at < block.stop:
            k = held.find(b"\n")
            if k < 0:
                more = file.read(min(READ_BYTES, block.high - read))
                read += len(more)
                if more:
                    # a line longer than a read is put together once its end is there
                    pieces = [held, more]
                    while b"\n" not in more and read < block.high and (more := file.read(min(READ_BYTES, block.high - read))):
                        read += len(more)
                        pieces.append(more)
                    held = b"".join(pieces)
                    continue
                if held and not skip:
                    yield at, held  # the last line of a segment that was closed without a line break
                return
            start = 0
            while k >= 0 and at < block.stop:
                if not skip:
                    yield at, held[start:k]
                skip = False
                at += k + 1 - start
                start = k + 1
                k = held.find(b"\n", start)
            held = held[start:]


class SegmentReader(DataSourceStreamReader):
    def __init__(self, folder: str, task_bytes: int) -> None:
        self.folder, self.task_bytes = folder, task_bytes

    def initialOffset(self) -> dict:
        return {"segment": "", "bytes": 0}

    def latestOffset(self) -> dict:
        segments = listed(self.folder)
        if not segments:
            return self.initialOffset()
        name, size = segments[-1]
        return {"segment": name, "bytes": whole_lines(self.folder, name, size)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Blocks of at most ``task_bytes`` between two places. A segment that the batch needs and that is gone or shorter than it was is an error."""
        sizes = dict(listed(self.folder))
        for place in (start, end):
            if place["bytes"] > sizes.get(place["segment"], 0) and (place is end or place["segment"] in sizes):
                raise ValueError(f"segment {place['segment']} of {self.folder} is gone or was cut")
        blocks = []
        for name in sorted(n for n in sizes if start["segment"] <= n <= end["segment"]):
            low = start["bytes"] if name == start["segment"] else 0
            high = end["bytes"] if name == end["segment"] else sizes[name]
            blocks += [Block(name, b, min(b + self.task_bytes, high), low, high) for b in range(low, high, self.task_bytes)]
        return blocks

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        texts, places = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([partition.name] * len(texts), pa.string()), pa.array(places, pa.int64())], ["value", "segment", "at"])

        held = 0
        for at, line in lines(self.folder, partition):
            texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            places.append(at)
            held += len(line)
            if len(texts) == LINES or held >= READ_BYTES * 8:
                yield batch()
                texts, places, held = [], [], 0
        if texts:
            yield batch()


class Segments(DataSource):
    """``spark.readStream.format("segments").option("path", folder)``: (value, segment, at), a row for each line, blank ones too. ``task_bytes`` is an option.
    Bytes that are no UTF-8 are replaced."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentReader:
        return SegmentReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def read_segments(spark, folder: str, **options):
    """A stream of the lines of a folder of segments. All that has landed is one micro-batch of many tasks; under ``availableNow`` Spark runs one batch
    at a time of such a source, so a run after an ended one finishes that one's batch and leaves newer lines to the next run."""
    spark.dataSource.register(Segments)
    return spark.readStream.format("segments").option("path", folder).options(**options).load()
