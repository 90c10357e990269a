"""Packing of token sequences: exact-complement hashing, then best fit.

Only how many pieces there are of each length (1 to 1023) decides a packing, so the plan is made from that histogram:
at most 1024 numbers, whatever the corpus. For the longest length left, the gap to 1024 is looked up among the sums of
one, two and three lengths still available; the combination found is consumed as often as its counts allow, which
exhausts one of its lengths each time. Lengths without an exact complement go by best fit, again in bulk. The pieces then
look up their places: the rank of a piece among those of its length falls in one interval of the plan. Ranks come from
counts by length and hash bucket, so that a length that a third of all pieces share is spread over many tasks.

Tokens: byte-level BPE of the file ``byte_bpe_50k.json``, computed from its rank form with the same merges, and
the end-of-text string treated as the tokenizer itself treats it. A document is its ids and then id 2.

Defined cases: null text counts as empty (one piece of one token); repeated rows are packed each; a null id is kept;
very long texts are cut into full pieces; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, materialise, slices
from .tokenizers_path import vocabulary

CAPACITY = 1024
END_ID = 2
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Buckets that the pieces of one length are spread over when they are numbered.
BUCKETS = 512


class ByteBpe:
    """Byte-level BPE with remembered words. The splitting pattern never joins a space or newline to what stands before
    it, so texts without other white space or runs of it are cut before each single space and around each newline."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.words = Memo(lambda w: np.array(self.library.encode_ordinary(w), "<u4").tobytes())
        self.odd = re.compile(r"\s\s|[^\S \n]")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if SPECIAL in text or self.odd.search(text):
            return np.array(self.library.encode(text, allowed_special="all"), "<u4").tobytes()
        parts: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                parts += self.words.map(["\n"])
            if line:
                first, *rest = line.split(" ")
                parts += self.words.map(([first] if first else []) + [" " + w for w in rest])
        return b"".join(parts)


@cache
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences), using every counted piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for s in combo:
            need[s] = need.get(s, 0) + 1
        times = min(int(left[s]) // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        out.append((combo, times))

    if left[capacity]:
        take((capacity,))

    def complement(size: int) -> tuple[int, ...] | None:
        gap = capacity - size
        free = left.copy()
        free[size] -= 1
        if gap <= size and free[gap] > 0:
            return (gap,)

        def pair(total: int, most: int) -> tuple[int, int] | None:
            a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
            if not len(a):
                return None
            b = total - a
            n = np.where(a == b, free[a] // 2, np.minimum(free[a], free[b]))
            k = int(n.argmax())
            return (int(a[k]), int(b[k])) if n[k] > 0 else None

        if found := pair(gap, size):
            return found
        best, most = None, 0
        for a in range(min(gap - 2, size), (gap + 2) // 3 - 1, -1):
            if free[a] > 0:
                free[a] -= 1
                found = pair(gap - a, a)
                free[a] += 1
                if found:
                    n = min(int(free[s]) // (a, *found).count(s) for s in (a, *found))
                    if n > most:
                        best, most = (a, *found), n
                        break
        return best

    rest = []
    for size in range(capacity - 1, 0, -1):
        while left[size] > 0:
            found = complement(size)
            if found is None:
                rest.append((size, int(left[size])))
                left[size] = 0
            else:
                take((size, *found))
    open_bins: dict[int, list[list]] = {}  # room left: [lengths, how many]
    for size, n in rest:
        while n:
            room = next((r for r in range(size, capacity) if open_bins.get(r)), None)
            if room is None:
                each = min(capacity // size, n)
                bins = n // each
                open_bins.setdefault(capacity - each * size, []).append([(size,) * each, bins])
                n -= each * bins
                continue
            combo, bins = open_bins[room].pop()
            each = min(room // size, n)
            used = min(bins, n // each)
            if used < bins:
                open_bins[room].append([combo, bins - used])
            open_bins.setdefault(room - each * size, []).append([combo + (size,) * each, used])
            n -= each * used
    out += [(combo, n) for bins in open_bins.values() for combo, n in bins]
    return out


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank, in which sequence and at which offset its pieces go; a few thousand entries at most."""
    after: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for combo, n in packed:
        offset = 0
        for size in combo:
            start = after.get(size, 0)
            rows.setdefault(size, []).append((start, base, offset))
            after[size] = start + n
            offset += size
        base += n
    return {size: tuple(np.array(x, np.int64) for x in zip(*r)) for size, r in rows.items()}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    path = path or vocabulary(RANKS)
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            doc, out = [], ([], [], [], [])
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = enc.encode(text or "") + end
                total = len(ids) // 4
                first = total % capacity or min(total, capacity)
                cuts = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(k)
                    for column, x in zip(out, (piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``."""
    names = [F.col(f"`{c}`") for c in pieces.columns]
    kept = materialise(pieces.select(F.struct(*names).alias("row"), F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int").alias("bucket")), "pieces")
    counts = kept.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "bucket", "before")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = intervals(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                mine = length == size
                start, base, at = places[int(size)]
                k = np.searchsorted(start, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + rank[mine] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    own = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = kept.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).select("row", "length", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    ddl = ranked.schema["row"].dataType.simpleString()
    return ranked.mapInArrow(place, f"row {ddl}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their sequences."""
    return pack(token_pieces(docs))
