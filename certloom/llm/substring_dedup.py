"""Exact removal of repeated word windows, found through difference-cover anchors.

Positions p of a document with ``p mod 31`` in a perfect difference set are *cover positions*. For any two starts i and
j there is a shift d < 31 that puts both i+d and j+d on cover positions, so two equal windows of 50 words always share
an aligned anchor of 20 words (50 - 31 + 1) there. Only 6 of 31 positions are hashed.

1. *Anchors.* Each task hashes the 20-word anchors of its documents. An anchor met in two documents of the task is
   known to be shared at once; the shuffle gets one row for each anchor and task, so a passage in a third of all
   documents costs a row for each task, not for each document. After the shuffle, anchors of several documents are
   sent to those documents.
2. *Extension.* Only around the periods in which such anchors start, windows of 50 words are hashed in full and settled the same way: within
   the task first, then one row for each window and task by hash. Windows whose first document is an earlier one go.
3. The hashes of the windows to remove meet the document's text, which is rewritten.

Rows name an anchor or window and its document, never a position, so a document that repeats one line a million times
gives as many rows as one that has it once. Shuffled rows come sorted and are read as a stream; a task holds its documents
at hand and the rows of one hash, of which there are as many as tasks. No pairs of documents are formed
anywhere. Two 64-bit hashes of different windows could coincide with probability about n^2 / 2^65.

Defined cases: a null or empty text has no words; a null ``doc_id`` is neither earlier nor later than any other and
keeps all its words; rows that repeat a ``doc_id`` are not earlier than each other, and what is removed from one of them is removed from
all; documents shorter than the window keep everything; very long texts are read whole, one after another; an empty table gives no rows;
further columns pass through untouched (their names may clash with those used inside).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, text_bytes, window_hashes, word_hashes

WINDOW = 50
#: A perfect difference set: its differences modulo PERIOD are all of 1..30, each once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task settles among its own documents before it passes them on; bounds its memory.
BUFFER = 2_000_000

_IS_COVER = np.isin(np.arange(PERIOD), COVER)
#: ``route`` decides the partition: the hash itself for rows that are still to be compared, any other number for those that are settled.
_ROWS = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64())])
_ROWS_DDL = "route long, doc long, hash long"
_FOUND = pa.schema([("doc", pa.int64()), ("hash", pa.int64())])


def _rows(key: np.ndarray, doc: np.ndarray, settled: bool) -> pa.RecordBatch:
    route = key
    if settled:
        route = mix(doc.view(np.uint64), key)
        route = np.where(route == key, ~route, route)
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), pa.array(key.view(np.int64))], schema=_ROWS)


def _in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 200_000):
        yield batch.slice(at, 200_000)


def _groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, doc) in order, whether each is the first of its key, and the smallest and largest document of its key."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    if len(k):
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
        k, d = k[new], d[new]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(k)])
    return k, d, first, np.repeat(d[starts], sizes), np.repeat(d[starts + sizes - 1], sizes)


class _Docs:
    """Word hashes of several documents laid end to end."""

    def __init__(self, ids: list, texts: list[bytes]):
        words, self.sizes = [], []
        for t in texts:
            w = t.split()
            words += w
            self.sizes.append(len(w))
        self.hashes = word_hashes(words)
        sizes = np.array(self.sizes, np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.array(ids, np.int64), sizes)
        self.pos = np.arange(len(words)) - np.repeat(self.starts, sizes)
        self.left = np.repeat(sizes, sizes) - self.pos

    def covered(self) -> np.ndarray:
        """Where an anchor of a document with a whole window starts on a cover position."""
        return _IS_COVER[self.pos % PERIOD] & (self.left >= ANCHOR) & (self.pos + self.left >= WINDOW)

    def windows(self, length: int) -> np.ndarray:
        out = np.zeros(len(self.pos), np.uint64)
        found = window_hashes(self.hashes, length)
        out[: len(found)] = found
        return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def settle():
        k, d, lead, low, high = _groups(*(np.concatenate(x) for x in zip(*held)))
        shared = low != high
        # a shared anchor is known to its documents here; one row goes on to tell the other tasks
        yield from _in_pieces(_rows(k[shared], d[shared], True))
        own = ~shared | lead
        yield from _in_pieces(_rows(k[own], d[own], False))
        held.clear()

    for batch in slices(batches):
        batch = batch.filter(batch.column("doc").is_valid())
        docs = _Docs(batch.column("doc").to_pylist(), text_bytes(batch.column("text")))
        use = docs.covered()
        held.append((docs.windows(ANCHOR)[use], docs.doc[use]))
        if sum(len(x[0]) for x in held) > BUFFER:
            yield from settle()
    if held:
        yield from settle()


def _compared(batches: Iterator[pa.RecordBatch], all_sharers: bool) -> Iterator[pa.RecordBatch]:
    """Of one partition ordered by (hash, document): the settled rows, and those of hashes of several documents, all of them
    or all but the first document's."""

    def found(d, k):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k)], schema=_FOUND)

    k, d = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        route, doc, key = (batch.column(i).to_numpy() for i in range(3))
        done = route != key
        yield found(doc[done], key[done])
        k, d = np.r_[k, key[~done]], np.r_[d, doc[~done]]
        cut = np.searchsorted(k, k[-1]) if len(k) else 0  # the last hash may go on in the next batch
        yield from _chosen(k[:cut], d[:cut], all_sharers, found)
        k, d = k[cut:], d[cut:]
    yield from _chosen(k, d, all_sharers, found)


def _chosen(key: np.ndarray, doc: np.ndarray, all_sharers: bool, found) -> Iterator[pa.RecordBatch]:
    k, d, _, low, high = _groups(key, doc)
    own = low != high if all_sharers else d != low
    if own.any():
        yield found(d[own], k[own])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def settle():
        k, d, _, low, _ = _groups(*(np.concatenate(x) for x in zip(*held)))
        later = d > low
        yield from _in_pieces(_rows(k[later], d[later], True))
        yield from _in_pieces(_rows(k[~later], d[~later], False))
        held.clear()

    for batch in slices(batches):
        batch = batch.filter(batch.column("anchors").is_valid())
        if not batch.num_rows:
            continue
        docs = _Docs(batch.column("doc").to_pylist(), text_bytes(batch.column("text")))
        hashes, use = docs.windows(ANCHOR).view(np.int64), docs.covered()
        marked = np.zeros(len(docs.pos), bool)
        for start, size, anchors in zip(docs.starts, docs.sizes, batch.column("anchors")):
            at = np.flatnonzero(use[start : start + size])
            at = at[np.isin(hashes[start + at], anchors.values.to_numpy())]
            own = np.zeros(size // PERIOD + 2, bool)
            own[at // PERIOD] = True
            own[:-1] |= own[1:]  # a window may start up to 30 words before its anchor
            marked[start : start + size] = np.repeat(own, PERIOD)[:size]
        use = marked & (docs.left >= WINDOW)
        held.append((docs.windows(WINDOW)[use], docs.doc[use]))
        if sum(len(x[0]) for x in held) > BUFFER:
            yield from settle()
    if held:
        yield from settle()


def kept_text(text: bytes, gone: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and which of them stay, given the hashes of the windows to remove."""
    words = text.split()
    keep = np.ones(len(words), bool)
    if gone is not None and len(words) >= WINDOW:
        pos = np.flatnonzero(np.isin(window_hashes(word_hashes(words), WINDOW).view(np.int64), gone))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + WINDOW, -1)
        keep = np.cumsum(edge)[:-1] == 0
    return words, keep


def _rewrite(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, gone, kept, sha = [], [], [], []
        raw = text_bytes(batch.column("text"))
        nulls = batch.column("text").is_null().to_pylist()
        for text, null, windows in zip(raw, nulls, batch.column("windows")):
            words, keep = kept_text(text, windows.values.to_numpy() if windows.is_valid else None)
            some = not keep.all()
            joined = b" ".join([w for w, k in zip(words, keep) if k] if some else words)
            n.append(len(words))
            gone.append(int(len(words) - keep.sum()))
            if with_text:
                kept.append(joined.decode() if some else None if null else text.decode())
            else:
                sha.append(hashlib.sha256(joined).hexdigest())
        own = ["doc", "row"] if with_text else ["doc"]
        more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept if with_text else sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], names=[*own, "n_words", "n_removed", "kept" if with_text else "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Without ``carry``: doc, n_words, n_removed, kept_sha256 (of the kept words joined by one space). With it: doc,
    row (a struct of the carried columns), n_words, n_removed and kept: the new text, or the old one where nothing went."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    compared = lambda rows, all_sharers: rows.repartition(parts, "route").sortWithinPartitions("hash", "doc").mapInArrow(lambda it: _compared(it, all_sharers), "doc long, hash long")
    shared = compared(base.mapInArrow(_anchors, _ROWS_DDL), True).groupBy("doc").agg(F.collect_set("hash").alias("anchors"))
    # A left join, as below, so that Spark shuffles the texts once and reuses that exchange.
    near = base.repartition(parts, "doc").join(shared, "doc", "left").select("doc", "text", "anchors")
    windows = compared(near.mapInArrow(_windows, _ROWS_DDL), False).groupBy("doc").agg(F.collect_set("hash").alias("windows"))
    if carry is None:
        both = base.repartition(parts, "doc").join(windows, "doc", "left").select("doc", "text", "windows")
        return both.mapInArrow(lambda it: _rewrite(it, False), "doc long, n_words long, n_removed long, kept_sha256 string")
    full = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("row"))
    both = full.repartition(parts, "doc").join(windows, "doc", "left").select("doc", "row", "text", "windows")
    ddl = both.schema["row"].dataType.simpleString()
    return both.mapInArrow(lambda it: _rewrite(it, True), f"doc long, row {ddl}, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).withColumnRenamed("doc", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same columns; ``text`` without repeated windows, ``n_chars`` of the new text where it changed.
    Documents that lose nothing keep their text as it is."""
    out = substring_dedup(docs, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept")).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
