"""Packing that keeps the order of documents: dynamic programming over window cuts.

Each task lays the documents of its partition end to end, in the order in which it reads them, in runs of about a million
tokens. A run is cut into sequences of at most 1024 tokens. Cuts may fall at the end of a document (free), at the end of a
sentence (``SENTENCE_CUT``), or, inside stretches of over ``LONG`` tokens without either, at the end of a full window
(``HARD_CUT``). The cheapest cuts are found over the ordered cut positions p:

    best[j] = cut[j] + min( 1024 - p[j] + min over i, p[j] - 1024 <= p[i] < p[j], of (best[i] + p[i]),    padded to 1024
                            min over i, p[j] - p[i] a power of two, of best[i] )                          not padded

The inner minimum comes from a monotone queue (each position enters and leaves it once); the second one has at most eleven
candidates, looked up by position. Work is linear in the tokens, nothing is shuffled, and a lost task is simply run again:
sequences never span tasks, and their numbers hold the task's.

Tokens: byte-level BPE of ``byte_bpe_50k.json`` as in ``packing``, then id 0. A sentence ends after a token whose last byte is one of
``.!?`` if the next token begins with white space.

Defined cases: null text counts as empty (one token); repeated rows are packed each; a null id is kept; a very long text is
a run of its own and is cut as often as needed; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .packing import RANKS, SPECIAL, SPECIAL_ID, ByteBpe
from .tokenizers_path import vocabulary

CAPACITY = 1024
END_ID = 0
#: Tokens that the documents of one run have together, at least; bounds a task's memory.
RUN_TOKENS = 1 << 20
#: Penalties of a cut, in tokens of padding.
SENTENCE_CUT, HARD_CUT = 1, 8
#: A stretch without any end of a sentence that is longer than this may be cut anywhere.
LONG = 64


#: A private-use character, put where words are cut; texts that hold it go to the library whole.
MARK = "\ue000"
#: White space of ASCII texts that is not a single space or line break.
ODD_ASCII = (*(a + b for a in " \n" for b in " \n"), *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")


class Words(dict):
    """Ids of each word met; emptied when full."""

    def __init__(self, encode, limit: int = 600_000):
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        self[word] = out = array("I", self.encode(word)).tobytes()
        return out


class MarkedBpe(ByteBpe):
    """The same ids; a text is cut into words by one replacement and each word is looked up once."""

    def __init__(self, path: str):
        super().__init__(path)
        self.known = Words(self.library.encode_ordinary)

    def plain(self, text: str) -> bool:
        """Whether a text's white space is single spaces and line breaks only; most ASCII texts are told by substrings alone."""
        return not any(x in text for x in ODD_ASCII) if text.isascii() else not self.odd.search(text)

    def encode(self, text: str) -> bytes:
        if MARK in text or SPECIAL in text or not self.plain(text):
            return np.array(self.library.encode(text, allowed_special="all"), "<u4").tobytes()
        if not text:
            return b""
        marked = text.replace("\n", f"{MARK}\n{MARK}").replace(" ", MARK + " ").replace(MARK + MARK, MARK)
        return b"".join(map(self.known.__getitem__, marked.strip(MARK).split(MARK)))


@cache
def encoder(path: str) -> MarkedBpe:
    return MarkedBpe(path)


@cache
def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id: whether it ends like a sentence, and whether it begins with white space."""
    ends, opens = np.zeros(SPECIAL_ID + 1, bool), np.zeros(SPECIAL_ID + 1, bool)
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            token = base64.b64decode(token)
            ends[int(rank)], opens[int(rank)] = token[-1:] in b".!?", token[:1].isspace()
    return ends, opens


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, tables, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of all places where the run may be cut, its start and end included."""
    ends, opens = tables
    soft = np.zeros(len(ids) + 1, bool)
    soft[1:-1] = ends[ids[:-1]] & opens[ids[1:]]
    soft[0] = True
    soft[doc_ends] = True
    known = np.flatnonzero(soft)
    gaps = np.diff(known)
    hard, new = [], known
    while len(new):  # full windows that end inside a long stretch, and those that follow on them
        new = new[new + capacity < len(ids)] + capacity
        k = np.searchsorted(known, new)
        new = new[(known[k] != new) & (gaps[k - 1] > LONG)]
        hard.append(new)
    cost = np.full(len(ids) + 1, HARD_CUT)
    cost[known] = SENTENCE_CUT
    cost[0] = 0
    cost[doc_ends] = 0
    at = np.unique(np.concatenate([known, *hard]))
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> tuple[list[int], int]:
    """(positions of the cheapest cuts, what they cost), given the positions where a cut may fall and its penalty there."""
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(n)
    to, come = [], []
    size = 1
    while size <= capacity:
        j = np.searchsorted(at, size)
        source = index[at[j:] - size]
        to.append(np.flatnonzero(source >= 0) + j)
        come.append(source[source >= 0])
        size *= 2
    to, come = np.concatenate(to), np.concatenate(come)
    order = np.argsort(to, kind="stable")
    come, first = come[order].tolist(), np.searchsorted(to[order], np.arange(n + 1)).tolist()
    at, cost = at.tolist(), cost.tolist()
    best, back, key = [0] * n, [0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        p = at[j]
        while at[queue[0]] < p - capacity:
            queue.popleft()
        source = queue[0]
        least = key[source] + capacity - p
        for i in come[first[j] : first[j + 1]]:
            if best[i] < least:
                least, source = best[i], i
        best[j], back[j] = least + cost[j], source
        key[j] = k = best[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [at[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1], best[-1]


def _run(ids: list, texts: list[bytes], base: int, tables, capacity: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of one run of documents, and how many sequences they fill."""
    whole = b"".join(texts)
    sizes = np.array([len(t) // 4 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cuts = np.array(best_cuts(*cut_positions(np.frombuffer(whole, "<u4"), ends, tables, capacity), capacity)[0], np.int64)
    edges = np.union1d(cuts, starts)
    a, b = edges[:-1], edges[1:]
    doc, sequence = np.searchsorted(starts, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
    view = memoryview(whole)
    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
    columns = (a - starts[doc], b - a, np.array(crc, np.int64), sizes[doc], base + sequence, a - cuts[sequence])
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(doc)), *map(pa.array, columns)], names=names), len(cuts) - 1


def pack_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document."""
    path = path or vocabulary(RANKS)
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tables, base = encoder(path), sentence_tables(path), TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0
        for batch in slices(batches):
            ids.append(batch.column(0))
            for text in batch.column(1).to_pylist():
                texts.append(enc.encode(text or "") + end)
                held += len(texts[-1]) // 4
            if held >= run_tokens:
                out, n = _run(ids, texts, base, tables, capacity)
                yield out
                ids, texts, held, base = [], [], 0, base + n
        if texts:
            yield _run(ids, texts, base, tables, capacity)[0]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op13_ordered_packing(spark, sf_dir: str) -> DataFrame:
    return pack_in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
