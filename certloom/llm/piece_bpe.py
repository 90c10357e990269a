"""SentencePiece BPE encoding by a table of prefixes, and decoding.

For each prefix of a chunk the encoding's last piece is unique. Going through the chunk once, an Aho-Corasick automaton
gives the pieces that end at each character; piece t starting at s is the last piece of that prefix if it stands alone
(s = 0) or if it is *compatible* with the last piece of the prefix s: the merges of the two pieces' joined text give
just these two pieces. The table keeps one piece for each prefix; the ids are recovered from its end backwards.

Chunks: no piece has a space mark after another character, and no piece holds a character outside the vocabulary, so
merges cross neither a boundary before a space mark nor a byte-fallback character. Texts are cut there, and chunks are
remembered within a task (bounded), as most repeat.

Defined cases: null counts as empty; an empty text gives the begin and end ids alone; characters outside the vocabulary
become the byte pieces of their UTF-8 form; repeated rows give repeated results; a null id is kept; very
long texts are encoded whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices
from .tokenizers_path import vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"


class PieceBpe:
    """The encoder of one model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.text, self.score, self.id = {}, {}, {}
        self.byte = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.text[i], self.score[i], self.id[piece] = piece, lib.get_score(i), i
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark after other characters; texts can't be cut before the marks")
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {i: self.merges(p) == [i] for i, p in self.text.items() if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.chunks = Memo(self.encode_chunk)
        self.foreign = re.compile("([^" + re.escape("".join(p for p in self.id if len(p) == 1)) + "])")

    def merges(self, text: str) -> list[int]:
        """Ids by the merges themselves: the best-scored neighbours first, the leftmost of equals. Quadratic; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.id[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_whole(self, i: int) -> bool:
        known = self.alone.get(i)
        if known is None:
            known = self.alone[i] = self.merges(self.text[i]) == [i]
        return known

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merges(self.text[a] + self.text[b]) == [a, b]
        return known

    def last_pieces(self, text: str) -> list[tuple[int, int]]:
        """(length, id) of the last piece of each prefix of a text of known characters."""
        table: list = [None] * len(text)
        pairs, alone = self.pairs, self.alone
        for at, found in self.automaton.iter(text):
            if table[at] is None:
                size, i = found
                if size == at + 1:
                    ok = alone.get(i)
                    if self.is_whole(i) if ok is None else ok:
                        table[at] = found
                else:
                    before = table[at - size]
                    if before is not None:
                        ok = pairs.get(before[1] << 20 | i)
                        if self.compatible(before[1], i) if ok is None else ok:
                            table[at] = found
        return table

    def encode_known(self, text: str) -> list[int]:
        table, ids, at = self.last_pieces(text), [], len(text) - 1
        while at >= 0:
            if table[at] is None:  # no prefix lacks its piece; were it so, the merges decide
                return self.merges(text)
            size, i = table[at]
            ids.append(i)
            at -= size
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        ids: list[int] = []
        for k, part in enumerate(self.foreign.split(chunk)):
            if k % 2:
                ids += [self.byte[b] for b in part.encode()]
            elif part:
                ids += self.encode_known(part)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text with begin and end, as little-endian 32-bit integers."""
        parts: list[bytes] = [np.array([self.begin], "<u4").tobytes()]
        if text:
            text = MARK + text.replace(" ", MARK)
            for k, line in enumerate(text.split("\n")):
                if k:
                    parts.append(self.newline)
                if not line:
                    continue
                if MARK * 2 in line:
                    parts += self.chunks.map(re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line))
                else:
                    first, *rest = line.split(MARK)
                    if first:
                        parts += self.chunks.map([first])
                    parts += self.chunks.map([MARK + w for w in rest])
        parts.append(np.array([self.end], "<u4").tobytes())
        return b"".join(parts)

    @property
    def newline(self) -> bytes:
        return self.chunks.map(["\n"])[0]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@cache
def encoder(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string) of each row."""
    return _run(docs, id_col, text_col, path, False)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row; the ids and texts do not leave the tasks."""
    return _run(docs, id_col, text_col, path, True)


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, digests: bool) -> DataFrame:
    path = path or vocabulary(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            ids = [enc.encode(t or "") for t in batch.column(1).to_pylist()]
            texts = [enc.decode(i) for i in ids]
            if digests:
                out = [
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out = [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(texts)]
                names = ["id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=names)

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {rest}").withColumnRenamed("id", id_col)


def op3_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
