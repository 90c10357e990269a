"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming keeps, for
each prefix, the best score and the number of pieces of the best path only. Ties go as in the ``tokenizers`` library's
unigram model: a path replaces another only if it scores strictly higher, and starts come in ascending order, so the
longest last piece wins. A character that is no piece costs the lowest score less 10; runs of such
characters count their UTF-8 bytes, as byte fallback does.

No unigram vocabulary is on the box: the pieces and scores of ``piece_bpe_32k.model`` serve as one (control and byte
pieces have no text of their own). Texts are cut before each space, as the library's space-mark splitter does, so the
scores of one chunk are added exactly.

Defined cases: null and empty texts count 0; repeated rows are counted each; a null id is kept; very long texts are
counted whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices
from .tokenizers_path import vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Fixed value: what the library takes from the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order; id 0 is the unknown piece."""
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size())]


class Counter:
    def __init__(self, path: str):
        pieces = unigram_vocabulary(path)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.chunks = Memo(self.count_chunk)

    def count_chunk(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of the best path."""
        n = len(chunk)
        score, count, open_run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        found: list[list] = [[] for _ in range(n)]
        for at, piece in self.automaton.iter(chunk):
            found[at].append(piece)
        for end in range(1, n + 1):
            single = False
            best, pieces, run = None, 0, False
            for size, s in sorted(found[end - 1], reverse=True):
                single |= size == 1
                total = score[end - size] + s
                if best is None or total > best:
                    best, pieces, run = total, count[end - size] + 1, False
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces, run = total, count[end - 1] + len(chunk[end - 1].encode()), True
            score[end], count[end], open_run[end] = best, pieces, run
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        first, *rest = text.replace(" ", MARK).split(MARK)
        # the space mark is put before the text unless it starts with one
        chunks = ([MARK + first] if first else []) + [MARK + w for w in rest]
        pieces, score = 0, 0.0
        for p, s in self.chunks.map(chunks):
            pieces += p
            score += s
        return pieces, score


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, score) of each row."""
    path = path or vocabulary(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in slices(batches):
            found = [c.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["id", "n_tokens", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
