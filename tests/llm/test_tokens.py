import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from certloom.llm import packing, piece_bpe, token_counts

ODD = [None, "", " ", "  a  b\n c\t€\U00010348 ", "\n\n", "a" * 4000, "▁x ▁▁ y", "ﬁ①ｱ ​ z", "Th\u0000e", "\r\n x\n\n\n  y  ", "   lead", "trail   ", "café naïve 123 4567 don't we'll", " \n ", "ABC" * 500 + " " * 37 + "end"]


def texts(spark, n=120):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n)
    rng = random.Random(5)
    alphabet = "abcdeft hern  \n\néè.,'1Q世\U0001f600\t"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    return rows + [(10_000 + i, t) for i, t in enumerate(ODD + made + [rows[0][1]])]


def test_pieces_equal_the_library(spark):
    rows = texts(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("id", F.lit(0))
    got = {r[0]: tuple(r)[1:] for r in piece_bpe.encode_digests(df).collect()}
    assert {i: rows_ for i, rows_ in got.items() if want[i] != rows_} == {} and len(got) == len(rows)
    full = piece_bpe.encode_pieces(df.filter("doc_id = 10003")).first()
    assert list(full.ids) == lib.encode(ODD[3], add_bos=True, add_eos=True)
    assert piece_bpe.encode_digests(df.limit(0)).count() == 0


def test_counts_equal_the_library(spark):
    vocab = token_counts.unigram_vocabulary(P.path("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    rows = texts(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_plan_uses_each_piece_once():
    rng = random.Random(1)
    for capacity, kinds in ((16, 15), (100, 40), (1024, 300), (1024, 1023)):
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 500) for _ in range(kinds)}
        packed, used = packing.plan(counts, capacity), {}
        for combo, n in packed:
            assert 0 < sum(combo) <= capacity and n > 0
            for s in combo:
                used[s] = used.get(s, 0) + n
        assert used == counts
    assert sum(n for _, n in packing.plan({3: 10, 5: 4, 8: 6}, 16)) == -(-(30 + 20 + 48) // 16)
    assert packing.plan({}) == []


def test_packing(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = texts(spark, 200) + [(7, "hot " * 3), (7, "hot " * 3), (None, "x"), (8, "a <|endoftext|> b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(packing.token_pieces(df)).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        at, piece = 0, 0
        while at < len(ids):
            size = len(ids) % 1024 or 1024 if at == 0 and len(ids) > 1024 else min(1024, len(ids) - at)
            want.append((i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, piece = at + size, piece + 1
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 1024) + 3
    assert packing.pack(packing.token_pieces(df.limit(0))).count() == 0
