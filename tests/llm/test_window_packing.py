import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from certloom.llm import window_packing as w
from certloom.llm.packing import RANKS

from .test_tokens import ODD, texts


def padding(length, capacity=1024):
    return 0 if length & (length - 1) == 0 else capacity - length


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for capacity in (8, 16, 32):
        for _ in range(120):
            at, n = [0], rng.randrange(1, 40)
            while len(at) <= n:
                at.append(at[-1] + rng.randrange(1, capacity if rng.random() < 0.2 else 5))
            cost = [0] + [rng.choice([0, 1, 1, 8]) for _ in range(n)]
            best = [0] + [None] * n
            for j in range(1, n + 1):
                best[j] = cost[j] + min(best[i] + padding(at[j] - at[i], capacity) for i in range(j) if at[j] - at[i] <= capacity)
            cuts, total = w.best_cuts(np.array(at), np.array(cost), capacity)
            assert total == best[n] and cuts[0] == 0 and cuts[-1] == at[n] and set(cuts) <= set(at)
            price = dict(zip(at, cost))
            assert total == sum(padding(b - a, capacity) + price[b] for a, b in zip(cuts, cuts[1:]))


def test_cut_positions():
    ends, opens = np.zeros(9, bool), np.zeros(9, bool)
    ends[3], opens[5] = True, True
    ids = np.array([1, 3, 5, 3, 1] + [1] * 200 + [0, 1, 0])
    at, cost = w.cut_positions(ids, np.array([206, 208]), (ends, opens), 32)
    price = dict(zip(at.tolist(), cost.tolist()))
    assert price[0] == price[206] == price[208] == 0 and price[2] == w.SENTENCE_CUT and 4 not in price
    assert all(price[p] == w.HARD_CUT for p in (32, 34, 64, 66, 192, 194)) and len(price) == 4 + 12


def test_ordered_packing(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = texts(spark, 200) + [(7, "hot " * 3), (7, "hot " * 3), (None, "x"), (8, "a <|endoftext|> b"), (9, " x"), (10, "word " * 6000), (11, "\nOne.\n\nTwo! \nThree?\n")]
    rows += [(20_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("id", F.lit(1))
    got = w.pack_in_order(df.coalesce(1)).collect()
    want = {k: (i, lib.encode(t or "", add_special_tokens=False).ids + [0]) for k, (i, t) in enumerate(rows)}
    # one partition: pieces come in the order of the rows, and those of one document follow each other
    at, k = 0, 0
    sequences = {}
    for r in got:
        i, ids = want[k]
        assert (r.doc_id, r.start, r.doc_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
        at += r.length
        if at == len(ids):
            at, k = 0, k + 1
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert k == len(rows) and max(sequences.values()) <= 1024
    total = sum(len(ids) for _, ids in want.values())
    assert sum(padding(n) for n in sequences.values()) < 0.01 * total
    assert w.pack_in_order(df.limit(0)).count() == 0
    spread = w.pack_in_order(df.repartition(3)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o")).collect()
    assert max(r.n for r in spread) <= 1024 and all(r.o == 0 for r in spread) and sum(r.n for r in spread) == total


def test_marked_words_give_the_same_ids(spark):
    enc = w.encoder(w.vocabulary(RANKS))
    for _, t in texts(spark, 150):
        assert enc.encode(t or "") == np.array(enc.library.encode(t or "", allowed_special="all"), "<u4").tobytes()


def test_runs_are_bounded(spark):
    df = spark.createDataFrame([(k, "Some words here. " * 30) for k in range(600)], "doc_id long, text string")
    rows = w.pack_in_order(df.coalesce(1), run_tokens=500).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert all(r.n <= 1024 and r.k == r.m for r in rows) and sum(r.n for r in rows) == 600 * (30 * 4 + 2)
