import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.llm import collocations as c


def brute(rows, min_count=30, top=2000):
    """Counts of every phrase of up to four words, then the rules one by one."""
    f, n = Counter(), Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = {}
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    within = {}
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                within.setdefault((lang, words[i : i + size]), []).append(a)
    for (lang, words), a in candidates.items():
        if any(100 * longer >= 80 * a for longer in within.get((lang, words), [])):
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for k, (score, a, p, left, right) in enumerate(sorted(own)[:top])}


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    rows = [tuple(r[k] for k in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(rng, rows=400):
    words = ["a", "b", "c", "D", "é", "Ü", "x-y", "the", "of", "'q'", "▁", "\x85", "(z)"]
    out = []
    for _ in range(rows):
        lang = rng.choice(["en", "en", "en", "de", None, "und", ""])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!? ", ";", ":\x0b", "\x0c"]) for _ in range(rng.randrange(60)))
        out.append((lang, rng.choice([text, text, text, "same old story of the world " * 3, None, ""])))
    return out + [("en", "long " * 5000 + "Tail end"), ("en", "and so on and so on and so on " * 40)] + out[:30]


@pytest.mark.parametrize("tile_bits, dense, block_words", [(10, 1 << 15, 1 << 20), (1, 2, 300), (2, 20, 2000)])
def test_phrases_against_brute_force(spark, tile_bits, dense, block_words):
    rng = random.Random(tile_bits)
    rows = made(rng)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("block", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("f", F.lit(1))
    for min_count in (30, 4):
        got = rows_of(c.collocations(df.repartition(5), min_count=min_count, block_words=block_words, tile_bits=tile_bits, dense=dense))
        want = brute(rows, min_count)
        assert got == want and len(want) > 10
    assert rows_of(c.collocations(df, top=3)) == brute(rows, top=3)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    assert rows_of(c.op12_collocations(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(df).count() == 0
    assert c.collocations(spark.createDataFrame([("en", ""), (None, None), ("de", " .\t")], "lang string, text string")).count() == 0


def test_counts_of_tiles():
    rng = np.random.default_rng(1)
    for bits, dense in ((2, 5), (3, 1), (10, 1 << 15), (4, 10**9)):
        ids = (rng.zipf(1.3, 5000) % 60).astype(np.int32)
        want = Counter((int(a) << 32 | int(b)) for a, b in zip(ids, ids[1:]) if a and b)
        keys, counts = c.count_pairs(ids, bits, dense)
        assert dict(zip(keys.tolist(), counts.tolist())) == want and len(keys) == len(want)


def test_scores_pass_64_bits(spark):
    """Counts near 2^62: products only fit decimals."""
    big = 1 << 61
    level = spark.createDataFrame([(1, "en", "x y", big, [big + 7, big], [big + 3, big]), (2, "en", "y z", 100, [100, 100], [100, 100])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    longer = spark.createDataFrame([(1, 2, 80)], "left long, right long, f long")
    got = [tuple(r) for r in c._scored(level, longer).collect()]
    assert got == [("en", "x y", big, big + 7, big + 3, 2_000_000 * big // (2 * big + 10))]


def test_tables_of_phrases_do_not_grow_with_the_blocks(spark, monkeypatch):
    """What is frequent is stored once, however many blocks hold it; the words' ranks alone come back to each block."""
    stored = {}

    def counted(df, name):
        stored[name] = (out := kept(df, name)).count()
        return out

    kept = c.materialise
    monkeypatch.setattr(c, "materialise", counted)
    rows = made(random.Random(5), 300)
    sizes = []
    for copies in (1, 4):
        stored.clear()
        assert rows_of(c.collocations(spark.createDataFrame(rows * copies, "lang string, text string"), min_count=5 * copies, block_words=300)) == brute(rows * copies, 5 * copies)
        sizes.append(dict(stored))
    phrases = [name for name in sizes[0] if re.search("-[2-4]", name)]
    assert len(phrases) >= 6 and [sizes[1][name] for name in phrases] == [sizes[0][name] for name in phrases]


@pytest.mark.parametrize("places", [7, 1009])
def test_places_that_are_taken_lose_and_add_nothing(spark, places):
    rows = made(random.Random(6))
    got = rows_of(c.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=4, block_words=2000, places=places))
    assert got == brute(rows, 4) and len(got) > 10


def test_bits_of_the_seen(spark):
    rng = np.random.default_rng(2)
    ids = np.r_[rng.integers(0, 30, 4000), 2**31 - 1, 2**31 - 2, 2**31 - 1, 2**31 - 2].astype(np.int32)
    for size in (3, 4):
        part = list(zip(*(ids[k:].tolist() for k in range(size - 1))))
        known = sorted({p for p in part if all(p) and sum(p) % 3})
        padded = [[0] * (5 - size) + list(p) for p in known]
        units = spark.createDataFrame([(w[0] << 32 | w[1], w[2] << 32 | w[3]) for w in padded], "high long, low long")
        seen = c._seen(units, size - 1, c.PLACES).value
        words, counts = c.phrase_counts(ids, size, seen, c.PLACES)
        places = {c._place(p) % c.PLACES for p in known}
        assert np.unpackbits(seen, bitorder="little").nonzero()[0].tolist() == sorted(places)
        passes = lambda p: all(p) and c._place(p) % c.PLACES in places
        want = Counter(tuple(map(int, ids[k : k + size])) for k in range(len(ids) - size + 1) if passes(part[k]) and passes(part[k + 1]))
        assert dict(zip(zip(*(w.tolist() for w in words)), counts.tolist())) == want and len(want) > 100
