"""Stages of the pipeline one by one, and the whole, against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from certloom.llm import near_dedup, packing, substring_dedup, token_counts, toxicity

from . import test_near_dedup, test_substring_dedup

SF = "/root/testdata/sf0.001"


def plain_pieces(rows):
    """(doc_id, piece, start, length, crc) by the encoder without its shortcuts."""
    enc, out = packing.encoder(packing.vocabulary(packing.RANKS)).library, []
    assert isinstance(enc, tiktoken.Encoding)
    for d, text in rows:
        ids = enc.encode(text or "", allowed_special="all") + [packing.END_ID]
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        out += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def check_packed(rows, docs):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(plain_pieces(docs))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def kept_words(rows):
    """Texts after removal of words covered by a window of 50 that starts in an earlier document."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, t), (_, w) in zip(rows, split):
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < d:
                keep[j : j + 50] = [False] * 50
        out.append((d, t if all(keep) else b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return out


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = {r.doc_id for r in toxicity.op2_toxicity(spark, SF).collect() if r.predicted}
    clean = [x for x in rows if x[0] not in bad]
    got = toxicity.stage(spark, docs, SF)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == sorted(clean)
    classes = dict(test_near_dedup.brute(clean))
    single = [x for x in clean if classes[x[0]] == x[0] or not (x[1] or "").strip()]
    assert len(single) < len(clean) < len(rows)
    short = kept_words(single)
    cut = substring_dedup.stage(spark, spark.createDataFrame(single, "doc_id long, text string"), SF)
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted(short)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]
    n = check_packed(corpus_pipeline.run(spark, SF).collect(), short)
    assert n <= 1.05 * sum(x[3] for x in plain_pieces(short)) / 1024 + 1


def test_packing_stage_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "long " * 5000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("length", F.lit("z")).withColumn("sequence_id", F.lit(0))
    got = [r.asDict() for r in packing.stage(spark, df, "").collect()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(plain_pieces(rows), key=key)
    assert packing.stage(spark, df.limit(0), "").count() == 0


def test_toxicity_stage_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "sun sea", "you idiot scum"] * 40)] + [(None, "sea")], "doc_id long, text string").withColumn("score", F.lit(9))
    found = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 3)) for i in range(160)], "doc_id long, toxic int")).transform(docs).filter("score < 0.5").select("row.*")
    assert found.columns == docs.columns and sorted((r.doc_id, r.text) for r in found.filter("doc_id is not null").collect()) == sorted((i, t) for i, t in enumerate([None, "", "sun sea", "you idiot scum"] * 40) if i % 4 != 3)


def test_calibration_is_that_of_the_scored_features(spark):
    """The isotonic step equals a plain pool-adjacent-violators fit over part 4 under the lexicon that scores."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    part = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.part_of("doc_id") == toxicity.CALIBRATION_PART)
    raw = model._raw(toxicity.with_features(part, "text", model.lexicon, ["toxic"])).select("raw", F.col("row.toxic").alias("y"))
    pairs = sorted((r.raw, float(r.y)) for r in raw.collect())
    x = np.array(sorted({a for a, _ in pairs}))
    blocks = []
    for a in x:
        ys = [y for b, y in pairs if b == a]
        blocks.append([sum(ys) / len(ys), len(ys), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + k]
    want = np.repeat([b[0] for b in blocks], [b[2] for b in blocks])
    got = [r.score for r in model.isotonic.transform(spark.createDataFrame([(float(a),) for a in x], "raw double")).collect()]
    assert len(x) > 2 and np.allclose(got, want, atol=1e-9)


def test_token_counts_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert token_counts.op9_token_counts.__name__ == "op9_token_counts" and token_counts.token_counts(docs).count() == 0
