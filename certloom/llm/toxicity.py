"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, in disjoint parts: remainders 1 and 2 give a first
lexicon (words, and beginnings of words for inflected ones, found mostly in toxic texts), under which 3 grows the trees; 1 to 3
give the lexicon that scores, under which 4 calibrates. So neither trees nor calibration see texts that their lexicon was learnt from, and the
calibration belongs to the features that are scored. At most SAMPLE labelled rows are used, those of the smallest hash; this bound also
bounds the one broadcast (ids and labels of the sample) and the lexicon. Every text is then scored in one pass, without a shuffle.

Features of a whole text: density and number of strong and weak lexicon words, words that are in the lexicon only
after undoing obfuscation (digits and signs for letters, repeated letters), lexicon words within five words of a
second-person word, second-person density, capitals, words all in capitals, punctuation, exclamation marks, words that
mix letters with digits or signs, repeated letters, and the length.

Defined cases: null and empty texts have all densities 0 and are scored too; very long texts are read whole, one after another; an empty table of
documents gives no rows; rows without a usable label only get a
score; labels that repeat a doc_id count once, toxic if any says so; a null doc_id is not held out and is never learnt
from; where labels lack one of the classes, scores are the share of toxic rows (0 without rows); columns other than the
text never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter as Counts
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, materialise, slices

#: Labelled rows that are learnt from at most, over all parts.
SAMPLE = 40_000
LEXICON_PARTS, TREE_PART, CALIBRATION_PART = (1, 2), 3, 4
BEGINNINGS = (4, 5, 6)
NEAR = 5

#: General insults to start from, for small label sets.
SEED_WORDS = frozenset("idiot idiots idiotic stupid moron morons loser losers scum trash pathetic disgusting worthless dumb fool jerk garbage clown pig bastard imbecile cretin idiota imbécil estúpido estúpida tonto basura idiote imbécile stupide crétin ordure dummkopf trottel blödmann abschaum dreck".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1+")
_PUNCTUATION = re.compile(r"[^\w\s]")
FEATURES = ["strong", "strong_n", "weak", "weak_n", "strong_kinds", "hidden", "near_second", "second", "capitals", "shouted", "punctuation", "exclamation", "mixed", "runs", "length"]
STRONG, WEAK, HIDDEN, SECOND, SHOUTED, MIXED, RUN = (1 << k for k in range(7))


def plain_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic texts, texts) of one task; beginnings carry a mark."""
    seen: list[Counts] = [Counts(), Counts()]

    def rows():
        tokens = [t for t, n in (seen[0] + seen[1]).items()]
        for at in range(0, len(tokens), 50_000):
            part = tokens[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][t] for t in part], pa.int64()), pa.array([seen[0][t] + seen[1][t] for t in part], pa.int64())], names=["token", "toxic", "n"])
        for s in seen:
            s.clear()

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(plain_words(text or ""))
            seen[toxic].update(words | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k})
        if len(seen[0]) + len(seen[1]) > 1_000_000:
            yield from rows()
    yield from rows()


def learn_lexicon(sample: DataFrame) -> tuple[frozenset, frozenset]:
    """(strong, weak) tokens: of texts with the token, over 0.9 or over 0.5 and three times the usual share are toxic."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = (totals["toxic"] or 0) / totals["n"] if totals["n"] else 0
    tokens = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "token string, toxic long, n long")
    tokens = tokens.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).withColumn("rate", F.col("toxic") / F.col("n"))
    few = max(3, totals["n"] // 2000)
    # a beginning counts with several words behind it, which chance tokens and copied texts do not have; a word needs more texts
    words = tokens.filter(~F.col("token").startswith("^") & (F.col("toxic") > 0))
    starts = F.explode(F.array(*[F.when(F.length("token") > k, F.concat(F.lit("^"), F.substring("token", 1, k))) for k in BEGINNINGS])).alias("token")
    kinds = words.select(starts).filter("token is not null").groupBy("token").agg(F.count("*").alias("kinds"))
    tokens = tokens.filter(F.col("toxic") >= few + 2).join(kinds, "token", "left").filter((F.col("kinds") >= 3) | (~F.col("token").startswith("^") & (F.col("toxic") >= few + 3)))
    tokens = materialise(tokens.select("token", "toxic", "rate"), "tokens")
    tiers = []
    for low, high in ((0.9, 1.01), (max(0.5, min(0.89, 3 * share)), 0.9)):
        best = tokens.filter((F.col("rate") >= low) & (F.col("rate") < high))
        tiers.append(frozenset(r["token"] for r in best.select("token").collect()))  # bounded by the sample
    return tiers[0] | SEED_WORDS, tiers[1]


class Reader:
    """Features of texts under one lexicon."""

    def __init__(self, strong: frozenset, weak: frozenset):
        self.strong, self.weak = strong, weak
        self.tokens = Memo(self.code)

    def tier(self, word: str) -> int:
        names = [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]
        if any(n in self.strong for n in names):
            return STRONG
        return WEAK if any(n in self.weak for n in names) else 0

    def code(self, token: str) -> int:
        low, code = token.lower(), 0
        words = _LETTERS.findall(low)
        for w in words:
            code |= self.tier(w)
            if w in SECOND_PERSON:
                code |= SECOND
        body = token.strip(".,;:!?\"'()[]-")
        if not body.isalpha() and any(c.isalpha() for c in body) and not re.fullmatch(r"[\w'’.-]*[^\W\d_]", body):
            code |= MIXED
        if _RUN.search(low):
            code |= RUN
        if not code & STRONG and (code & (MIXED | RUN) or not body.isalpha()):
            bare = "".join(_LETTERS.findall(body.lower().translate(UNDO)))
            if bare and (self.tier(bare) == STRONG or self.tier(_RUN.sub(r"\1", bare)) == STRONG):
                code |= HIDDEN
        letters = [c for c in token if c.isalpha()]
        if len(letters) > 2 and all(c.isupper() for c in letters):
            code |= SHOUTED
        return code

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        codes = np.fromiter(self.tokens.map(tokens), np.int64, n)
        count = lambda bit: int(np.count_nonzero(codes & bit))
        strong, weak, hidden, second = (count(b) for b in (STRONG, WEAK, HIDDEN, SECOND))
        near = kinds = 0
        if strong or hidden:
            hits = np.flatnonzero(codes & (STRONG | HIDDEN))
            kinds = len({tokens[k].lower().strip(".,;:!?") for k in hits})
            if second:
                at = np.flatnonzero(codes & SECOND)
                k = np.searchsorted(at, hits)
                ahead = np.where(k < len(at), at[np.minimum(k, len(at) - 1)] - hits, n)
                behind = np.where(k > 0, hits - at[np.maximum(k - 1, 0)], n)
                near = int(np.count_nonzero(np.minimum(ahead, behind) <= NEAR))
        size, words = max(len(text), 1), max(n, 1)
        capitals = sum(map(str.isupper, text)) if n and not text.islower() else 0
        signs = len(_PUNCTUATION.findall(text))
        return [strong / words, strong, weak / words, weak, kinds, hidden / words, near / words, second / words, capitals / size, count(SHOUTED) / words, signs / size, text.count("!") / size, count(MIXED) / words, count(RUN) / words, float(np.log1p(n))]


def with_features(docs: DataFrame, text_col: str, lexicon: tuple[frozenset, frozenset], carry: list[str]) -> DataFrame:
    """``row`` (a struct of the carried columns) and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*lexicon)
        for batch in slices(batches):
            found = np.array([reader.features(t or "") for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], names=["row", *FEATURES])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("text"))
    ddl = own.schema["row"].dataType.simpleString()
    return own.mapInArrow(run, f"row {ddl}, " + ", ".join(f"{f} double" for f in FEATURES))


class Toxicity:
    """A fitted scorer."""

    def __init__(self, lexicon, trees, isotonic, share: float):
        self.lexicon, self.trees, self.isotonic, self.share = lexicon, trees, isotonic, share

    def transform(self, docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
        """``row`` and ``score`` of each document."""
        found = with_features(docs, text_col, self.lexicon, carry or docs.columns)
        if self.trees is None:
            return found.select("row", F.lit(float(self.share)).alias("score"))
        found = self._raw(found)
        if self.isotonic is None:
            return found.select("row", F.col("raw").alias("score"))
        out = self.isotonic.transform(found.select("row", "raw"))
        return out.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))

    def _raw(self, found: DataFrame) -> DataFrame:
        own = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        return self.trees.transform(own).withColumn("raw", vector_to_array("probability")[1])


def part_of(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Toxicity:
    """Learn from the labelled documents that are not held out, at most ``sample`` of them."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("double").alias("toxic"))
    known = known.withColumn("part", part_of("id")).filter("part <> 0")
    bounded = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialise(texts.join(F.broadcast(bounded), "id"), "labelled")
    lexicon = learn_lexicon(rows.filter(F.col("part").isin(*LEXICON_PARTS)))
    scoring = learn_lexicon(rows.filter(F.col("part") != CALIBRATION_PART))
    seen = lambda part, words: with_features(rows.filter(F.col("part") == part), "text", words, ["toxic", "part"])
    own = seen(TREE_PART, lexicon).union(seen(CALIBRATION_PART, scoring))
    own = materialise(own.select(F.col("row.toxic").alias("label"), F.col("row.part").alias("part"), *FEATURES), "features")
    counts = {(r["part"], r["label"]): r["count"] for r in own.groupBy("part", "label").count().collect()}
    both = lambda part: all(counts.get((part, y), 0) for y in (0.0, 1.0))
    if not both(TREE_PART):
        return Toxicity(scoring, None, None, sum(n for (_, y), n in counts.items() if y) / max(1, sum(counts.values())))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=15, maxDepth=3, stepSize=0.3, seed=7, maxMemoryInMB=256).fit(vector.transform(own.filter(F.col("part") == TREE_PART)).select("features", "label").coalesce(4))
    model = Toxicity(scoring, trees, None, 0.0)
    if both(CALIBRATION_PART):
        model.isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(model._raw(own.filter(F.col("part") == CALIBRATION_PART)).select("raw", "label"))
    return model


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = model.transform(docs, carry=["doc_id"])
    held = F.coalesce(part_of("row.doc_id") == 0, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.transform(docs).filter("score < 0.5").select("row.*")
