"""Near-duplicates by weighted Jaccard similarity of five-word shingles: BagMinHash, bands, exact verification.

*Signatures.* A text is a multiset of shingles. Weights are cut at 1, 2, 4, 8, ... into intervals; each shingle and
interval has its own Poisson process, of the interval's length as rate, whose points have a time, a register and a
position in the interval. A point counts if its position lies below the shingle's weight, so the interval in which a
weight ends is thinned and those below it count in full. Register r keeps the first point dealt to it. Two texts have
the same point there with probability equal to their weighted Jaccard similarity. Processes stop as soon as their next
point is later than all registers of the text, for long texts after a few points.

*Candidates.* 24 bands of 5 registers: a pair of similarity 0.8 shares a band with probability 0.99993. Equal multisets
are one *node*. A node is compared with two leaders of its buckets first, the member that shares most buckets and the smallest, so
candidates grow with the input and not with the square of a bucket. Leaders join almost all that belongs together. Rows
of a bucket that are still in different components are then compared in blocks, text against text, so no link is missed
that any band holds; only links leave a block. Every candidate is verified by the exact multiset overlap of its texts (sum of minima over sum of maxima).

*Classes.* Connected components of the verified links, by least labels with pointer jumping; each round is written to the
shared folder. The class id is the smallest doc_id of the class.

Defined cases: words are what stands between ASCII white space, unchanged; a text of one to four words is one shingle; a
text without words, or null, is in a class of its own; rows that repeat a text or a doc_id are in one class if
their texts are similar, and apart if not; a null doc_id never names a class that has another; very long texts are signed and compared
whole, in a task's memory one after another; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialise, mix, slices, text_bytes, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Rows of a bucket that are compared with each other, or with as many others, in one task.
BLOCK_ROWS = 256
#: 128 bits that tell apart rows by id and text, so that rows with one id, or none, are never taken for each other.
KEY = ["key_a", "key_b"]


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a text's shingles, ordered by hash."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(SHINGLE, len(words))), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum() + b[1].sum()) - least) if len(a[0]) or len(b[0]) else 1.0


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (docs x registers) of multisets given as (document, element hash, integer weight)."""
    own, seeds, low, rate, limit = [], [], [], [], []
    lower, length, level = 0, 1, 0
    while True:
        use = weight > lower
        if not use.any():
            break
        own.append(doc[use])
        seeds.append(mix(key[use], np.full(int(use.sum()), level + 1, np.uint64)))
        limit.append(weight[use] - lower)
        rate.append(np.full(int(use.sum()), float(length)))
        lower, length, level = lower + length, max(1, lower + length), level + 1
    first = np.full(docs * registers, np.inf)
    points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if own:
        own, seeds, limit, rate = (np.concatenate(x) for x in (own, seeds, limit, rate))
        time, k = np.zeros(len(own)), 0
        while len(own):
            r1 = mix(seeds, np.full(len(seeds), 2 * k + 11, np.uint64))
            r2 = mix(seeds, np.full(len(seeds), 2 * k + 12, np.uint64))
            time = time - np.log(((r1 >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            inside = (r2 & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate < limit
            flat = own * registers + (((r2 >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            points.append((flat[inside], time[inside], r1[inside]))
            np.minimum.at(first, flat[inside], time[inside])
            alive = time < first.reshape(docs, registers).max(axis=1)[own]
            own, seeds, limit, rate, time = own[alive], seeds[alive], limit[alive], rate[alive], time[alive]
            k += 1
    out = np.zeros(docs * registers, np.uint64)
    for flat, at, name in points:
        best = at == first[flat]
        out[flat[best]] = name[best]
    return out.reshape(docs, registers)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        out = mix(out, np.ascontiguousarray(rows[:, :, k]))
    return out


def node_of(own: tuple[np.ndarray, np.ndarray]) -> int | None:
    """A 64-bit name of a multiset."""
    if not len(own[0]):
        return None
    return int.from_bytes(hashlib.md5(own[0].tobytes() + own[1].tobytes()).digest()[:8], "little", signed=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bags = [shingles(t) for t in text_bytes(batch.column("text"))]
        sizes = [len(k) for k, _ in bags]
        doc = np.repeat(np.arange(len(bags)), sizes)
        signatures = bag_minhash(doc, np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags]), len(bags))
        bands = pa.array(list(band_hashes(signatures).view(np.int64)), pa.list_(pa.int64()))
        own = [batch.column(c) for c in ("doc", *KEY)]
        yield pa.RecordBatch.from_arrays([*own, pa.array([node_of(b) for b in bags], pa.int64()), bands], names=["doc", *KEY, "node", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    known: OrderedDict = OrderedDict()

    def bag(node: int, text: bytes):
        if node not in known:
            known[node] = shingles(text)
            if len(known) > 128:
                known.popitem(last=False)
        known.move_to_end(node)
        return known[node]

    for batch in slices(batches):
        a, b = batch.column("a"), batch.column("b")
        keep = []
        for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))):
            p, q = bag(x, s), bag(y, t)
            keep.append(overlap(p, q) >= similarity)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def texts_of(wanted: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(node, text): one text of each wanted node, found by the row's key; rows repeated in full have one."""
    rows = base.join(nodes.join(wanted, "node").select("node", *KEY), KEY)
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, base)
    with_a = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    return materialise(both.mapInArrow(lambda it: _verify(it, similarity), "a long, b long").distinct(), "links")


def _link_block(table: pa.Table, similarity: float) -> pa.Table:
    """The similar pairs of different components among one block's rows, each in the first band that it shares only."""
    nodes, labels, band = (table.column(c).to_numpy() for c in ("node", "label", "band"))
    bags = [shingles(t) for t in text_bytes(table.column("text").combine_chunks())]
    # a shingle that occurs w times is w elements, so that overlaps are products of 0/1 rows
    times = np.concatenate([c for _, c in bags])
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    keys = mix(np.repeat(np.concatenate([k for k, _ in bags]), times), nth.astype(np.uint64))
    sizes = np.array([int(c.sum()) for _, c in bags])
    _, column = np.unique(keys, return_inverse=True)
    row = np.repeat(np.arange(len(bags)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(bags), len(bags)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(bags), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    a, b = np.nonzero(np.triu(common >= similarity * (sizes[:, None] + sizes[None, :] - common), 1) & (labels[:, None] != labels[None, :]))
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    if len(a):
        first = (bands[a] == bands[b]).argmax(axis=1)
        own = bands[a, first] == band[a]
        a, b = a[own], b[own]
    x, y = nodes[a], nodes[b]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def across(ranked: DataFrame, labels: DataFrame, nodes: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """Links between different components that share a bucket: each bucket's rows in blocks, exactly, texts against
    texts. Rows of the bucket's largest component are only compared with the rest, so a bucket that its leaders joined
    costs its size times the few rows left over. No pair leaves a task unless it is a link."""
    named = ranked.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    count = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    mixed = materialise(mixed.select("band", "all", F.col("main.label").alias("main"), count(F.col("main.n")).alias("mains"), count(F.col("all") - F.col("main.n")).alias("rests")), "mixed")
    left = named.join(mixed, "band")
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    up = lambda n: F.sequence(F.lit(0), n - 1)
    rest, main = at(F.col("rests")), at(F.col("mains"))
    of_rest = F.concat(F.transform(up(F.col("rests")), lambda j: block("rest", F.least(rest, j), F.greatest(rest, j))), F.transform(up(F.col("mains")), lambda m: block("main", m, rest)))
    of_main = F.transform(up(F.col("rests")), lambda r: block("main", main, r))
    small = F.array(block("all", F.lit(0), F.lit(0)))
    blocks = F.when(F.col("all") <= BLOCK_ROWS, small).when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)
    left = materialise(left.select("band", "node", "label", F.explode(blocks).alias("block")), "blocks")
    texts = texts_of(left.select("node").distinct(), nodes, base).join(nodes.select("node", "bands"), "node")
    rows = left.join(texts, "node").select("band", "block", "node", "label", "bands", "text")
    return materialise(rows.groupBy("band", "block").applyInArrow(lambda t: _link_block(t, similarity), "a long, b long").distinct(), "links")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def keyed(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """(doc, text, key_a, key_b) and the other columns. Names of ``docs`` may clash with these, so others go in as a struct."""
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    more = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    return docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(doc.isNull(), doc, text).alias("key_a"), F.xxhash64(text, F.lit(7), doc).alias("key_b"), *more)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc, key, node, bands) of each row, and (node, label, first) of each node: its class and the class's first row, as
    (no id, doc, key_a, key_b): that of the smallest doc_id, rows without one last, ties to the smaller key."""
    base = keyed(docs, id_col, text_col)
    kind = base.schema["doc"].dataType.simpleString()
    signed = materialise(base.mapInArrow(_sign, f"doc {kind}, key_a long, key_b long, node long, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc").isNull().alias("missing"), "doc", *KEY)).alias("first")
    nodes = materialise(signed.filter("node is not null").groupBy("node").agg(first, F.first("bands").alias("bands")), "nodes")
    nodes = nodes.select("node", "first", *[F.col(f"first.{c}").alias(c) for c in KEY], "bands")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialise(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    buckets = materialise(rows.join(shared, "band"), "buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("central"))
    ranked = materialise(buckets.join(central, "node").select("band", "node", "central"), "ranked")
    leaders = materialise(ranked.groupBy("band").agg(F.max(F.struct("central", "node")).alias("lead"), F.min("node").alias("least")), "leaders")
    # a node is first compared with the most central of its buckets' leaders and with the smallest: two pairs for each node
    own = ranked.join(leaders, "band").groupBy("node").agg(F.max(F.when(F.col("lead.node") != F.col("node"), F.col("lead"))).node.alias("lead"), F.min("least").alias("least"))
    pairs = own.select("node", F.explode(F.array("lead", "least")).alias("lead")).filter("node <> lead")
    tested = materialise(pairs.select(*_ordered("node", "lead")).distinct(), "tested")
    edges = verified(tested, nodes, base, similarity)
    labels = components(edges)
    edges = materialise(edges.union(across(ranked, labels, nodes, base, similarity)), "links")
    named = nodes.select("node", "first").join(components(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    named = materialise(named, "named")
    firsts = named.groupBy("label").agg(F.min("first").alias("first"))
    return signed, materialise(named.select("node", "label").join(firsts, "label"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, node, class_id) of each row; ``node`` is null for texts without words."""
    signed, classes = classify(docs, id_col, text_col, similarity)
    class_id = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("first.doc"))
    return signed.select("doc", "node").join(classes.select("node", "first"), "node", "left").select(F.col("doc").alias(id_col), "node", class_id.alias("class_id"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", (~F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_copy"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class stays, that of the smallest doc_id (rows without one last), whatever other rows
    have its id; of rows that repeat id and text any one. Documents without words all stay."""
    _, classes = classify(docs)
    kept = materialise(classes.select("first.*").select(*KEY).distinct(), "kept")
    rows = keyed(docs, "doc_id", "text", *docs.columns)
    words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    full = rows.filter(words).join(kept, KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))
    return full.select("row.*").union(rows.filter(~words).select("row.*"))
