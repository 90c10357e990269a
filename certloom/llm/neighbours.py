"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree has two storeys. The *upper* one is fitted on a bounded sample (SAMPLE vectors of the smallest hash, SAMPLE_NUMBERS numbers at
most) and ends in groups of about GROUP_NUMBERS numbers, MAX_GROUPS at most. Every vector of the table, sampled or not, is put in the
group that it reaches; groups meet in one shuffle the queries that visit them. The *lower* storey is fitted in the group's task, from the
group's own vectors, down to leaves of LEAF_ROWS. So leaves grow with the table, and nothing larger than the upper storey is
sent to all tasks. Groups above PIECE_NUMBERS are dealt to several pieces by salt, and so are queries where many visit one group.

*Search.* In both storeys a query goes through the nodes with a priority queue of inner products with their centroids. It visits leaves as long
as the best node in the queue is worth at least its bound less a slack; the bound is its 20th inner product with a part of the sample. It goes on, whatever
the worth, until the leaves visited hold enough rows for a full list. The slack is *calibrated*, i.e. widened until it keeps the wanted share of true
neighbours: above, for held-out vectors against the whole table by brute force (one pass); below, in each piece, for some of
its queries against all of its rows.

Of equal vectors only the 21 of smallest id can ever be among the 20 nearest of a row, and equal queries are searched once,
so a vector that a third of all rows share costs no more than 21 rows; nothing is lost by it.

Scores are inner products in double precision, summed in the same way for each pair, so equal vectors tie exactly and
ties go to the smaller id.

Defined cases: vectors that are null, of another length than most, all zero, or hold null, NaN or infinite numbers take no part,
neither as queries nor as candidates; rows with a null id take no part; rows that repeat an id and vector count once, and
a query's own id is no candidate; with fewer candidates all are returned; an empty table, or one without usable vectors, gives no
rows; other columns are not read, whatever their names. There is no text here; very long vectors make smaller groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 20
QUERY_EVERY = 20
SAMPLE, SAMPLE_NUMBERS, BOUND = 65_536, 8_000_000, 8_192
GROUP_NUMBERS, PIECE_NUMBERS, MAX_GROUPS = 2_000_000, 6_000_000, 16_384
LEAF_ROWS, BRANCHES = 256, 8
#: Shares of true neighbours that the slack of the upper and of the lower storey keeps.
UPPER_TARGET, LOWER_TARGET = 0.985, 0.97
HELD_OUT, PIECE_TRIALS, QUERIES_AT_ONCE = 200, 200, 8_192


class Tree:
    """Nodes in arrays: parent, children, centroids, and a leaf number where a node has no children."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(axis=0)]
        self.parent, self.children, self.leaf, self.node_of_leaf = [0], [[]], [-1], []
        self._grow(0, sample, max(1.0, len(sample) / max(1, leaves)))
        self.matrix = np.array(self.centres)

    def _grow(self, node: int, rows: np.ndarray, size: float) -> None:
        if len(rows) > 1.5 * size and len(rows) > 2:
            groups = self._split(rows, int(min(BRANCHES, max(2, round(len(rows) / size)))))
            if len(groups) > 1:
                for own in groups:
                    child = len(self.centres)
                    self.centres.append(own.mean(axis=0))
                    self.parent.append(node)
                    self.children.append([])
                    self.leaf.append(-1)
                    self.children[node].append(child)
                    self._grow(child, own, size)
                return
        self.leaf[node] = len(self.node_of_leaf)
        self.node_of_leaf.append(node)

    def _split(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        centres = rows[self.rng.choice(len(rows), k, replace=False)]
        for _ in range(6):
            own = self._nearest(rows, centres)
            centres = np.array([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        own = self._nearest(rows, centres)
        return [rows[own == j] for j in range(k) if (own == j).any()]

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1) / 2 - rows @ centres.T).argmin(axis=1)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node to the nearest child."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            own = self._nearest(rows[at], self.matrix[self.children[node]])
            todo += [(child, at[own == j]) for j, child in enumerate(self.children[node]) if (own == j).any()]
        return out

    def visits(self, worth: np.ndarray, least: float, sizes: np.ndarray, enough: int) -> tuple[list[int], int]:
        """Leaves in best-bin-first order while nodes are worth ``least``, or while the leaves so far hold less than ``enough`` rows; and
        how many of them were needed for that."""
        queue, out, rows, needed = [(-np.inf, 0)], [], 0, 0
        while queue and (rows < enough or -queue[0][0] >= least):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                needed += rows < enough
                rows += int(sizes[self.leaf[node]])
            for child in self.children[node]:
                heapq.heappush(queue, (-worth[child], child))
        return out, needed

    def reach(self, worth: np.ndarray) -> np.ndarray:
        """For each query (a row of worths) and leaf, the largest ``least`` with which the leaf is visited."""
        out = worth.copy()
        out[:, 0] = np.inf
        for node in range(1, len(self.parent)):
            out[:, node] = np.minimum(out[:, node], out[:, self.parent[node]])
        return out[:, self.node_of_leaf]


def slack_of(need: np.ndarray, share: float) -> float:
    """The smallest slack that covers ``share`` of the needs, or all of them where they are few; minus infinity without any."""
    if not len(need):
        return -np.inf
    return float(need.max() if len(need) < 50 else np.quantile(need, share, method="higher"))


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k nearest among the vectors; ties to the smaller id."""
    rough = queries @ vectors.T
    if len(ids) > k:
        kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
        blur = 1e-12 * np.sqrt((queries * queries).sum(axis=1) * (vectors * vectors).sum(axis=1).max())
        at, which = np.nonzero(rough >= (kth - blur)[:, None])
    else:
        at, which = np.divmod(np.arange(rough.size), len(ids))
    score = (queries[at] * vectors[which]).sum(axis=1)
    order = np.lexsort((ids[which], -score, at))
    at, which, score = at[order], which[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], which[keep], score[keep]


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, opened: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query number, id, score) of each query's k nearest found in one piece, through a tree of the piece's own vectors, and the share of
    leaves visited. Rows below its bound cannot be among a query's nearest and are left out, unless the query is open."""
    leaves = max(1, len(rows) // LEAF_ROWS)
    drawn = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[: 32 * max(64, leaves)]
    tree = Tree(rows[drawn], leaves)
    leaf = tree.assign(rows)
    order = np.argsort(leaf, kind="stable")
    rows, ids, leaf = rows[order], ids[order], leaf[order]
    sizes = np.bincount(leaf, minlength=len(tree.node_of_leaf))
    ends = np.cumsum(sizes)
    norm, longest = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1).max())
    # calibration: the slack that keeps LOWER_TARGET of some queries' true neighbours
    trial = np.unique(np.linspace(0, len(queries) - 1, PIECE_TRIALS).astype(np.int64))
    trial = trial[np.isfinite(bounds[trial])]
    slack = -np.inf
    if len(trial):
        at, which, score = best(queries[trial], ids, rows, k)
        near = score >= bounds[trial][at]
        reach = tree.reach(queries[trial] @ tree.matrix.T)
        slack = slack_of(((bounds[trial][at] - reach[at, leaf[which]]) / norm[trial][at])[near], LOWER_TARGET)
    least = np.where(np.isfinite(bounds), bounds - slack * norm if np.isfinite(slack) else np.inf, -np.inf)
    visited = np.zeros((len(queries), len(sizes)), bool)
    for start in range(0, len(queries), 1024):
        worth = queries[start : start + 1024] @ tree.matrix.T
        # a leaf comes out of the queue before it falls below ``least`` just if its reach is as large
        visited[start : start + 1024] = tree.reach(worth) >= least[start : start + 1024, None]
        for q in np.flatnonzero(opened[start : start + 1024]):
            visited[start + q, tree.visits(worth[q], least[start + q], sizes, k)[0]] = True
    short_rows, short_queries = rows.astype(np.float32), queries.astype(np.float32)
    blur = (bounds - 1e-5 * norm * longest).astype(np.float32)
    found = []
    for x in np.flatnonzero(sizes):
        lo, hi = ends[x] - sizes[x], ends[x]
        own = np.flatnonzero(visited[:, x])
        for part in np.array_split(own[~opened[own]], 1 + len(own) // 2048):
            at, which = np.nonzero(short_queries[part] @ short_rows[lo:hi].T >= blur[part, None])
            score = (queries[part[at]] * rows[lo + which]).sum(axis=1)
            keep = score >= bounds[part[at]]
            found.append((part[at[keep]], ids[lo + which[keep]], score[keep]))
        for part in np.array_split(own[opened[own]], 1 + len(own) // 2048):
            at, which, score = best(queries[part], ids[lo:hi], rows[lo:hi], k)
            found.append((part[at], ids[lo + which], score))
    q, own, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((own, -score, q))
    q, own, score = q[order], own[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], own[keep], score[keep], float(visited.mean())


def _arrays(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists, each of ``dim`` numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(rows.ravel(), pa.float64()).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


class Upper:
    """The upper storey: which groups rows belong to and queries visit."""

    def __init__(self, sample: np.ndarray, groups: int, k: int):
        self.tree, self.bound = Tree(sample, groups), sample[:BOUND]
        self.k, self.slack, self.sizes = k, np.inf, np.zeros(len(self.tree.node_of_leaf), np.int64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The k-th inner product with the sample, one spared for the query itself."""
        worth = queries @ self.bound.T
        n = worth.shape[1]
        return np.partition(worth, n - self.k - 1, axis=1)[:, n - self.k - 1] if n > self.k else np.full(len(queries), -np.inf)

    def calibrate(self, queries: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        """Widen the slack for true neighbours: query number and group of each."""
        bounds = self.bounds(queries)
        if len(at) and np.isfinite(bounds).all():
            need = bounds[at] - self.tree.reach(queries @ self.tree.matrix.T)[at, group]
            self.slack = slack_of(need / np.sqrt((queries * queries).sum(axis=1))[at], UPPER_TARGET)

    def visits(self, queries: np.ndarray) -> Iterator[tuple[float, list[int], int]]:
        """(bound, groups, how many of them are needed for a full list) of each query."""
        norm = np.sqrt((queries * queries).sum(axis=1))
        for worth, bound, size in zip(queries @ self.tree.matrix.T, self.bounds(queries), norm):
            least = bound - self.slack * size if np.isfinite(bound) else -np.inf
            yield bound, *self.tree.visits(worth, least, self.sizes, self.k + 1)


def fitted(kept: DataFrame, dim: int, total: int, k: int, sample: int = SAMPLE, group_numbers: int = GROUP_NUMBERS) -> Upper:
    """The upper storey, fitted on a sample and calibrated on held-out vectors against the whole table."""
    numbers = total * dim
    groups = int(min(MAX_GROUPS, max(1, -(-numbers // group_numbers), min(8, 8 * numbers // group_numbers))))
    most = min(sample, SAMPLE_NUMBERS // dim, max(BOUND, 16 * groups), max(2 * k, total // 2))
    drawn = kept.filter("nth = 1").orderBy(F.xxhash64("id"), "id").limit(max(k + 2, most) + HELD_OUT).select("id", "v").toArrow()
    ids, rows = drawn.column("id").to_numpy(), _arrays(drawn.column("v"), dim)
    fit = max(1, min(most, len(rows) - min(HELD_OUT, len(rows) // 4)))
    upper, asked, asked_ids = Upper(rows[:fit], min(groups, max(1, fit // 4)), k), rows[fit:], ids[fit:]

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, held = np.zeros(len(upper.sizes), np.int64), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            own, v = batch.column("id").to_numpy(), _arrays(batch.column("v"), dim)
            if not len(own):
                continue
            group = upper.tree.assign(v)
            sizes += np.bincount(group, minlength=len(sizes))
            if len(asked):
                at, which, score = best(asked, own, v, k + 1)
                other = own[which] != asked_ids[at]
                held = [np.concatenate(x) for x in zip(held, (at[other], group[which[other]], score[other]))]
                order = np.lexsort((-held[2], held[0]))
                order = order[np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order]) < k]
                held = [x[order] for x in held]
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), -1)), pa.array(some), pa.array(sizes[some].astype(np.float64))], names=["at", "grp", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["at", "grp", "score"])

    seen = materialise(kept.mapInArrow(truth, "at long, grp long, score double"), "truth")
    for r in seen.filter("at < 0").groupBy("grp").agg(F.sum("score").cast("long").alias("n")).collect():
        upper.sizes[r["grp"]] = r["n"]
    order = Window.partitionBy("at").orderBy(F.desc("score"), "grp")
    near = seen.filter("at >= 0").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("at", "grp").toArrow()
    upper.calibrate(asked, near.column("at").to_numpy(), near.column("grp").to_numpy())
    return upper


def nearest(table: DataFrame, id_col: str, vector_col: str, is_query, k: int = K, sample: int = SAMPLE, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (a condition on ``id``) holds."""
    number = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    kind = pa.float32() if number == "float" else pa.float64()
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v")).filter(usable)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 1
    rows = rows.filter(F.size("v") == dim)
    # the limit holds before the shuffle by vector already; rows that repeat an id have one rank, and fall together after it
    nth = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = materialise(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).dropDuplicates(["v", "id"]).select("id", "v", "nth"), "vectors")
    total = kept.count()
    columns = "asked long, vec_id long, score double"
    if not total:
        return kept.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    upper = fitted(kept, dim, total, k, sample, group_numbers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(upper.tree.assign(_arrays(batch.column("v"), dim))), batch.column("id"), batch.column("v")], names=["grp", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                v = _arrays(part.column("v"), dim)
                at, groups, bounds, opened = [], [], [], []
                for q, (bound, own, needed) in enumerate(upper.visits(v)):
                    at += [q] * len(own)
                    groups += own
                    bounds += [bound] * len(own)
                    opened += [n < needed for n in range(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), part.column("id").take(pa.array(at, pa.int64())), pa.array(bounds, pa.float64()), pa.array(opened, pa.bool_()), _lists(v[at], kind)], names=["grp", "id", "bound", "opened", "v"])

    # equal query vectors are searched once, under the smallest id among them
    asked = materialise(rows.filter(is_query).groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "asked")
    visits = asked.mapInArrow(ask, f"grp long, id long, bound double, opened boolean, v array<{number}>")
    busy = {r["grp"]: r["n"] for r in visits.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    piece = max(1, PIECE_NUMBERS // dim)
    shapes = [(g, 1 + int(n) // piece, 1 + busy[g] // QUERIES_AT_ONCE) for g, n in enumerate(upper.sizes) if g in busy]
    shape = F.broadcast(kept.sparkSession.createDataFrame(shapes, "grp long, parts int, turns int"))  # a row a group, MAX_GROUPS at most
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = kept.select("id", "v").mapInArrow(place, f"grp long, id long, v array<{number}>").join(shape, "grp").select("grp", salt(F.col("parts")).alias("part"), each("turns").alias("turn"), "id", "v")
    right = visits.join(shape, "grp").select("grp", each("parts").alias("part"), salt(F.col("turns")).alias("turn"), "id", "bound", "opened", "v")

    def found(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if own.num_rows and queries.num_rows:
            at, *hits, _ = search(_arrays(own.column("v"), dim), own.column("id").to_numpy(), _arrays(queries.column("v"), dim), queries.column("bound").to_numpy(), queries.column("opened").to_numpy(), k + 1)
            out = [queries.column("id").to_numpy()[at], *hits]
        return pa.table(out, names=["asked", "vec_id", "score"])

    key = ["grp", "part", "turn"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(found, columns)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    lists = asked.join(lists.withColumnRenamed("asked", "id"), "id").select("v", "found")
    every = rows.filter(is_query).select("id", "v").distinct().join(materialise(lists, "lists"), "v").select(F.col("id").alias("query_id"), "found")
    own = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return every.select("query_id", F.posexplode(own).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.expr(f"id % {QUERY_EVERY} = 0"))
