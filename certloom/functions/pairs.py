"""Pairs of the members of sets, counted where the members of two classes meet, so that sets are moved and not their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that one step inside a task counts together, and those that wait in a task until their rows are replaced by their counts.
PAIRS_AT_ONCE, PAIRS_HELD = 1_000_000, 30_000_000


def pair_counts(sets: DataFrame, group: str, members: str, weight: str, classes: int, parts: int, at_once: int = PAIRS_AT_ONCE, held: int = PAIRS_HELD) -> DataFrame:
    """(group, a, b, n): the weights of the sets of a group that hold both a and b, a <= b. ``members`` are sorted and differ.

    Members fall in ``classes`` by hash. A set goes to the cells of its group, one for each two classes of which it has members, with these
    members only: each member is moved at most ``classes`` times. All sets with a pair are in the pair's cell, so what a cell counts is not moved again."""
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    kind = kinds[members].removeprefix("array<")[:-1]
    own = F.array(members) if classes == 1 else F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda p: F.filter(members, lambda x: F.pmod(F.xxhash64(x), F.lit(classes)) == p))
    by = sets.select(group, F.col(weight).cast("long").alias("n"), own.alias("own"))
    some = by.select(group, "n", "own", F.posexplode("own").alias("p", "left")).filter(F.size("left") > 0)
    cells = some.select(group, "n", "p", "left", F.posexplode(F.slice("own", F.col("p") + 1, F.lit(classes))).alias("q", "right")).filter(F.size("right") > 0)
    # of a class and itself a set gives the pairs of one list
    cells = cells.select(group, "n", "p", "q", "left", F.when(F.col("q") > 0, F.col("right")).alias("right"))
    schema = f"`{group}` {kinds[group]}, a {kind}, b {kind}, n long"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n in _cell(batches, at_once, held):
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(n)), pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(n)], names=[group, "a", "b", "n"])

    return cells.repartition(parts, group, "p", "q").groupBy(group, "p", "q").applyInArrow(run, schema)


def _cell(batches: Iterator[pa.RecordBatch], at_once: int, most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(x, y, n) of a cell's pairs, each pair once; rows wait as they came until their pairs are many."""
    held: list[pa.Table] = []
    waiting, limit = 0, most
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).select(["left", "right", "n"]))
        size = pc.list_value_length(batch.column("left")).to_numpy(zero_copy_only=False).astype(np.int64)
        other = pc.fill_null(pc.list_value_length(batch.column("right")), -1).to_numpy(zero_copy_only=False)
        waiting += int(np.where(other < 0, size * (size + 1) // 2, size * other).sum())
        if waiting > limit:
            held = [pa.table({"left": _single(x), "right": _single(y), "n": n}).cast(held[0].schema) for x, y, n in _count(pa.concat_tables(held), at_once)]
            waiting, limit = 0, max(most, sum(map(len, held)))
    yield from _count(pa.concat_tables(held), at_once)


def _single(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1), pa.int32()), values)


def _count(rows: pa.Table, at_once: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Pairs of rows (left, right, n), every member of left with every one of right; with itself and those behind it where right is null."""
    left, right = (pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else rows.column(c).chunk(0) for c in ("left", "right"))
    sizes, others = pc.list_value_length(left).to_numpy(), pc.fill_null(pc.list_value_length(right), 0).to_numpy()
    alone = pc.is_null(right).to_numpy(zero_copy_only=False)
    coded = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    values, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    # each member of left with the stretch of codes that it meets
    x, at = codes[: sizes.sum()], np.arange(sizes.sum())
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.where(alone, np.cumsum(sizes, dtype=np.int64), len(x) + np.cumsum(others, dtype=np.int64))[row]
    starts = np.where(alone[row], at, ends - others[row])
    weights = rows.column("n").to_numpy()[row]
    order = np.argsort(x, kind="stable")
    x, starts, met, weights = x[order], starts[order], (ends - starts)[order], weights[order]
    upto = np.cumsum(met)
    # steps end where the member changes, so each pair is counted in one step
    changes = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x))
    lo = 0
    while lo < len(x):
        hi = changes[np.searchsorted(changes, max(lo + 1, np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once)))]
        n = met[lo:hi]
        place = np.arange(n.sum()) + np.repeat(starts[lo:hi] - (np.cumsum(n) - n), n)
        key = np.repeat(x[lo:hi], n) * len(values) + codes[place]
        by = np.argsort(key, kind="stable")
        key, weight = key[by], np.repeat(weights[lo:hi], n)[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield values.take(pa.array(key[first] // len(values))), values.take(pa.array(key[first] % len(values))), np.add.reduceat(weight, first)
        lo = hi
