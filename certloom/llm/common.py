"""Helpers shared by the corpus operators: Arrow batches, word hashes; shared storage is the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from ..functions.storage import materialise, shared_dir  # noqa: F401

#: Documents that one step inside a task handles together; bounds a task's memory.
DOCS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = DOCS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S, _T = np.uint64(32), np.uint64(29)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of each pair (a, b)."""
    x = a * _A + (b ^ (b >> _T)) * _B
    x ^= x >> _S
    x *= _A
    return x ^ (x >> _T)


def window_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive items, by doubling: O(n log length), whatever the window."""
    if len(items) < length:
        return np.zeros(0, np.uint64)
    n, power, size, out, done = len(items) - length + 1, items, 1, None, 0
    while True:
        if length & size:
            part = power[done : done + n]
            out = part if out is None else mix(out, part)
            done += size
        if done == length:
            return out
        power = mix(power[:-size], power[size:])
        size *= 2


class Memo:
    """A function of a string, remembered for the strings met so far; emptied when full, so its memory is bounded."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        self.fn, self.limit, self.known = fn, limit, {}

    def map(self, keys: list) -> list:
        known = self.known
        try:
            return [known[k] for k in keys]
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        fn = self.fn
        for k in keys:
            if k not in known:
                known[k] = fn(k)
        return [known[k] for k in keys]
