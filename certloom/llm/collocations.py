"""Phrases of two to four words whose words keep together, by tiles of pairs counted directly.

*Blocks.* Each task reads its documents into blocks of about half a million words of one language. A block is a sequence of numbers:
each word's place in the block's own list of words, and 0 where a piece of text ends.

*Words.* The numbers of a block are replaced by ranks: what occurs ``min_count`` times in all is numbered by descending frequency,
everything else becomes 0, since no frequent phrase holds a rare part.

*Levels.* Neighbouring ranks form pairs. A pair (left, right) lies in the tile (left // 1024, right // 1024); a tile with many pairs of a block
is counted by one dense bincount over its 1024 x 1024 addresses, pairs of all others as sorted coordinates. Spark adds the blocks' counts.
Then each block ranks its frequent pairs anew and the step is repeated on them: pairs of words that overlap in a word are phrases of three,
and pairs of those are phrases of four. Ranks of phrases hold in one block only; what leaves it is named by the ranks of its words.

*Seen.* Which phrases are frequent comes back to all blocks as a table of bits of one fixed size, not as a row for each block and phrase.
A rare phrase whose place in it is taken goes on to the next level, where its true count drops what holds it; a frequent one is never lost.

*Spark.* A hot word or pair gives one row for each block, however often it occurs, and one for each task after Spark's own partial sums. Nothing is
broadcast whose size grows with the corpus: ranks of words come back to their blocks by number, as far as the block holds them. Ranks are given within each
hash partition of the words and interleaved, not in one task. Each level is a stored table; what the next one does not need is deleted.

*Scores.* Each candidate carries the counts of all its beginnings and ends, so cuts need no further joins. Sums and products are decimals. A
longer phrase that passes 80 % of a candidate's count implies one of just one word more that does, so only those are looked at.

Defined cases: null text counts as empty, null lang as ``und``; repeated rows count each; a document without words gives nothing; very long texts are read
whole; an empty table gives no rows; other columns are not read, whatever their names. Words may hold any character but space, tab and
those at which pieces end; only A to Z are lower-cased. There can be 2^31 frequent words; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import forget
from .common import materialise, slices, text_bytes

MIN_COUNT, TOP, LONGEST = 30, 2000, 4
#: score = floor(SCALE * a / (l + r)); a candidate goes if SHARE[1] * f(longer) >= SHARE[0] * a.
SCALE, SHARE = 2_000_000, (80, 100)
NO_LANGUAGE = "und"
BLOCK_WORDS = 1 << 19
#: Blocks' worth of words that a task holds of all languages together.
HELD_BLOCKS = 4
#: A tile has 2^TILE_BITS ranks on each side; it is counted densely from so many pairs on.
TILE_BITS, DENSE = 10, 1 << 15
#: Bits of the table of frequent phrases, a prime (16 MB).
PLACES = (1 << 27) - 39
#: A phrase's place is the sum of its words' ranks times these, the last word times the last; sums stay below 2^60.
WEIGHTS = (93_563_167, 71_324_449, 119_850_377, 58_217_903)

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + b"\n" * len(_BREAKS))


def _collapsed(ids: np.ndarray) -> np.ndarray:
    """One 0 where several follow each other."""
    return ids[(ids != 0) | np.r_[True, ids[:-1] != 0]] if len(ids) else ids


def _block(chunks: list[pa.Array]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, how often each comes, the block as places in that list from 1 on)."""
    coded = pa.chunked_array(chunks).dictionary_encode().combine_chunks()
    words = coded.dictionary.to_pylist()
    place = np.zeros(len(words), np.int32)
    real = [k for k, w in enumerate(words) if w not in (b"", b"\n")]
    place[real] = np.arange(1, len(real) + 1)
    codes = coded.indices.to_numpy()
    if b"" in words:
        codes = codes[codes != words.index(b"")]
    ids = place[codes]
    return [words[k] for k in real], np.bincount(ids, minlength=len(real) + 1)[1:], _collapsed(ids)


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
_BLOCKS_DDL = "block long, lang string, words array<string>, counts array<long>, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        words, counts, ids = _block(held.pop(lang))
        del sizes[lang]
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts]), pa.array([ids.astype("<i4").tobytes()], pa.binary())], schema=_BLOCKS)
            number += 1

    for batch in slices(batches, 64):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            words = pa.array(b"\n".join([*own, b""]).translate(_PLAIN).replace(b"\n", b" \n ").split(b" "), pa.binary())
            held.setdefault(lang, []).append(words)
            sizes[lang] = sizes.get(lang, 0) + len(words)
            if sizes[lang] >= block_words:
                yield from flush(lang)
        while sum(sizes.values()) >= HELD_BLOCKS * block_words:
            yield from flush(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield from flush(lang)


def count_pairs(ids: np.ndarray, tile_bits: int = TILE_BITS, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """(left << 32 | right, how often) of the pairs of neighbours that are not 0; each pair once."""
    left, right = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    both = (left > 0) & (right > 0)
    left, right = left[both], right[both]
    tile = left >> tile_bits << 32 | right >> tile_bits
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(tile)]
    full = ends - starts >= dense
    keys, counts, sparse = [], [], np.ones(len(tile), bool)
    side = (1 << tile_bits) - 1
    for a, b in zip(starts[full].tolist(), ends[full].tolist()):
        address = (left[a:b] & side) << tile_bits | right[a:b] & side
        table = np.bincount(address, minlength=1 << 2 * tile_bits)
        used = np.flatnonzero(table)
        row, column = int(tile[a]) >> 32 << tile_bits, (int(tile[a]) & 0xFFFFFFFF) << tile_bits
        keys.append(row + (used >> tile_bits) << 32 | column + (used & side))
        counts.append(table[used])
        sparse[a:b] = False
    k, n = np.unique(left[sparse] << 32 | right[sparse], return_counts=True)
    return np.concatenate([*keys, k]), np.concatenate([*counts, n])


def _ids(column: pa.Array) -> Iterator[np.ndarray]:
    for b in column:
        yield np.frombuffer(b.as_buffer(), "<i4")


def _place(words: list) -> object:
    """Where a phrase lies in the table of bits, before the division: of numbers, arrays or columns."""
    return sum(w * WEIGHTS[k - len(words)] for k, w in enumerate(words))


def phrase_counts(ids: np.ndarray, size: int, seen: np.ndarray | None, places: int, tile_bits: int = TILE_BITS, dense: int = DENSE) -> tuple[list[np.ndarray], np.ndarray]:
    """(the phrases' words, an array for each place in the phrase; how often each comes) of a block's phrases of ``size`` words whose parts of one word less are all seen."""
    part = size - 1
    if part == 1:
        keys, counts = count_pairs(ids, tile_bits, dense)
        return [keys >> 32, keys & 0xFFFFFFFF], counts
    words = [ids[k : len(ids) - part + 1 + k].astype(np.int64) for k in range(part)]
    at = np.flatnonzero(np.logical_and.reduce([w > 0 for w in words]))
    words = [w[at] for w in words]
    place = _place(words) % places
    known = seen[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
    at, words = at[known], [w[known] for w in words]
    code = words[0]
    for w in words[1:]:
        _, first, code, n = np.unique(code << 32 | w, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    ranks = np.zeros(max(len(ids) - part + 1, 0), np.int32)
    ranks[at] = rank[code]
    keys, counts = count_pairs(ranks, tile_bits, dense)
    left, right = first[order[(keys >> 32) - 1]], first[order[(keys & 0xFFFFFFFF) - 1]]
    return [w[left] for w in words] + [words[-1][right]], counts


def _counted(batches: Iterator[pa.RecordBatch], size: int, seen: Broadcast | None, places: int, tile_bits: int, dense: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        words, counts = phrase_counts(next(_ids(batch.column("ids"))), size, seen and seen.value, places, tile_bits, dense)
        a, b, c, d = [np.zeros(len(counts), np.int64)] * (LONGEST - size) + words
        high, low = a << 32 | b, c << 32 | d
        for at in range(0, len(counts), 100_000):
            own = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(high[own]), pa.array(low[own]), pa.array(counts[own])], names=["high", "low", "n"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ranks of their words, found by the word's place in the block."""
    for batch in slices(batches, 1):
        ids = next(_ids(batch.column("ids")))
        found = batch.column("found")[0]
        if not found.is_valid:
            continue
        slot, rank = (found.values.field(k).to_numpy() for k in (0, 1))
        table = np.zeros(max(int(ids.max(initial=0)), int(slot.max())) + 1, np.int64)
        table[slot] = rank
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([_collapsed(table[ids]).astype("<i4").tobytes()], pa.binary())], names=["block", "ids"])


def _with_ids(batches: Iterator[pa.RecordBatch], key: list[str], parts: int) -> Iterator[pa.RecordBatch]:
    """Numbers the words of one partition that is ordered by descending frequency: the k-th of partition p is k * parts + p + 1."""
    own, last, rank = TaskContext.get().partitionId(), None, -1
    if own >= parts:
        raise ValueError("more partitions than were asked for")
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in map(batch.column, key):
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        first, new_last = (tuple(batch.column(c)[i].as_py() for c in key) for i in (0, batch.num_rows - 1))
        new[0], last = first != last, new_last
        ranks = rank + np.cumsum(new)
        rank = int(ranks[-1])
        if rank * parts + own + 1 >= 1 << 31:
            raise ValueError("more than 2^31 frequent words")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((ranks * parts + own + 1).astype(np.int32))], names=[*batch.schema.names, "id"])


def frequent(rows: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """(block, key, slot, f, id) of the words that occur ``min_count`` times in all. Words are dealt to partitions by hash and ranked by frequency
    within each; the partitions' ranks are interleaved, so that small ids are frequent words, and no rank needs all words in one place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.sum("n").over(Window.partitionBy(*key))
    counted = rows.repartition(parts, *key).withColumn("f", total).filter(F.col("f") >= min_count)
    kept = counted.select("block", *key, "slot", "f").sortWithinPartitions(F.desc("f"), *key)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(lambda it: _with_ids(it, key, parts), ddl + ", id int")


def _words(blocks: DataFrame, rows: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(the frequent words with their ids, stored; the blocks in those ids, stored)."""
    found = materialise(frequent(rows, ["lang", "word"], min_count), "ranks-found")
    units = materialise(found.groupBy("lang", "word", "id").agg(F.first("f").alias("f")), "ranks-units")
    mapping = found.groupBy("block").agg(F.collect_list(F.struct(F.col("slot").alias("unit"), "id")).alias("found"))
    new = materialise(blocks.select("block", "ids").join(mapping, "block").mapInArrow(_ranked, "block long, ids binary"), "ranks")
    forget(found)
    return units, new


def _members(size: int) -> list[Column]:
    """The ranks of a counted phrase's words."""
    return [half for c in ("high", "low") for half in (F.shiftright(c, 32), F.col(c).bitwiseAND(0xFFFFFFFF))][LONGEST - size :]


def _seen(units: DataFrame, size: int, places: int) -> Broadcast:
    """The table of bits with the places of all units set; its size does not depend on them."""
    place = F.pmod(_place(_members(size)), F.lit(places)) + 1  # Spark's bitmaps begin at 1
    maps = units.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    length = len(maps[0].bits) if maps else 1
    table = np.zeros(max([places // 8 + 1, *(m.number * length for m in maps)]), np.uint8)
    for m in maps:
        table[(m.number - 1) * length : m.number * length] = np.frombuffer(m.bits, np.uint8)
    return units.sparkSession.sparkContext.broadcast(table)


def _phrases(units: DataFrame, size: int, parts: DataFrame) -> DataFrame:
    """Counted phrases with what they are made of, from the level before; an id is the list of the words' ranks."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "heads")
    right = parts.select(F.col("id").alias("right"), F.col("last"), "tails")
    named = units.select(F.array(_members(size)).alias("id"), F.array(_members(size)[:-1]).alias("left"), F.array(_members(size)[1:]).alias("right"), "f")
    both = named.join(left, "left").join(right, "right")
    one = F.array("f")
    return both.select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails"))


def _scored(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Candidates of one level that no longer phrase contains too often: (lang, phrase, a, l, r, score)."""
    wide = "decimal(20, 0)"
    if longer is not None:
        above = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("above"))
        level = level.join(above, "id", "left").filter(F.col("above").isNull() | (F.col("above").cast(wide) * SHARE[1] < F.col("f").cast(wide) * SHARE[0]))
    cut = f"""array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
        'score', {SCALE} * cast(f as {wide}) div (cast(heads[k - 1] as {wide}) + tails[size(heads) - k - 1]), 'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))"""
    return level.withColumn("cut", F.expr(cut)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, block_words: int = BLOCK_WORDS, tile_bits: int = TILE_BITS, dense: int = DENSE, places: int = PLACES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    blocks = materialise(rows.mapInArrow(lambda it: _blocks(it, block_words), _BLOCKS_DDL), "blocks")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("slot", "w")).select("block", "lang", (F.col("slot") + 1).alias("slot"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    units, ids = _words(blocks, words, min_count)
    forget(blocks)
    counts = F.array("f")
    levels = [units.select(F.array(F.col("id").cast("long")).alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", counts.alias("heads"), counts.alias("tails"))]
    seen = None
    for size in range(2, LONGEST + 1):
        counted = ids.mapInArrow(lambda it: _counted(it, size, seen, places, tile_bits, dense), "high long, low long, n long")
        units = materialise(counted.groupBy("high", "low").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count), f"units-{size}")
        if seen:
            seen.destroy()
        seen = _seen(units, size, places) if size < LONGEST else None
        levels.append(materialise(_phrases(units, size, levels[-1]), f"level-{size}"))
    forget(ids)
    scored = None
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        own = _scored(level, longer)
        scored = own if scored is None else scored.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
