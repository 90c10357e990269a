"""Chroma fingerprints of audio columns, and their alignment.

*Fingerprint.* Frames of a recording give energies of the twelve pitch classes, smoothed over five frames and scaled.
Over this image of time and pitch class, sixteen filters compare sums of rectangles, read from an integral image; each
comparison falls in one of four grades (two bits, Gray code), so every position has one packed 32-bit integer.

*Short recordings.* A second row of integers has filters of at most four frames. Recordings with fewer than eight integers of
the first kind are aligned by the second, with each other and with longer ones. Those with fewer than eight of either (less than 18 tones here)
are classes of equal samples only.

*Alignment.* Runs of three integers are looked up among all recordings. Those of a run are compared with each other in blocks, wherever a stretch of equal codes
starts with it; a pair is scored at each offset once, at its first equal run. A *link* has few differing bits over the whole overlap; a *passage* is the stretch of the overlap
with most equal runs (gaps of at most eight codes) and few differing bits, whatever the rest is. All pairs that share a run are measured, at every
offset: ``matches`` (at the later recording) has all links, ``match_id`` and ``passage_id`` are the best of all pairs. The work is thus
quadratic in a group of unlike copies, in tasks of bounded size. Recordings with the same fingerprint are one class and are aligned once.

The query renders each turn of ``conversations`` as a recording (a word is a tone of one hop, its pitch from the word's
hash), as the tables hold no audio; WAV bytes go through the same media column as any other.

Defined cases: WAV is PCM of 8 to 32 bits at any rate, resampled to 2,000 Hz; null, empty or undecodable media match nothing; repeated rows are copies at offset 0; an id with several recordings is each of them (keys tell them apart); ties go to fewer differing bits, then to the smaller recording;
silence has all energies 0; a null id is kept and matches nothing; an empty table gives no rows; a very long recording is fingerprinted alone and whole;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.graph import components
from .common import materialise, slices

RATE, FRAME, HOP = 2000, 128, 32
#: Lowest pitch (C4) and the range of bins that count.
BASE, LOWEST, HIGHEST = 261.63, 240.0, 960.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
RUN, VOTES, BIT_ERRORS, OVERLAP = 3, 4, 0.25, 8
GRADE = 0.25
#: Recordings of a run that are compared with each other, or with as many others, in one task.
BLOCK_ROWS = 256
#: Pairs that one task compares, of all its blocks.
PAIRS_A_TASK = 250_000
#: Stands before a recording's first code; codes have 32 bits.
NO_CODE = 1 << 40


def filters(widths: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of sixteen filters: every kind at several places and widths."""
    return [(k % 6, (5 * k) % 9, 2 + k % 3 if (5 * k) % 9 + 2 + k % 3 <= 12 else 2, widths[k % 4]) for k in range(16)]


FILTERS, FINE = filters((4, 8, 12, 16)), filters((2, 3, 4, 4))
SPAN = max(w for *_, w in FILTERS)
#: Samples after which recordings are put through the filters, together with the one that exceeds it.
SAMPLES_AT_ONCE = 1_000_000


def chroma_weights() -> np.ndarray:
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), 12))
    for k, f in enumerate(freq):
        if LOWEST <= f <= HIGHEST:
            out[k, int(round(12 * np.log2(f / BASE))) % 12] = 1
    return out


WEIGHTS, HANN = chroma_weights(), np.hanning(FRAME)


def chromas(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """(frames, 12) smoothed, unit-length energies of each recording, all recordings laid end to end."""
    counts = np.array([max(0, (len(p) - FRAME) // HOP + 1) for p in recordings], np.int64)
    blocks = -(-np.array([len(p) for p in recordings], np.int64) // HOP)
    first = np.cumsum(blocks) - blocks
    signal = np.zeros(int(blocks.sum()) * HOP + FRAME)
    for p, at in zip(recordings, first * HOP):
        signal[at : at + len(p)] = p
    at = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    power = np.zeros((len(at), 12))
    for k in range(0, len(at), 2048):
        found = np.fft.rfft(frames[at[k : k + 2048]] * HANN, axis=1)
        power[k : k + 2048] = (found.real * found.real + found.imag * found.imag) @ WEIGHTS
    # smoothing runs over the borders of recordings; the positions there are dropped
    kept = np.maximum(0, counts - len(SMOOTH) + 1)
    n = max(0, len(power) - len(SMOOTH) + 1)
    image = sum((s * power[k : n + k] for k, s in enumerate(SMOOTH)), np.zeros((n, 12)))
    image = image[np.arange(int(kept.sum())) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(kept) - kept), kept)]
    norm = np.sqrt((image * image).sum(axis=1, keepdims=True))
    # multiples of 2**-24, so that sums of rectangles are exact and do not depend on what stands before
    image = np.rint(np.divide(image, norm, out=np.zeros_like(image), where=norm > 1e-9) * 2.0**24) / 2.0**24
    return np.split(image, np.cumsum(kept)[:-1])


def chroma(pcm: np.ndarray) -> np.ndarray:
    return chromas([np.asarray(pcm, np.float64)])[0]


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each position of the widest filter."""
    return coded([chroma(pcm)], FILTERS)[0]


def coded(images: list[np.ndarray], filters: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """The packed integers of each image. The filters run over all images laid end to end; positions at borders are dropped."""
    span = max(w for *_, w in filters)
    sizes = np.array([len(i) for i in images], np.int64)
    counts = np.maximum(0, sizes - span + 1)
    image = np.concatenate(images)
    n = max(0, len(image) - span + 1)
    total = np.zeros((13, len(image) + 1))
    total[1:, 1:] = image.T.cumsum(axis=1).cumsum(axis=0)
    known: dict[tuple[int, int], np.ndarray] = {}

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        if (y0, y1) not in known:
            known[y0, y1] = total[y1] - total[y0]
        return known[y0, y1][t1 : t1 + n] - known[y0, y1][t0 : t0 + n]

    out, low, high = np.zeros(n, np.uint32), np.exp(-GRADE), np.exp(GRADE)
    for k, (kind, y, h, w) in enumerate(filters):
        t2, y2, t3, y3 = w // 2, y + h // 2, max(1, w // 3), y + max(1, h // 3)
        whole = area(0, w, y, y + h)
        if kind == 0:
            a, b = whole, area(0, w, 0, 12) / 12 * h
        elif kind == 1:
            a, b = area(0, w, y2, y + h), area(0, w, y, y2)
        elif kind == 2:
            a, b = area(t2, w, y, y + h), area(0, t2, y, y + h)
        elif kind == 3:
            a = area(0, t2, y2, y + h) + area(t2, w, y, y2)
            b = whole - a
        elif kind == 4:
            a = area(0, w, y3, y + h - (y3 - y)) if h > 2 else area(0, w, y, y2)
            b = whole - a
        else:
            a = area(t3, w - t3, y, y + h)
            b = whole - a
        # the grade of log((1 + a) / (1 + b)) among -GRADE, 0 and GRADE, as two bits: 00, 01, 11, 10
        a, b = 1 + a, 1 + b
        top = a > b
        out |= ((a > low * b) & ~(a > high * b)).astype(np.uint32) << np.uint32(2 * k)
        out |= top.astype(np.uint32) << np.uint32(2 * k + 1)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.split(out[at], np.cumsum(counts)[:-1])


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """The signal at RATE: below half of RATE by a windowed sinc, then between neighbouring samples."""
    if rate == RATE or not len(x):
        return x
    at = np.arange(int(len(x) * RATE // rate)) * (rate / RATE)
    if rate < RATE:
        return np.interp(at, np.arange(len(x)), x)
    half = int(np.ceil(8 * rate / RATE))
    taps = np.sinc(np.arange(-half, half + 1) * 0.9 * RATE / rate) * np.hamming(2 * half + 1)
    taps /= taps.sum()
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (half, half + 1)), 2 * half + 1)
    out = np.zeros(len(at))
    for k in range(0, len(at), 1024):
        low = at[k : k + 1024].astype(np.int64)
        part = at[k : k + 1024] - low
        out[k : k + 1024] = (windows[low] @ taps) * (1 - part) + (windows[low + 1] @ taps) * part
    return out


def decode_wav(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE of PCM WAV bytes of 8, 16, 24 or 32 bits, as multiples of 8-bit steps; none if they are no such file."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            size, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
            raw = raw[: len(raw) // (size * channels) * size * channels]
            if size == 3:
                wide = np.zeros((len(raw) // 3, 4), np.uint8)
                wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
                raw, size = wide.tobytes(), 4
            x = np.frombuffer(raw, {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[size]).astype(np.float64)
            x = x - 128 if size == 1 else x / 256 ** (size - 1)
            x = x if channels == 1 else x.reshape(-1, channels).mean(axis=1)
            return resampled(x, rate) if rate > 0 else np.zeros(0)
    except (wave.Error, EOFError, KeyError, ZeroDivisionError):
        return np.zeros(0)


def encode_wav(pcm: np.ndarray) -> bytes:
    """A mono WAV file of 8 bits at RATE."""
    data = pcm.astype(np.uint8).tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data))
    return head + data


TONES = np.stack([np.round(128 + 90 * np.sin(2 * np.pi * BASE * 2 ** (p / 12) * np.arange(HOP) / RATE)) for p in range(24)]).astype(np.uint8)


def render(text: str | None) -> bytes:
    """A recording of a text: one tone for each word."""
    words = (text or "").encode().split()
    return encode_wav(TONES[[zlib.crc32(w) % len(TONES) for w in words]].ravel() if words else np.zeros(0))


def render_column(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "media"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, media binary")


def fingerprints(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, codes array<int>, fine array<int>, digest) of each row's WAV bytes; the digest is null where there are no samples."""
    kind = rows.schema[id_col].dataType.simpleString()

    def encoded(media: list[bytes | None]) -> Iterator[tuple]:
        held, samples = [], 0
        for k, m in enumerate(media):
            held.append(decode_wav(m))
            samples += len(held[-1])
            if samples > SAMPLES_AT_ONCE or k == len(media) - 1:
                images = chromas(held)
                yield from zip(coded(images, FILTERS), coded(images, FINE), [xxhash.xxh3_128_digest(p.tobytes()) if len(p) else None for p in held])
                held, samples = [], 0

    def lists(codes: tuple[np.ndarray, ...]) -> pa.Array:
        ends = np.cumsum([0] + [len(c) for c in codes])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes).view(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, fine, digests = zip(*encoded(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(codes), lists(fine), pa.array(digests, pa.binary())], names=["id", "codes", "fine", "digest"])

    return rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, codes array<int>, fine array<int>, digest binary")


def score(a: np.ndarray, b: np.ndarray, offset: int, first: int | None = None) -> tuple | None:
    """(votes, bit errors of the overlap, codes and bit errors of the passage) where b's first code lies at ``offset`` of a. With ``first``
    only if the first equal run lies there in a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi - lo < OVERLAP:
        return None
    bits = np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset])
    same = bits == 0
    at = np.flatnonzero(np.logical_and.reduce([same[k : len(same) - RUN + 1 + k] for k in range(RUN)]))
    if len(at) < VOTES or first not in (None, lo + at[0]):
        return None
    gaps = np.flatnonzero(at[1:] - at[:-1] > OVERLAP)
    best = max(np.split(at, gaps + 1), key=len) if len(gaps) else at
    passage = bits[best[0] : best[-1] + RUN]
    errors = passage.sum() / (32 * len(passage)) if len(best) >= VOTES else 1.0
    return len(at), float(bits.sum() / (32 * (hi - lo))), len(passage), float(errors)


def good(s: tuple | None) -> bool:
    return s is not None and (s[1] <= BIT_ERRORS or s[3] <= BIT_ERRORS)


def code_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    return np.split(whole.flatten().to_numpy().view(np.uint32), np.cumsum(pc.list_value_length(whole).to_numpy())[:-1])


def offsets(p: np.ndarray, q: np.ndarray) -> dict[int, int]:
    """The offsets between places of two recordings, each with the first place in the one on the left that has it; places are sorted."""
    if len(p) == len(q) == 1:
        return {int(p[0] - q[0]): int(p[0])}
    out: dict[int, int] = {}
    for k in range(0, len(p), 1024):
        part = p[k : k + 1024]
        found, first = np.unique(part[:, None] - q[None, :], return_index=True)
        for o, at in zip(found.tolist(), part[first // len(q)].tolist()):
            out.setdefault(o, at)
    return out


def _link_block(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Verified pairs among one block's recordings, at the offsets whose first equal run is the block's: the offset with fewest differing bits
    and that with the longest passage, of each pair; only links leave the task."""
    block = table.column("block")[0].as_py()
    ids, opened, side, before = (table.column(c).to_numpy() for c in ("class_id", "open", "side", "before"))
    codes, places = code_lists(table.column("codes")), [np.array(p, np.int64) for p in table.column("at").to_pylist()]
    # behind equal codes nothing starts; nothing stands before a recording's first run, which is NO_CODE
    wanted = (ids[:, None] > ids[None, :]) & (opened[:, None] | opened[None, :]) & ((before[:, None] != before[None, :]) | (before == NO_CODE)[:, None])
    if block["kind"] == "main" or block["i"] != block["j"]:
        wanted &= side[:, None] != side[None, :]
    found: dict[tuple[int, int], list[tuple]] = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(wanted))):
        own = [(o, s) for o, p in offsets(places[i], places[j]).items() if good(s := score(codes[i], codes[j], o, p))]
        if own:
            found.setdefault((int(ids[i]), int(ids[j])), []).extend(own)
    out = []
    for (a, b), scored in found.items():
        near = min((x for x in scored if x[1][1] <= BIT_ERRORS), key=lambda x: (x[1][1], x[0]), default=None)
        long = max((x for x in scored if x[1][3] <= BIT_ERRORS), key=lambda x: (x[1][2], -x[0]), default=None)
        out += [(a, b, o, *s) for o, s in filter(None, [near, long if long != near else None])]
    columns = zip(*out) if out else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def linked(heads: DataFrame) -> DataFrame:
    """(a, b, offset, votes, bit_errors, passage, passage_errors): verified pairs of classes (class_id, codes, open), a the larger, where one is open
    at least: all of them, each with its offset of fewest differing bits and that of its longest passage, perhaps with others.

    Two recordings of a run are compared where a stretch of equal codes starts, so where other codes stand before. Each run's recordings go in blocks;
    those behind its most frequent code are only compared with the rest. Each recording of a run is moved once for every BLOCK_ROWS that it is compared with."""
    kind = heads.schema["class_id"].dataType.simpleString()
    columns = f"a {kind}, b {kind}, offset int, votes int, bit_errors double, passage int, passage_errors double"
    schema = to_arrow_schema(StructType.fromDDL(columns))
    at = F.explode(F.sequence(F.lit(1), F.size("codes") - RUN + 1))
    runs = heads.select("class_id", "codes", "open", at.alias("pos"))
    before = F.when(F.col("pos") > 1, F.get("codes", F.col("pos") - 2).cast("long")).otherwise(NO_CODE)
    runs = runs.select("class_id", "open", "pos", before.alias("before"), F.xxhash64(F.slice("codes", F.col("pos"), RUN)).alias("key"))
    # most runs occur once: they are counted by their key alone before anything else is moved
    shared = materialise(runs.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("open").alias("any")).filter("n > 1 and any").select("key"), "shared")
    runs = runs.join(shared, "key")
    places = materialise(runs.groupBy("key", "before", "class_id", "open").agg(F.array_sort(F.collect_list(F.col("pos") - 1)).alias("at")), "places")
    parts = places.groupBy("key", "before").agg(F.count("*").alias("n"), F.min("class_id").alias("least"), F.max("class_id").alias("most"))
    sizes = parts.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("all"), F.max(F.when(F.col("before") != NO_CODE, F.struct("n", "before"))).alias("main"))
    sizes = sizes.filter("least < most").select("key", "all", F.col("main.before").alias("main"), F.coalesce("main.n", F.lit(0)).alias("n")).filter("all > n")
    count = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    rests = F.col("all") - F.col("n")
    mixed = materialise(sizes.select("key", "all", "main", count(F.col("n")).alias("mains"), count(rests).alias("rests"), (rests * (F.col("n") + rests / 2)).alias("pairs")), "mixed")
    tasks = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((mixed.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_A_TASK) + 1)
    bucket = lambda n: F.pmod(F.xxhash64("class_id", F.lit(3)), n).cast("int")
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    up = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    rest, main = bucket(F.col("rests")), bucket(F.greatest("mains", F.lit(1)))
    of_rest = F.concat(F.transform(up(F.col("rests")), lambda j: block("rest", F.least(rest, j), F.greatest(rest, j))), F.transform(up(F.col("mains")), lambda m: block("main", m, rest)))
    of_main = F.transform(up(F.col("rests")), lambda r: block("main", main, r))
    is_main = F.coalesce(F.col("before") == F.col("main"), F.lit(False))
    blocks = F.when(F.col("all") <= BLOCK_ROWS, F.array(block("all", F.lit(0), F.lit(0)))).when(is_main, of_main).otherwise(of_rest)
    dealt = places.join(mixed, "key").select("key", "class_id", "open", "before", "at", F.when(is_main, -1).otherwise(rest).alias("side"), F.explode(blocks).alias("block"))
    rows = dealt.join(heads.select("class_id", "codes"), "class_id")
    return materialise(rows.repartition(tasks, "key", "block").groupBy("key", "block").applyInArrow(lambda t: _link_block(t, schema), columns), "links")


def align(prints: DataFrame) -> DataFrame:
    """(id, n_codes, class_id, match_id, offset, votes, bit_errors, matches, group_id, passage_id, passage_offset, passage_codes,
    passage_group, class_key, group_key, passage_key): the best earlier recording each one is verified against, all verified earlier ones of
    its class, the longest passage shared with an earlier one, and the components of both kinds of links. Classes are told apart by their
    fingerprints: where an id stands for several recordings, ``class_id`` and the like name it, and the keys say which one is meant."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long, some = F.size("codes") >= OVERLAP, F.size("fine") >= OVERLAP
    named = lambda kind, name: F.concat(F.lit(kind), name.cast("string"))
    name = F.when(long, named("codes ", F.xxhash64("codes", F.size("codes")))).when(some, named("fine ", F.xxhash64("fine", F.size("fine")))).otherwise(named("samples ", F.hex("digest")))
    prints = materialise(prints.select("id", "codes", "fine", name.alias("print")), "prints")
    usable = prints.filter("print is not null and id is not null")
    heads = usable.groupBy("print").agg(F.min("id").alias("head_id"), F.first("codes").alias("codes"), F.first("fine").alias("fine"))
    # class_id: a number for each class, in order of its smallest id
    heads = materialise(heads.repartitionByRange(parts, "head_id", "print").sortWithinPartitions("head_id", "print").withColumn("class_id", F.monotonically_increasing_id()), "heads")
    links = linked(heads.filter(long).select("class_id", "codes", F.lit(True).alias("open")))
    # short ones among themselves and within longer ones
    fine = linked(heads.filter(some).select("class_id", F.col("fine").alias("codes"), (~long).alias("open")))
    return described(prints, heads, materialise(links.union(fine), "links"))


def described(prints: DataFrame, heads: DataFrame, links: DataFrame) -> DataFrame:
    """The result rows of classes (print, class_id, head_id) and their links; numbers of classes give way to ids."""
    named = lambda column, name: heads.select(F.col("class_id").alias(column), F.col("head_id").alias(name))
    links = links.join(named("b", "match_id"), "b")
    whole = links.filter(F.col("bit_errors") <= BIT_ERRORS)
    one = whole.groupBy("a", "b").agg(F.min(F.struct("bit_errors", "match_id", "offset", "votes", F.col("b").alias("match_key"))).alias("m"))
    chosen = one.groupBy(F.col("a").alias("class_id")).agg(F.min("m").alias("m"), F.array_sort(F.collect_list("m")).alias("matches"))
    shared = links.filter(F.col("passage_errors") <= BIT_ERRORS).groupBy(F.col("a").alias("class_id")).agg(F.min(F.struct((-F.col("passage")).alias("back"), F.col("match_id").alias("passage_id"), "offset")).alias("p"))
    label = lambda edges, key, name: components(edges).select(F.col("node").alias("class_id"), F.col("label").alias(key)).join(named(key, name), key)
    found = heads.select("print", "class_id", "head_id").join(chosen, "class_id", "left").join(shared, "class_id", "left")
    found = found.join(label(whole, "group_key", "group_id"), "class_id", "left").join(label(links, "passage_key", "passage_group"), "class_id", "left")
    out = prints.select("id", "print", F.size("codes").alias("n_codes")).join(materialise(found, "matches"), "print", "left")
    own = F.coalesce("head_id", "id")
    copy = F.col("id") != F.col("head_id")
    pick = lambda same, field: F.when(copy, same).otherwise(F.col(f"m.{field}"))
    return out.select(
        "id", F.col("n_codes").cast("long").alias("n_codes"), own.alias("class_id"), pick(F.col("head_id"), "match_id").alias("match_id"),
        pick(F.lit(0), "offset").cast("long").alias("offset"), F.when(~copy, F.col("m.votes")).cast("long").alias("votes"), pick(F.lit(0.0), "bit_errors").alias("bit_errors"),
        F.when(~copy, F.col("matches")).alias("matches"), F.coalesce(F.col("group_id"), own).alias("group_id"), F.col("p.passage_id").alias("passage_id"),
        F.col("p.offset").cast("long").alias("passage_offset"), (-F.col("p.back")).cast("long").alias("passage_codes"), F.coalesce(F.col("passage_group"), own).alias("passage_group"),
        F.col("class_id").alias("class_key"), F.coalesce("group_key", "class_id").alias("group_key"), F.coalesce("passage_key", "class_id").alias("passage_key"),
    )


def op7_audio(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text")
    return align(fingerprints(render_column(turns, "id", "text"), "id", "media")).withColumnRenamed("id", "recording_id")
