import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.llm import audio as A


def test_filters_and_copies():
    text = " ".join(f"w{i * i % 97}" for i in range(120))
    a, b = (A.fingerprint(A.decode_wav(A.render(t))) for t in (text, "x y z " + text))
    assert len(a) and (a == b[3:][: len(a)]).mean() > 0.9
    assert len(A.fingerprint(np.zeros(5000))) and not len(A.fingerprint(np.zeros(100))) and not len(A.decode_wav(b"junk")) and not len(A.decode_wav(None))


def test_alignment(spark):
    rng = random.Random(2)
    song = lambda n: [f"t{rng.randrange(500)}" for _ in range(n)]
    base = song(200)
    rows = [(1, " ".join(base)), (2, " ".join(song(37) + base)), (3, " ".join(base[50:])), (4, " ".join(song(180))), (5, " ".join(base)), (6, None), (7, "one two"), (8, "")]
    rows += [(100 + i, " ".join(base[:150] + song(5))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("print", F.lit(1))
    got = {r.id: r for r in A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()}
    assert len(got) == len(rows)
    assert (got[2].match_id, got[2].offset) == (1, 37) and (got[3].match_id, got[3].offset) == (1, -50) and got[4].match_id is None
    assert (got[5].class_id, got[5].match_id, got[5].offset, got[5].bit_errors) == (1, 1, 0, 0.0)
    assert got[6].match_id is None and got[7].n_codes == 0 and got[1].match_id is None
    # a song with another end may be nearer still to another such song
    assert all(got[100 + i].match_id in {1, *range(100, 100 + i)} and got[100 + i].offset == 0 for i in range(40))
    # the voted offset has the fewest differing bits of all offsets
    a, b = (A.fingerprint(A.decode_wav(A.render(t))) for t in (rows[1][1], rows[0][1]))
    wrong = {}
    for d in range(-len(b) + 8, len(a) - 8):
        x, y = a[max(0, d) : len(b) + d], b[max(0, -d) :]
        n = min(len(x), len(y))
        wrong[d] = np.bitwise_count(x[:n] ^ y[:n]).sum() / 32 / n
    assert min(wrong, key=wrong.get) == 37
    assert A.align(A.fingerprints(A.render_column(df.limit(0), "id", "text"), "id", "media")).count() == 0


def test_links_behind_a_common_passage(spark):
    """Recordings 10 and 11 share all but their ends; 1 to 3, smaller and otherwise different, hold every run they share exactly."""
    rng = random.Random(5)
    song = lambda n: [f"t{rng.randrange(500)}" for _ in range(n)]
    jingle, rest = song(40), song(200)
    noisy = [w if k % 20 else f"t{900 + k}" for k, w in enumerate(rest)]
    rows = [(k, " ".join(song(150) + jingle + song(250))) for k in (1, 2, 3)] + [(10, " ".join(jingle + rest)), (11, " ".join(jingle + noisy)), (20, " ".join(song(150)))]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()}
    codes = {i: A.fingerprint(A.decode_wav(A.render(t))) for i, t in rows}
    want = A.score(codes[11], codes[10], 0)
    assert want[1] <= A.BIT_ERRORS and A.score(codes[10], codes[1], -150)[1] > A.BIT_ERRORS
    assert got[11].match_id == 10 and [m.match_id for m in got[11].matches] == [10] and got[11].bit_errors == want[1] and got[11].votes == want[0]
    assert {i: r.group_id for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 10: 10, 11: 10, 20: 20}
    assert {i: r.passage_group for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20}
    assert got[2].passage_id == 1 and got[2].passage_offset == 0 and got[2].passage_codes >= 18


def test_short_recordings(spark):
    rng = random.Random(7)
    song = lambda n: [f"t{rng.randrange(500)}" for _ in range(n)]
    short, long, tiny = song(26), song(120), song(9)
    rows = [(1, short), (2, short), (3, short[3:]), (4, song(26)), (5, long), (6, long[40:65]), (7, tiny), (8, tiny), (9, tiny[1:]), (10, []), (11, []), (12, ["x"]), (13, ["x"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    got = {r.id: r for r in A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()}
    assert [got[i].class_id for i in (2, 8, 13)] == [1, 7, 12] and [got[i].match_id for i in (2, 8, 13)] == [1, 7, 12] and got[2].offset == 0
    assert (got[3].match_id, got[3].offset, got[3].bit_errors) == (1, -3, 0.0) and (got[6].match_id, got[6].offset) == (5, -40)
    assert all(got[i].match_id is None and got[i].class_id == i for i in (1, 4, 5, 7, 9, 10, 11, 12))


def test_wav_formats():
    def wav(x, size, rate, channels=1):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(size)
            w.setframerate(rate)
            whole = np.repeat(np.rint(x * 256 ** (size - 1)).astype(np.int64), channels) + (128 if size == 1 else 0)
            w.writeframes(whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
        return out.getvalue()

    rng = random.Random(9)
    pitches = [rng.randrange(24) for _ in range(80)]
    tones = lambda rate: np.concatenate([np.round(90 * np.sin(2 * np.pi * A.BASE * 2 ** (p / 12) * np.arange(rate * 64 // 2000) / rate)) for p in pitches])
    plain = A.fingerprint(tones(2000))
    for size in (1, 2, 3, 4):
        assert np.array_equal(A.decode_wav(wav(tones(2000), size, 2000, 2)), tones(2000))
    for rate in (8000, 44100, 48000):
        other = A.fingerprint(A.decode_wav(wav(tones(rate), 2, rate)))
        n = min(len(plain), len(other))
        assert abs(len(other) - len(plain)) <= 3 and np.bitwise_count(plain[:n] ^ other[:n]).mean() / 32 < 0.1
    assert len(A.decode_wav(wav(tones(2000), 2, 2000)[:-1])) == len(tones(2000)) - 1


def test_given_table_against_all_pairs(spark):
    """Every turn of a given table: components equal those of all pairs at all offsets that share a run."""
    sf = "/root/testdata/sf0.001"
    turns = [(r.conv_id * 100_000 + r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    codes = {i: A.fingerprint(A.decode_wav(A.render(t))) for i, t in turns}
    ids = [i for i in codes if len(codes[i]) >= A.OVERLAP]
    places, parent = {}, {i: i for i in ids}
    for i in ids:
        for k in range(len(codes[i]) - A.RUN + 1):
            places.setdefault(tuple(codes[i][k : k + A.RUN].tolist()), []).append((i, k))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    offsets = {(a, b, p - q) for own in places.values() for a, p in own for b, q in own if a > b}
    for a, b, o in offsets:
        s = A.score(codes[a], codes[b], o)
        if s and s[1] <= A.BIT_ERRORS:
            parent[root(a)] = root(b)
    least = {}
    for i in ids:
        least[root(i)] = min(least.get(root(i), i), i)
    got = {r.recording_id: r.group_id for r in A.op7_audio(spark, sf).collect()}
    assert {i: got[i] for i in ids} == {i: least[root(i)] for i in ids}


def test_repeated_and_null_ids(spark):
    rng = random.Random(11)
    song = " ".join(f"t{rng.randrange(500)}" for _ in range(60))
    other = " ".join(f"t{rng.randrange(500)}" for _ in range(60))
    df = spark.createDataFrame([(1, song), (1, song), (2, song), (1, other), (None, song), (None, None), (3, None)], "id long, text string")
    got = sorted(((r.id, r.match_id) for r in A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()), key=str)
    assert len(got) == 7 and (2, 1) in got and (3, None) in got


def test_one_id_of_two_recordings(spark):
    """Rows (5, A) and (5, B) with unlike A and B: what is like A and what is like B are two groups."""
    rng = random.Random(13)
    a, b = ([f"t{rng.randrange(500)}" for _ in range(120)] for _ in range(2))
    rows = [(5, a), (5, b), (7, [*a, "x", "y"]), (8, ["z", *b]), (9, b), (9, a)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    got = A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()
    keys = {r.id: (r.class_key, r.group_key, r.match_id) for r in got if r.id in (7, 8)}
    assert keys[7][1] != keys[8][1] and keys[7][2] == keys[8][2] == 5
    fives, nines = ({(r.class_key, r.group_key) for r in got if r.id == i} for i in (5, 9))
    assert len(fives) == 2 and fives == nines and {g for _, g in fives} == {keys[7][1], keys[8][1]}
    match = {r.id: {m.match_key for m in r.matches} for r in got if r.id in (7, 8)}
    assert not match[7] & match[8] and match[7] | match[8] == {k for k, _ in fives}


def brute_links(codes, opened):
    """{(a, b): (least differing bits with their offset, longest passage with its offset)} of all pairs at all offsets."""
    out = {}
    for a in codes:
        for b in codes:
            if a > b and (opened[a] or opened[b]):
                scored = [(o, s) for o in range(-len(codes[b]), len(codes[a])) if A.good(s := A.score(codes[a], codes[b], o))]
                near = [(s[1], o) for o, s in scored if s[1] <= A.BIT_ERRORS]
                long = [(-s[2], o) for o, s in scored if s[3] <= A.BIT_ERRORS]
                if scored:
                    out[a, b] = (min(near, default=None), min(long, default=None))
    return out


@pytest.mark.parametrize("rows", [3, A.BLOCK_ROWS])
def test_links_are_those_of_all_pairs(spark, monkeypatch, rows):
    """Copies with some words changed, pieces of them, a passage in others, silence, a repeating tune: every pair is measured."""
    monkeypatch.setattr(A, "BLOCK_ROWS", rows)
    rng = random.Random(17)
    song = lambda n: [f"t{rng.randrange(500)}" for _ in range(n)]
    changed = lambda words, share: [w if rng.random() > share else f"x{rng.randrange(500)}" for w in words]
    base, other = song(110), song(60)
    texts = [changed(base, 0.02) for _ in range(9)] + [song(20) + changed(base, 0.01)[:70] for _ in range(4)] + [song(50) + base[30:75] + song(60) for _ in range(4)]
    # ends of one are the start of the other, and a long passage lies elsewhere
    texts += [other + song(40) + base[:34], base[:34] + song(30) + other] + [["a"] * 60, ["a"] * 45 + song(30), ["b", "c", "d"] * 30, ["c", "d", "b"] * 25]
    rng.shuffle(texts)
    codes = {i: A.fingerprint(A.decode_wav(A.render(" ".join(t)))) for i, t in enumerate(texts)}
    opened = {i: i % 3 > 0 for i in codes}
    heads = spark.createDataFrame([(i, c.view(np.int32).tolist(), opened[i]) for i, c in codes.items()], "class_id long, codes array<int>, open boolean")
    want, near, long = brute_links(codes, opened), {}, {}
    for r in A.linked(heads).collect():
        assert A.score(codes[r.a], codes[r.b], r.offset) == (r.votes, r.bit_errors, r.passage, r.passage_errors)
        if r.bit_errors <= A.BIT_ERRORS:
            near[r.a, r.b] = min(near.get((r.a, r.b), (1.0, 0)), (r.bit_errors, r.offset))
        if r.passage_errors <= A.BIT_ERRORS:
            long[r.a, r.b] = min(long.get((r.a, r.b), (0, 0)), (-r.passage, r.offset))
    assert near == {k: n for k, (n, _) in want.items() if n} and long == {k: p for k, (_, p) in want.items() if p}
    assert any(n and p and n[1] != p[1] for n, p in want.values()) and any(p and not n for n, p in want.values())
    # what the recordings are told
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r for r in A.align(A.fingerprints(A.render_column(df, "id", "text"), "id", "media")).collect()}
    want = brute_links(codes, dict.fromkeys(codes, True))
    for i, r in got.items():
        links = {b: n for (a, b), (n, _) in want.items() if a == i and n}
        assert {m.match_id: (m.bit_errors, m.offset) for m in r.matches or []} == links
        assert (r.bit_errors, r.match_id) == min(((n[0], b) for b, n in links.items()), default=(None, None))
        assert (-(r.passage_codes or 0), r.passage_id) == min(((p[0], b) for (a, b), (_, p) in want.items() if a == i and p), default=(0, None))
