"""Late rows, bounded keys and a throttled feed: micro-batches held against plain Python, tried again, folded and restarted."""

import json
import random
from collections import Counter

import pytest

from certloom.streaming import partials
from certloom.streaming.bounded import RecentKeys, Throttle
from certloom.streaming.sightings import Sightings


def test_partials_fold(spark, tmp_path):
    kept = partials.Partials(spark, str(tmp_path / "p"), "k string, n bigint", partials.sums(["k"], "n"), fold=3)
    assert kept.read().count() == 0
    for n in range(11):
        rows = spark.createDataFrame([("a", 1), ("b", n), (None, 2)], "k string, n bigint")
        kept.put(rows, n)
        kept.put(rows, n)  # tried again
        assert {r.k: r.n for r in kept.read().collect()} == {"a": n + 1, "b": n * (n + 1) // 2, None: 2 * (n + 1)}
        assert {r.k: r.n for r in kept.read(n).collect()}.get("a", 0) == n
    assert kept._numbers("folded") == [6, 9] and min(kept._numbers("batch")) == 6


def test_late_rows(spark, tmp_path):
    rng = random.Random(5)
    kept = Sightings(spark, str(tmp_path / "s"), width_us=10, delay_us=25, fold=2)
    ends, hours, newest = {}, Counter(), None
    for n in range(5):
        rows = [(rng.choice(["a", "b", None, "n%d" % n]), rng.randrange(max(0, 60 * n - 90), 60 * n + 60)) for _ in range(40)] + [("x", None)]
        for name, us in rows:
            if us is None:
                continue
            late = newest is not None and us // 10 * 10 + 10 <= newest - 25
            if name is not None:
                lo, hi, k = ends.get(name, (us, us, 0))
                ends[name] = (min(lo, us), max(hi, us), k + late)
            if not late:
                hours[us // 10 * 10] += 1
        newest = max([us for _, us in rows if us is not None] + [newest or 0])
        batch = spark.createDataFrame(rows, "name string, us bigint")
        for _ in range(1 + (n == 3)):  # one batch is tried again
            kept.add(batch, n)
    assert {r.name: (r.first_us, r.last_us, r.late) for r in kept.index().collect()} == ends
    assert {r.window_us: r.n for r in kept.windows().collect()} == hours
    assert sum(k for _, _, k in ends.values()) > 10
    kept.add(spark.createDataFrame([], "name string, us bigint"), 5)
    assert kept.index().count() == len(ends)


def test_one_stream_splits_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def turn(k, rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"name": n, "us": t}) for n, t in rows))
        kept = Sightings(spark, str(tmp_path / "s"), width_us=10, delay_us=10)  # a new process
        kept.follow(spark.readStream.schema("name string, us bigint").json(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
        return {r.name: (r.first_us, r.last_us, r.late) for r in kept.index().collect()}, {r.window_us: r.n for r in kept.windows().collect()}

    turn(0, [("a", 100), ("b", 105)])
    # the watermark is 95: 91 still has its window (90 to 100) open, 85 has not
    assert turn(1, [("a", 91), ("b", 85), ("c", 10)]) == ({"a": (91, 100, 0), "b": (85, 105, 1), "c": (10, 10, 1)}, {100: 2, 90: 1})


def test_recent_keys(spark, tmp_path):
    rng = random.Random(7)
    kept, known, want = RecentKeys(spark, str(tmp_path / "r"), capacity=12), {}, set()
    for n in range(6):
        rows = [(rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), 100 * n + rng.randrange(100)) for _ in range(18)] + [("late", 3), ("none", None)]
        by = {}
        for k, us in rows:
            if us is not None:
                by.setdefault(k, []).append(us)
        want |= {(k, min(v), n) for k, v in by.items() if k not in known}
        for k, v in by.items():
            known[k] = max([*v, known.get(k, 0)])
        known = dict(sorted(known.items(), key=lambda e: (-e[1], e[0] or ""))[:12])
        batch = spark.createDataFrame(rows, "key string, us bigint")
        for _ in range(1 + (n in (0, 4))):
            kept.add(batch, n)
        assert {r.key: r.last for r in kept.state().collect()} == known
    assert {tuple(r) for r in kept.rows().collect()} == want
    assert len(kept._batches()) == 2  # older states are deleted
    assert Counter(k for k, _, _ in want).most_common(1)[0][1] > 1  # forgotten keys come again


@pytest.mark.parametrize("limit", [3, 20])
def test_throttle(spark, tmp_path, limit):
    rng = random.Random(limit)
    kept, taken, want, idx = Throttle(spark, str(tmp_path / "t"), limit), Counter(), set(), 0
    assert kept.rows().count() == 0
    for n in range(4):
        rows = []
        for _ in range(90):
            idx += 1
            rows.append((idx, rng.randrange(5_000_000) if rng.random() > 0.02 else None, rng.choice([True, False, False, False, None])))
        for second in range(5):
            own = sorted((r for r in rows if r[1] is not None and r[1] // 1_000_000 == second), key=lambda r: (r[1], r[0]))
            first, others = [r for r in own if r[2]], [r for r in own if not r[2]]
            room = max(0, limit - taken[second] - len(first))
            given = first + others[:room]
            taken[second] += len(given)
            want |= {r[0] for r in given}
        batch = spark.createDataFrame(rows, "idx bigint, us bigint, candidate boolean")
        for _ in range(1 + (n == 2)):
            kept.add(batch, n)
    got = [r.idx for r in kept.rows().collect()]
    assert len(got) == len(set(got)) and set(got) == want
