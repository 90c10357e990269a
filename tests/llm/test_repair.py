import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from certloom.llm import repair

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """The contract's damage, one row after another."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], hashlib.sha256(row[3].encode()).digest())


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(WHITE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_edits(rows, found):
    """Shortest path over (row, state), one row and one edit at a time: (cost, audit, repaired rows)."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for p, (c, a, out) in list(states.items()):
                for r in "ua":
                    if (p, r) in moves:
                        new = (c + 5, a + "I", [*out, (names[r], "")])
                        q = moves[p, r]
                        if q not in states or new[:2] < states[q][:2]:
                            states[q] = new
        return states

    states = inserted({0: (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found):
        after = {}

        def put(q, value):
            if q not in after or value[:2] < after[q][:2]:
                after[q] = value

        for p, (c, a, out) in states.items():
            put(p, (c + 2, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            c += 5 * (fault == "truncated")
            for (state, r), q in moves.items():
                if state == p and role[:1] == r:
                    put(q, (c, a + "K", [*out, (role, text)]))
                if state == p and r in names:
                    put(q, (c + 1, a + "R", [*out, (names[r], text)]))
        states = inserted(after)
    return min((states[q] for q in (0, 3) if q in states), key=lambda x: x[:2])


def report(rows):
    rows = sorted(rows, key=order)
    found = faults(rows)
    turns = {r[1] for r in rows} - {None}
    cost, audit, out = best_edits(rows, found)
    roles = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(found.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def all_edits(kinds):
    """Least (cost, audit) by trying every sequence of edits with up to two insertions at each place."""
    between = ["", "u", "a", "ua", "au"]
    best = None
    for gaps in itertools.product(between, repeat=len(kinds) + 1):
        for edits in itertools.product("KuaD", repeat=len(kinds)):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for kind, edit, gap in zip(kinds, edits, gaps[1:]):
                must, late = kind == "-", kind.isupper()
                if must and edit != "D" or edit == "K" and kind == "x":
                    break
                if edit != "D":
                    roles += kind.lower() if edit == "K" else edit
                audit += "R" if edit in "ua" else edit
                cost += (2 if edit == "D" else 0 if edit == "K" else 1) + 5 * (late and edit != "D")
                roles += gap
                audit += "I" * len(gap)
                cost += 5 * len(gap)
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_cells_against_every_edit():
    rng = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(1 if n == 0 else 12 if n < 3 else 8):
            kinds = "".join(rng.choice("suaUASx-") for _ in range(n))
            kinds = kinds.replace("X", "x")
            assert repair.cheapest(repair.span(kinds)) == all_edits(kinds), kinds


def test_every_split_gives_the_same_cell():
    """Dyadic spans suffice: the cells of all splits of a span are the same."""
    rng = random.Random(4)
    for _ in range(40):
        kinds = "".join(rng.choice("suaUASx-") for _ in range(rng.randrange(2, 14)))
        whole = repair.span(kinds)
        for k in range(len(kinds) + 1):
            assert repair.combine(repair.span(kinds[:k]), repair.span(kinds[k:])) == whole


def conversations():
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "unit"]
    said = ["Yes.", "No!", "", " \n", "Half of", "café ok? ", "x" * 30_000 + ".", None, "Same. ", "Same."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            if rng.random() < 0.9:
                rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(said) if rng.random() < 0.5 else f"Words {rng.random()}."))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(9)]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "same thing." if t % 3 == 0 else f"turn {t}!") for t in range(3000)]
    rows += [(700 + k, 0, "user", "Alone.") for k in range(40)]
    rows += rows[:40] + [(7, 1, "user", "copied.")] * 30 + [(901, None, "user", "a."), (901, None, "assistant", "b.")]
    return rows


def test_reports_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repaired(repair.damaged(df.repartition(7))).withColumnRenamed("conv", "conv_id").collect()}
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    want = {conv: report(own) for conv, own in by.items()}
    assert {c: (got.get(c), w) for c, w in want.items() if got.get(c) != w} == {} and len(got) == len(want)
    assert any(not own for own in by.values())
    assert got[500][0] > 0 and len(got[500][6]) > 2500


def test_given_table(spark):
    table = "/root/testdata/sf0.01/conversations.parquet"
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op11_repair(spark, "/root/testdata/sf0.01").collect()}
    rows = [tuple(r) for r in spark.read.parquet(table).select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    assert got == {conv: report(own) for conv, own in by.items()}


def test_empty_table_and_other_types(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(repair.damaged(empty)).count() == 0
    one = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    rows = repair.repaired(repair.damaged(one)).collect()
    assert len(rows) == 1 and rows[0].conv == "a"
