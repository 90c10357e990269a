"""Repair of conversation structure by weighted CYK interval parsing.

The roles of a well-formed conversation read ``(s?(ua)+)?``. Each row may be kept, given another role or deleted, and empty
rows may be inserted anywhere; the cheapest such edits, and of equally cheap ones those whose initials are least in ASCII,
make the conversation well-formed.

*Grammar.* In Chomsky normal form, a nonterminal ``N[p, q]`` stands for the edits of a span of rows that take the language's automaton
from state p to state q:

    N[p, q] -> N[p, r] N[r, q]        for every state r
    N[p, q] -> edit of one row        keep, rerole or delete, with its cost
    N[p, q] -> insertions             the insertion closure, applied on both sides of each row

The cell of a span holds, for each nonterminal, its minimum (cost, audit). Two audits of a cell and of equal cost are never
prefixes of one another (what one has more would be insertions, which cost), so the least pair stays least in whatever it is
put into. Every derivation of a span can be split between any two of its rows, because each production allows each state
between its parts. So cells are combined bottom-up by span length over dyadic spans only (1, 2, 4, ... rows), where a
grammar without that property needs all of them: work is linear in the rows, and any part of a conversation can be parsed by itself.

*Spark.* Rows that are equal in all but their number are counted before they are shuffled; first sightings of a (role, text) are minima by
key. Then rows are dealt by ranges of (conversation, turn), so that a conversation that holds a third of all rows is spread over many
tasks; each task returns one cell for each conversation and range, and these few are combined, again bottom-up. The texts
themselves are shuffled once, for the digest of the repaired conversation: SHA-256 runs from a conversation's first byte to
its last, so that one conversation is hashed by one task, row by row as they come in order, with only its audit (one
letter a row) in memory.

Defined cases: a null conv_id is a conversation; a null turn comes first and counts for no gap; null role and text are one space; rows
of one turn are ordered by role and then by the digest of their text; a role counts by its first letter, an empty or unknown role
cannot be kept; repeated rows are repeated faults; very long texts are read as any other; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

STATES = range(4)
#: The language's automaton, (state, role initial) -> state; states 0 and 3 accept.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Roles that a row may be given or that may be inserted.
ROLES = {"u": "user", "a": "assistant"}
#: What each fault is called inside: none, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows up to which the cells of spans are remembered.
SMALL_SPAN = 8

Cell = dict[tuple[int, int], tuple[int, str]]


def _add(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: N[p, q] -> N[p, r] N[r, q]."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (more := right.get((r, q))) is not None:
                total = cost + more[0]
                if (known := out.get((p, q))) is None or total < known[0] or total == known[0] and audit + more[1] < known[1]:
                    out[p, q] = total, audit + more[1]
    return out


def _closure() -> Cell:
    """Insertions from any state to any other that they reach, at least cost."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    while True:
        wider = dict(cell)
        for (p, r), (cost, audit) in cell.items():
            for role in ROLES:
                if (r, role) in MOVES:
                    _add(wider, (p, MOVES[r, role]), (cost + COSTS[INSERT], audit + INSERT))
        if wider == cell:
            return cell
        cell = wider


CLOSURE = _closure()


@lru_cache(None)
def _leaf(kind: str) -> Cell:
    """The cell of one row. ``kind`` is its role initial; upper case if it is truncated, ``-`` if it has to be deleted."""
    cell: Cell = {(p, p): (COSTS[DELETE], DELETE) for p in STATES}
    if kind != "-":
        role, more = kind.lower(), TRUNCATED_COST * (kind != kind.lower())
        for (p, initial), q in MOVES.items():
            if initial == role:
                _add(cell, (p, q), (COSTS[KEEP] + more, KEEP))
            if initial in ROLES:
                _add(cell, (p, q), (COSTS[REROLE] + more, REROLE))
    return combine(combine(CLOSURE, cell), CLOSURE)


def span(kinds: str) -> Cell:
    """The cell of a span of rows, from those of its dyadic parts."""
    if len(kinds) <= SMALL_SPAN:
        return _small(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(span(kinds[:half]), span(kinds[half:]))


@lru_cache(200_000)
def _small(kinds: str) -> Cell:
    if not kinds:
        return CLOSURE
    if len(kinds) == 1:
        return _leaf(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(_small(kinds[:half]), _small(kinds[half:]))


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cell[0, q] for q in ACCEPTING if (0, q) in cell)


def kind_of(initial: str, fault: int) -> str:
    if fault in (BLANK, DUPLICATE):
        return "-"
    kind = initial if initial in ("s", "u", "a") else "x"
    return kind.upper() if fault == TRUNCATED else kind


class Segment:
    """What a range of consecutive rows of one conversation adds to its report."""

    def __init__(self, conv):
        self.conv, self.kinds, self.pairs = conv, [], 0
        self.first = self.last = None  # role initials at the ends
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, initial: str, faults: list[tuple[int, int]]) -> None:
        """Equal rows: (fault, how many) in order."""
        n = sum(k for _, k in faults)
        for fault, k in faults:
            self.blank += k * (fault == BLANK)
            self.duplicate += k * (fault == DUPLICATE)
            self.truncated += k * (fault == TRUNCATED)
            self.kinds.append(kind_of(initial, fault) * k)
        self.pairs += illegal(initial, initial) * (n - 1)
        if self.last is None:
            self.first = initial
        else:
            self.pairs += illegal(self.last, initial)
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low

    def row(self, order: int) -> tuple:
        cell = span("".join(self.kinds))
        keys = list(cell)
        return (self.conv, order, self.blank, self.duplicate, self.truncated, self.pairs, self.first, self.last, self.low, self.high, self.turns, [4 * p + q for p, q in keys], [cell[k][0] for k in keys], [cell[k][1] for k in keys])


def illegal(left: str, right: str) -> int:
    return int(left + right not in ("su", "ua", "au"))


def _segment_columns(conv: str, turn: str) -> str:
    return f"conv {conv}, part long, blank long, duplicate long, truncated long, pairs long, first string, last string, low {turn}, high {turn}, turns long, states array<int>, costs array<long>, audits array<string>"


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition that is ordered by (conversation, turn, role, digest)."""
    part, now, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for conv, turn, initial, fault, first, n in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row(part))
                now = Segment(conv)
            if n:
                # of equal rows only the first can be the first sighting of its role and text
                again = BLANK if fault == BLANK else DUPLICATE
                now.add(turn, initial, [(fault, 1), (again, n - 1)] if first else [(again, n)])
        if len(out) > 2000:
            yield _batch(out, schema)
            out = []
    if now is not None:
        out.append(now.row(part))
    yield _batch(out, schema)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _report(segments: list[dict]) -> dict:
    """The report of a conversation, from its segments in order."""
    out = dict.fromkeys(REPORT, 0)
    cells = []
    last = high = low = None
    turns = 0
    for s in segments:
        for name in ("blank", "duplicate", "truncated"):
            out[name] += s[name]
        out["illegal"] += s["pairs"]
        if s["last"] is not None:
            out["illegal"] += illegal(last, s["first"]) if last is not None else 0
            last = s["last"]
        if s["low"] is not None:
            turns += s["turns"] - (s["low"] == high)
            low, high = s["low"] if low is None else low, s["high"]
        cells.append({(k // 4, k % 4): (c, a) for k, c, a in zip(s["states"], s["costs"], s["audits"])})
    if low is not None:
        out["gaps"] = high - low + 1 - turns
    while len(cells) > 1:  # bottom-up by span length
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    out["cost"], out["audit"] = cheapest(cells[0])
    return out


def _combined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition of segments ordered by (conversation, part)."""
    held: list[dict] = []
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            if held and held[0]["conv"] != s["conv"]:
                out.append((held[0]["conv"], *_report(held).values()))
                held = []
            held.append(s)
        yield _batch(out, schema)
    yield _batch([(held[0]["conv"], *_report(held).values())] if held else [], schema)


class _Digest:
    """SHA-256 of a repaired conversation, row by row."""

    def __init__(self, head: tuple):
        self.head, self.audit, self.at, self.state = head, head[-1], 0, 0
        self.sha, self.empty = hashlib.sha256(), True

    def _out(self, role: str, text: str, initial: str) -> None:
        self.sha.update((role + ":" + text if self.empty else "\n" + role + ":" + text).encode())
        self.empty, self.state = False, MOVES[self.state, initial]

    def _next(self) -> str:
        """The one role initial out of u and a that may come now."""
        return "a" if self.state == 2 else "u"

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            self._out(ROLES[self._next()], "", self._next())

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self._out(role, text, role[:1])
        elif edit == REROLE:
            self._out(ROLES[self._next()], text, self._next())

    def done(self) -> tuple:
        self.insertions()
        assert self.at == len(self.audit)
        return *self.head, self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition ordered by conversation, its report first, then its rows."""
    now, out = None, []
    for batch in batches:
        for conv, head, role, text, n, *report in zip(*(c.to_pylist() for c in batch.columns)):
            if head:
                if now is not None:
                    out.append(now.done())
                now = _Digest((conv, *report))
            else:
                for _ in range(n):
                    now.row(role, text)
        yield _batch(out, schema)
        out = []
    yield _batch([now.done()] if now is not None else [], schema)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after damage that depends on crc32("conv:turn") alone; dropped rows have no copies."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), (F.crc32(key) % 20).alias("damage"))
    d = F.col("damage")
    return base.select(
        "conv", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
    )


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def own_fault(text: Column) -> Column:
    """Fault that a row has by itself."""
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(F.ltrim(text, F.lit(WHITE)) == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of
    (conv, turn, role, text, copies). A row with no copies only says that its conversation exists."""
    conv_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # equal rows are counted, so that copies meet in sums
    key = ["conv", "turn", "role", "digest"]
    counted = named.select(*key, own_fault(F.col("text")).alias("fault"), "copies").groupBy(*key, "fault").agg(F.sum("copies").alias("n"))
    seen = F.col("n") > 0
    # the earliest turn of each role and text that comes more than once; nulls come first
    turn_rank = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = counted.filter(seen & (F.col("fault") != BLANK)).groupBy("conv", "role", "digest").agg(F.min(turn_rank).alias("first"), F.count("*").alias("k")).filter("k > 1")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = counted.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.withColumn("is_first", F.col("first").isNull() | F.col("first").eqNullSafe(turn_rank))
    ordered = marked.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in key]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in key])
    compact = ordered.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "is_first", "n")
    ddl = _segment_columns(conv_type, turn_type)
    cells = _schema(ddl)
    segments = compact.mapInArrow(lambda it: _parse(it, cells), ddl)
    report_ddl = f"conv {conv_type}, {', '.join(f'{c} long' for c in REPORT)}, audit string"
    reports_schema = _schema(report_ddl)
    reports = segments.repartition(parts, "conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part").mapInArrow(lambda it: _combined(it, reports_schema), report_ddl)
    no = F.lit(None)
    heads = reports.select("conv", F.lit(True).alias("head"), no.cast(turn_type).alias("turn"), no.cast("string").alias("role"), no.cast("string").alias("text"), no.cast("binary").alias("digest"), F.lit(1).alias("copies"), *REPORT, "audit")
    bodies = named.filter("copies > 0").select("conv", F.lit(False).alias("head"), "turn", "role", "text", "digest", "copies", *[no.cast("long").alias(c) for c in REPORT], no.cast("string").alias("audit"))
    together = heads.unionByName(bodies).repartition(parts, "conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("head"), F.asc_nulls_first("turn"), "role", "digest")
    full = _schema(report_ddl + ", repaired_sha256 string")
    return together.select("conv", "head", "role", "text", "copies", *REPORT, "audit").mapInArrow(lambda it: _digests(it, full), report_ddl + ", repaired_sha256 string")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")
