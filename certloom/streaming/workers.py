"""Jobs that follow the message stream: capture, scoring by micro-batch, delays, routing, re-checks and replay fixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from email.parser import HeaderParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes until each re-check, after the last of which a key is given up.
LADDER_MINUTES = (5, 15, 60, 240, 720, 1440)


def write_capture(messages: DataFrame, path: str, checkpoint: str):
    """A stream's certificate messages as compressed JSON lines (S05); the running query."""
    kept = messages.filter("_bad IS NULL AND message_type = 'certificate_update'").select("message_type", "data")
    return kept.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_received(records: DataFrame, received=None) -> DataFrame:
    """Our own time of arrival beside the time that upstream saw, and the delay between them in microseconds (T04). The watermark stays on ``seen``.
    ``received`` is a column of recorded arrivals; without one it is the time of the micro-batch."""
    out = records.withColumn("received", F.current_timestamp() if received is None else received)
    return out.withColumn("delay_us", F.unix_micros("received") - F.unix_micros("seen"))


def score_batches(records: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """Score each name of a stream once a micro-batch and keep candidates and feed rows (T02). ``score`` maps distinct (name) to (name, score,
    candidate). A batch writes under its own number and replaces what a failed attempt left, so nothing is published twice."""

    def publish(batch: DataFrame, number: int) -> None:
        names = batch.select(F.explode("names").alias("name"), "seen", "source")
        found = names.join(score(names.select("name").distinct()), "name")
        found.filter("candidate").groupBy("name").agg(F.min("seen").alias("first_seen"), F.max("score").alias("score")).write.mode("overwrite").parquet(f"{folder}/candidates/batch={number}")
        found.select("name", "seen", "source", "score", "candidate").write.mode("overwrite").parquet(f"{folder}/feed/batch={number}")

    return records.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(candidates: DataFrame, sectors: DataFrame, organisations: DataFrame) -> DataFrame:
    """Candidates (name, brand) with the organisation of the brand's sector, the oldest active one (T17). ``sectors`` is (brand, sector), ``organisations``
    (organisation, sector, active, created); both are read anew for each micro-batch of a stream."""
    order = F.struct("created", "organisation")
    chosen = organisations.filter("active").groupBy("sector").agg(F.min(order).organisation.alias("organisation"))
    return candidates.join(sectors.join(chosen, "sector", "left"), "brand", "left")


def rechecks(attempts: DataFrame) -> DataFrame:
    """(key, tries, due, state) after the attempts (key, at, ok) of each micro-batch (T11): a failure moves a key one step up the ladder, success clears
    its counter, and after the last step it is given up. Attempts of a batch count in order of time;
    one key's attempts within a micro-batch are ordered in a task's memory, so a backlog should be read in batches of bounded size."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, last = state.get if state.exists else (0, 0)
        due, outcome = None, "done"
        for at, ok in sorted((int(r.at), bool(r.ok)) for b in batches for r in b.itertuples()):
            if ok:
                tries, due, outcome = 0, None, "done"
            elif tries < len(LADDER_MINUTES):
                due, outcome = at + LADDER_MINUTES[tries] * 60_000_000, "waiting"
                tries += 1
            else:
                due, outcome = None, "given up"
            last = at
        if tries:
            state.update((tries, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "tries": [tries], "due": pd.array([due], "Int64"), "state": [outcome]})

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, tries int, due long, state string", "tries int, last long", "update", GroupStateTimeout.NoTimeout)


@F.udtf(returnType="position int, name string, value string")
class MessageHeaders:
    """Header rows of a raw message, folded lines joined (F03); a null message has none."""

    def eval(self, raw: str):
        for k, (name, value) in enumerate(HeaderParser().parsestr(raw or "").items()):
            yield k, name, " ".join(str(value).split())


def write_fixture(rows: DataFrame, path: str, key: str = "key", time: str = "seen", tag: str = "source") -> DataFrame:
    """Write the earliest copy of each key as JSON lines in order of time, for replay (S17); (tag, before, after) counts."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(time, tag))).filter("_n = 1").drop("_n")
    first.orderBy(time, key, tag).write.json(path)
    kept = rows.sparkSession.read.json(path).groupBy(tag).agg(F.count("*").alias("after"))
    return rows.groupBy(tag).agg(F.count("*").alias("before")).join(kept, tag, "left").select(tag, "before", F.coalesce("after", F.lit(0)).alias("after"))
