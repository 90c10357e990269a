"""Keyed state with timers: what is due or silent emits its own row once event time has passed it, whether or not its key is heard of again.

State is kept by ``transformWithStateInPandas``, which needs the RocksDB state store (``state_store``). Timers follow the watermark, so a replay fires the same
ones. One key's rows within a micro-batch are read as a stream of frames; only its latest attempt or sighting is state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .workers import LADDER_MINUTES

#: Seconds without a heartbeat after which a source is down.
SILENCE_SECONDS = 15
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state where timers can be."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


class _Timed(StatefulProcessor):
    """One value and at most one timer for each key."""

    value = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("value", self.value)

    def wake(self, at_us: int | None) -> None:
        """Replace the key's timer; it fires when the watermark has reached the time."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at_us is not None:
            self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


class _Rechecks(_Timed):
    value = "tries int, due long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tries, due, outcome = *(self.state.get() if self.state.exists() else (0, None)), "done"
        for at, ok in sorted((int(a), bool(o)) for frame in rows for a, o in zip(frame["at"], frame["ok"])):
            if ok:
                tries, due, outcome = 0, None, "done"
            elif tries < len(LADDER_MINUTES):
                due, outcome = at + LADDER_MINUTES[tries] * 60_000_000, "waiting"
                tries += 1
            else:
                due, outcome = None, "given up"
        if tries:
            self.state.update((tries, due))
        else:
            self.state.clear()
        self.wake(due)
        yield _row(key, tries, due, outcome)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tries, due = self.state.get()
        yield _row(key, tries, due, "due")


def _row(key, tries: int, due: int | None, outcome: str) -> pd.DataFrame:
    return pd.DataFrame({"key": [key[0]], "tries": [tries], "due": pd.array([due], "Int64"), "state": [outcome]})


def due_rechecks(attempts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, tries, due, state) of (key, time, at, ok), ``at`` being ``time`` in microseconds: after each micro-batch with attempts of a key its state on the
    ladder, and a row ``due`` once the watermark reaches its next re-check. A null ``ok`` is a failure."""
    rows = attempts.withWatermark("time", late).selectExpr("key", "at", "coalesce(ok, false) AS ok", "time")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Rechecks(), outputStructType="key string, tries int, due long, state string", outputMode="Update", timeMode="EventTime")


class _Silence(_Timed):
    value = "last long, down boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, down = self.state.get() if self.state.exists() else (None, True)
        newest = max(int(frame["at"].max()) for frame in rows)
        last = newest if last is None else max(last, newest)
        self.state.update((last, False))
        self.wake(last + SILENCE_SECONDS * 1_000_000)
        if down:
            yield pd.DataFrame({"source": [key[0]], "last_us": [last], "state": ["up"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.state.get()
        self.state.update((last, True))
        yield pd.DataFrame({"source": [key[0]], "last_us": [last], "state": ["down"]})


def silent_sources(heartbeats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(source, last_us, state) of (source, time, at): ``up`` when a source is first heard of or heard again, ``down`` once the watermark is SILENCE_SECONDS past
    its last row."""
    rows = heartbeats.withWatermark("time", late)
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=_Silence(), outputStructType="source string, last_us long, state string", outputMode="Update", timeMode="EventTime")
