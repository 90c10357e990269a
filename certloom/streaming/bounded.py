"""Streams whose state is bounded by count: the newest keys, and a feed of so many rows a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import delete, finished
from .partials import Partials, sums

#: Keys that are remembered, and rows of a feed a second.
CAPACITY, PER_SECOND = 500_000, 20


def _given(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows that batches have written below ``folder``, with the number of their batch."""
    schema += ", number bigint"
    return spark.read.schema(schema).parquet(folder) if finished(spark, folder) else spark.createDataFrame([], schema)


class RecentKeys:
    """One row for each key among the newest ones (T01). A repeat gives no row and makes its key the newest; of more than ``capacity`` keys those that
    were heard of longest ago are forgotten, ties by greater key first, and give a row again.

    Keys are forgotten between micro-batches, so one batch may hold any number of them. Rows of a batch are reduced by key before the shuffle, and the state is
    a table of at most ``capacity`` keys with their latest time, written anew for each batch under its number. Of a new key's rows in a batch the
    earliest is given. Null keys count as one key; rows without a time do not count."""

    def __init__(self, spark: SparkSession, folder: str, capacity: int = CAPACITY) -> None:
        self.spark, self.folder, self.capacity = spark, folder, capacity

    def _batches(self) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in finished(self.spark, f"{self.folder}/state"))

    def state(self, before: int | None = None) -> DataFrame:
        """(key, last) as the batches (those before a number) have left it."""
        numbers = [n for n in self._batches() if before is None or n < before]
        if not numbers:
            return self.spark.createDataFrame([], "key string, last bigint")
        return self.spark.read.schema("key string, last bigint").parquet(f"{self.folder}/state/number={numbers[-1]}")

    def rows(self) -> DataFrame:
        """(key, us, number): the rows given so far, with the number of their batch."""
        return _given(self.spark, f"{self.folder}/rows", "key string, us bigint")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch of (key, us)."""
        known = self.state(number)
        now = batch.filter("us IS NOT NULL").groupBy("key").agg(F.min("us").alias("us"), F.max("us").alias("last")).persist()
        try:
            same = now["key"].eqNullSafe(known["key"])
            now.join(known, same, "left_anti").select("key", "us").write.mode("overwrite").parquet(f"{self.folder}/rows/number={number}")
            every = now.select("key", "last").unionByName(known).groupBy("key").agg(F.max("last").alias("last"))
            every.orderBy(F.desc("last"), "key").limit(self.capacity).write.mode("overwrite").parquet(f"{self.folder}/state/number={number}")
        finally:
            now.unpersist()
        for n in [n for n in self._batches() if n < number][:-1]:  # the batch before this one stays, as this one may be tried again
            delete(self.spark, f"{self.folder}/state/number={n}")

    def follow(self, rows: DataFrame, checkpoint: str):
        return rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Throttle:
    """A feed of at most ``limit`` rows a second (T08): candidates are always given, others while their second has room, the earliest first.

    What a second has already given in earlier micro-batches is kept as counts. Only the first ``limit`` others of a second reach the shuffle. Rows without
    a time are left out, a null ``candidate`` is none, and ties go by ``idx``."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = PER_SECOND) -> None:
        self.spark, self.folder, self.limit = spark, folder, limit
        self._given = Partials(spark, f"{folder}/given", "second bigint, n bigint", sums(["second"], "n"))

    def rows(self) -> DataFrame:
        """(idx, us, candidate, number) of all that was given."""
        return _given(self.spark, f"{self.folder}/rows", "idx bigint, us bigint, candidate boolean")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch of (idx, us, candidate)."""
        own = batch.filter("us IS NOT NULL").select("idx", "us", F.coalesce("candidate", F.lit(False)).alias("candidate"), F.floor(F.col("us") / 1_000_000).alias("second"))
        first = own.filter("candidate")
        order = Window.partitionBy("second").orderBy("us", "idx")
        others = own.filter("NOT candidate").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.limit)
        taken = first.groupBy("second").agg(F.count("*").alias("n")).unionByName(self._given.read(number)).groupBy("second").agg(F.sum("n").alias("taken"))
        room = F.col("place") + F.coalesce("taken", F.lit(0)) <= self.limit
        columns = ["idx", "us", "candidate"]
        given = first.select(*columns).unionByName(others.join(taken, "second", "left").filter(room).select(*columns))
        out = f"{self.folder}/rows/number={number}"
        given.write.mode("overwrite").parquet(out)
        back = self.spark.read.schema(given.schema).parquet(out)
        self._given.put(back.groupBy(F.floor(F.col("us") / 1_000_000).alias("second")).agg(F.count("*").alias("n")), number)

    def follow(self, rows: DataFrame, checkpoint: str):
        return rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
