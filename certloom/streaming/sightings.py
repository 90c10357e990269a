"""Late and re-delivered rows (T05): they change the index of first and last sightings, but no window that is already closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partials import FOLD, Partials, sums

WIDTH_US, DELAY_US = 5_000_000, 60_000_000


class Sightings:
    """Index and windows that ``follow`` keeps below a folder.

    The watermark of a micro-batch is the greatest time of the batches before it, less the delay. A row is late if its window ends at or before the
    watermark. Null names count in windows and are not in the index; rows without a time are in neither."""

    def __init__(self, spark: SparkSession, folder: str, width_us: int = WIDTH_US, delay_us: int = DELAY_US, fold: int = FOLD) -> None:
        self.width_us, self.delay_us = width_us, delay_us
        ends = lambda rows: rows.groupBy("name").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("late").alias("late"))
        newest = lambda rows: rows.groupBy().agg(F.max("us").alias("us"))
        self._index = Partials(spark, f"{folder}/index", "name string, first_us bigint, last_us bigint, late bigint", ends, fold)
        self._windows = Partials(spark, f"{folder}/windows", "window_us bigint, n bigint", sums(["window_us"], "n"), fold)
        self._newest = Partials(spark, f"{folder}/newest", "us bigint", newest, fold)

    def index(self) -> DataFrame:
        """(name, first_us, last_us, late): every sighting of a name counts, ``late`` is the number of its late ones."""
        return self._index.read()

    def windows(self) -> DataFrame:
        """(window_us, n): rows by start of their window, late ones left out."""
        return self._windows.read()

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch of (name, us)."""
        start = F.col("us") - F.pmod("us", F.lit(self.width_us))
        closed = self._newest.read(number).select((F.col("us") - self.delay_us).alias("watermark"))  # one row
        rows = batch.select("name", "us", start.alias("window_us")).filter("us IS NOT NULL").crossJoin(F.broadcast(closed))
        rows = rows.withColumn("late", F.coalesce(F.col("window_us") + self.width_us <= F.col("watermark"), F.lit(False))).persist()
        try:
            known = rows.filter("name IS NOT NULL").groupBy("name")
            self._index.put(known.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_if("late").alias("late")), number)
            self._windows.put(rows.filter("NOT late").groupBy("window_us").agg(F.count("*").alias("n")), number)
            self._newest.put(rows.groupBy().agg(F.max("us").alias("us")), number)
        finally:
            rows.unpersist()

    def follow(self, rows: DataFrame, checkpoint: str):
        """Take in a stream of (name, us); the running query."""
        return rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
