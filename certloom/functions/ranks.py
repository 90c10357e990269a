"""Ranks over any number of distinct values: counts within ranges of the order, and running totals over the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise


def running(rows: DataFrame, order: list[str], amount: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``rows``, of which no two are equal in ``groups`` and ``order``, with ``before``: the amount of all rows of the group that come earlier.

    Rows are dealt by ranges of about equal size (Spark samples their bounds) and stored, so that each row stays in the range it was counted in. One task orders one
    range; only the totals of the ranges, one for each shuffle partition and group, are ordered as a whole. Nulls come first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *groups, *order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, "part").agg(F.sum(amount).alias("own")).withColumn("upto", F.coalesce(F.sum("own").over(earlier), F.lit(0))).drop("own")
    same = F.col("r.part") == F.col("t.part")
    for g in groups:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    inside = Window.partitionBy(*groups, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return within.alias("r").join(totals.alias("t"), same).select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r.within") + F.col("t.upto")).alias("before"))


def mean_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, rank) of each distinct value: how many rows have it and the mean of their ranks from 1 (W07). Nulls have no rank."""
    by = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running(by, [value], "n").select(value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
