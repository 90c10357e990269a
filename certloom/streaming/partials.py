"""Tables that a stream adds to by micro-batch: one folder of partial rows for each batch, folded into one from time to time.

A batch writes under its own number and reads only what the batches before it left, so a batch that is tried again gives the same rows. Partial
rows are of a kind that can be merged: counts, least and greatest values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import delete, finished

#: Batches after which partial rows are folded.
FOLD = 32


class Partials:
    """Rows of ``schema`` below ``folder``; ``merge`` maps rows of several batches to rows of one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], fold: int = FOLD) -> None:
        self.spark, self.folder, self.schema, self.merge, self.fold = spark, folder, schema, merge, fold

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in finished(self.spark, f"{self.folder}/{kind}"))

    def _rows(self, kind: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{kind}/number={n}" for n in numbers]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """Merged rows of all batches, or of those before a number: the last fold and the batches since, fewer than two folds of them."""
        folds = [n for n in self._numbers("folded") if before is None or n <= before]
        start = folds[-1] if folds else 0
        since = [n for n in self._numbers("batch") if n >= start and (before is None or n < before)]
        return self.merge(self._rows("folded", folds[-1:]).unionByName(self._rows("batch", since)))

    def put(self, rows: DataFrame, number: int) -> None:
        """Keep a batch's partial rows. After every ``fold`` batches they are folded; what the fold before that one holds is deleted, the batches since
        stay, as this batch may be tried again."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch/number={number}")
        if (number + 1) % self.fold == 0:
            earlier = [n for n in self._numbers("folded") if n <= number]
            self.read(number + 1).write.mode("overwrite").parquet(f"{self.folder}/folded/number={number + 1}")
            for n in self._numbers("batch"):
                if earlier and n < earlier[-1]:
                    delete(self.spark, f"{self.folder}/batch/number={n}")
            for n in earlier[:-1]:
                delete(self.spark, f"{self.folder}/folded/number={n}")


def sums(keys: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(F.sum(value).alias(value))
