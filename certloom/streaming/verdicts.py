"""Late verdicts: a domain that is confirmed after a mail was stored changes that mail's verdict.

Stored mails are a base table and one folder of changed rows for each micro-batch. A batch reads what the batches before it left, joins its confirmed
sites with the sites of those mails, and writes only the rows that change, under its own number: a batch that is tried again replaces itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.letters import verdict

#: Stored mails: registrable domains of sender and links, signals found so far, and every change of verdict.
HISTORY = "array<struct<at: bigint, old: string, new: string>>"
MAILS = f"mail bigint, sender string, links array<string>, signals array<string>, verdict string, history {HISTORY}"


def current(base: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """Each mail as the batches (those before a number, if one is given) have left it; ``base`` has the columns of MAILS."""
    spark, columns = base.sparkSession, [f.name for f in StructType.fromDDL(MAILS)]
    changed = spark.read.schema(MAILS + ", batch bigint").option("basePath", folder).parquet(folder)
    if before is not None:
        changed = changed.filter(F.col("batch") < before)
    every = base.select(*columns, F.lit(-1).cast("long").alias("batch")).unionByName(changed)
    return every.groupBy("mail").agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")


def changes(mails: DataFrame, confirmed: DataFrame, judge=verdict) -> DataFrame:
    """Mails with a signal more, now that (site, at) are confirmed; a changed verdict is added to the history, with the time of the first such site."""
    sites = confirmed.filter("site is not null").groupBy("site").agg(F.min("at").alias("at"))
    roles = F.concat(F.array(F.struct(F.lit("sender_domain_confirmed").alias("signal"), F.col("sender").alias("site"))), F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.struct(F.lit("link_domain_confirmed").alias("signal"), x.alias("site"))))
    hits = mails.select("mail", F.inline(roles)).join(sites, "site").groupBy("mail").agg(F.collect_set("signal").alias("more"), F.min("at").alias("at"))
    rows = mails.join(hits, "mail").withColumn("signals_now", F.array_sort(F.array_union("signals", "more"))).filter(F.size("signals_now") > F.size("signals"))
    now: Column = judge(F.col("signals_now"))
    step = F.when(now != F.col("verdict"), F.array_append("history", F.struct(F.col("at").alias("at"), F.col("verdict").alias("old"), now.alias("new")))).otherwise(F.col("history"))
    return rows.select("mail", "sender", "links", F.col("signals_now").alias("signals"), now.alias("verdict"), step.cast(HISTORY.replace(": ", ":")).alias("history"))


def rejudge(confirmed: DataFrame, base: DataFrame, folder: str, checkpoint: str):
    """Follow a stream of confirmed (site, at) and keep the changed mails of each micro-batch in ``folder``; the running query."""
    spark = base.sparkSession
    spark.createDataFrame([], MAILS).withColumn("batch", F.lit(0).cast("long")).write.mode("append").partitionBy("batch").parquet(folder)

    def publish(batch: DataFrame, number: int) -> None:
        changes(current(base, folder, number), batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return confirmed.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
