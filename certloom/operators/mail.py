"""Mail parsing expressions and verdicts over text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import table

ADDRESS = r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
URL = r"https?://[^\s<>]+"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{ADDRESS}', 1), lambda x: lower(x)))), ',') AS domains FROM documents WHERE regexp_matches(text, '{ADDRESS}')")
def c38_address_domains(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("text").rlike(ADDRESS))
    found = F.transform(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(1)), F.lower)
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("domains"))


@query("SELECT DISTINCT conv_id FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS prev FROM conversations) WHERE prev > turn")
def w11_out_of_order_hops(spark, sf):
    hops = table(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")).alias("before"))
    return hops.filter("before > turn").select("conv_id").distinct()
