"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from certloom.llm import near_dedup, packing, substring_dedup, toxicity
from certloom.llm.common import materialise

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

#: Learned scores and signatures are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
