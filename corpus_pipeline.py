"""A corpus from documents to training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillbin.llm import mixing, packing, simhash, suffix_dedup, toxicity
from quillbin.llm.common import fresh_dir, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("simhash_dedup", simhash.dedup),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Fingerprints, learned weights and sampling have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
