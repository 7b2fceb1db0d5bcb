"""Labelled rows to learn from: a bounded sample, and the split by the checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on.
SAMPLE = 10_000


def fold(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = SAMPLE) -> DataFrame:
    """``(text, label int)`` of ``most`` labelled ids at most, those with the least hashes.

    Rows with a null id or label teach nothing; an id with several labels has the greatest.
    The sample of labels is bounded, so it is broadcast and the texts stay where they are.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "label")
