"""Composition vectors, their correlations and the probability of one species."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillbin.functions.sequences import composition, correlation, dot, length_bucket, zscores_of
from quillbin.functions.statistics import normal_below
from quillbin.operators.naive_bayes import kmer_counts


def vectors(sequences: DataFrame) -> DataFrame:
    """``sequences(id, seq, length)`` to ``(id, vec array<double>, ss, bucket)``."""
    rows = sequences.select("id", composition("seq").alias("vec"), length_bucket(F.col("length")).alias("bucket"))
    return rows.withColumn("ss", dot(F.col("vec"), F.col("vec")))


def counted(sequences: DataFrame) -> DataFrame:
    """``(id, kmer, n)``: 2-, 3- and 4-mers of a sequence, counted once and summed for any cluster."""
    return kmer_counts(sequences, "id", (2, 3, 4))


@F.pandas_udf(ArrayType(DoubleType()))
def centred_zscores(counts: pd.Series) -> pd.Series:
    """From the counts of one strand as ``[(kmer, n), ...]``."""
    return pd.Series([(z := zscores_of({r["kmer"]: r["n"] for r in own})) - z.mean() for own in counts])


def cluster_vectors(counts: DataFrame, assigned: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(id, vec, ss, bucket)`` of clusters, id being the seed: k-mers that would span two members are not counted.

    counts: see ``counted``; assigned: ``(id, seed)``; lengths: ``(id, length)``.  What comes
    together for a cluster is 336 sums, however many members it has.
    """
    sums = counts.join(assigned, "id").groupBy("seed", "kmer").agg(F.sum("n").alias("n")).groupBy("seed").agg(F.collect_list(F.struct("kmer", "n")).alias("counts"))
    size = assigned.join(lengths, "id").groupBy("seed").agg(length_bucket(F.sum("length")).alias("bucket"))
    rows = sums.join(size, "seed").select(F.col("seed").alias("id"), centred_zscores("counts").alias("vec"), "bucket")
    return rows.withColumn("ss", dot(F.col("vec"), F.col("vec")))


def correlated(pairs: DataFrame, comp: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Adds ``cor`` and both buckets to ``pairs(a, b, ...)``; candidates come from a join by coverage, so vectors are read for those only.

    a is looked up in comp, b in others if given.
    """
    x = comp.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("ss").alias("sa"), F.col("bucket").alias("len1"))
    y = (comp if others is None else others).select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("ss").alias("sb"), F.col("bucket").alias("len2"))
    both = pairs.join(x, "a").join(y, "b")
    return both.withColumn("cor", correlation(F.col("va"), F.col("vb"), F.col("sa"), F.col("sb"))).drop("va", "vb", "sa", "sb")


def calibrated(pairs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds cutoff, diff and ``p``, the part of pairs of one species with a lesser correlation; pairs(a, b, len1, len2, cor).

    The table has at most 21 by 21 rows.
    """
    table = cutoffs.select("len1", "len2", "smean", "ssd", "cutoff", "diff")
    rows = pairs.join(table, ["len1", "len2"], "left")
    return rows.withColumn("z", (F.col("cor") - F.col("smean")) / F.col("ssd")).withColumn("p", normal_below(F.col("z"))).drop("smean", "ssd")


def most_alike(pairs: DataFrame) -> DataFrame:
    """``(a, b, p, cor)``: for each a the b with the greatest p, then correlation, then name."""
    order = F.struct(-F.coalesce("p", F.lit(0.0)), -F.col("cor"), "b")
    return pairs.groupBy("a").agg(F.min_by(F.struct("b", "p", "cor"), order).alias("m")).select("a", "m.*")
