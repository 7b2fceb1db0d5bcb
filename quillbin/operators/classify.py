"""Assignment of sequences to seeds by coverage and composition.

depth: ``(id, sample, mean)``; seeds: ``(seed, sample, mean, lo, hi)``; vectors: ``(id, vec,
ss, bucket)``, with the seed as id for seeds.  Results are ``(id, seed)``, an id at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbin.operators import composition, coverage, naive_bayes


def by_number(candidates: DataFrame) -> DataFrame:
    """Adds ``n``, the seeds of an id."""
    return candidates.join(candidates.groupBy("id").agg(F.count("*").alias("n")), "id")


def alike_of_several(candidates: DataFrame, comp: DataFrame, seed_comp: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``candidates(id, seed)``: an id's only seed, or of several the one most likely of its species."""
    numbered = by_number(candidates)
    pairs = numbered.where("n > 1").select(F.col("id").alias("a"), F.col("seed").alias("b"))
    best = composition.most_alike(composition.calibrated(composition.correlated(pairs, comp, seed_comp), cutoffs))
    return numbered.where("n = 1").select("id", "seed").unionByName(best.select(F.col("a").alias("id"), F.col("b").alias("seed")))


def classify_large(depth: DataFrame, seeds: DataFrame, comp: DataFrame, seed_comp: DataFrame, cutoffs: DataFrame, n_samples: int) -> DataFrame:
    """A sequence within one seed's coverage goes there; of several the one most likely of its species; of none: no row."""
    return alike_of_several(coverage.within(depth, seeds, n_samples), comp, seed_comp, cutoffs)


def classify_small(depth: DataFrame, seeds: DataFrame, counts: DataFrame, lengths: DataFrame, logs: DataFrame, n_samples: int, first: str) -> DataFrame:
    """The best naive Bayes score of the seeds whose coverage fits (below their upper end); those of no seed try ``first``, and have no row if it is no seed.

    counts: ``(id, kmer, n)`` of 4-mers, logs: ``(seed, kmer, logp)``.  Returns the score as well.
    """
    pairs = coverage.within_or_first(depth, seeds, n_samples, first)
    return naive_bayes.best(naive_bayes.scores(counts, lengths, logs, pairs))


def long_markers(pairs: DataFrame, comp: DataFrame, seed_comp: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``pairs(id, seed)`` to candidates of ``occupancy``: the probability of one species, then the correlation."""
    scored = composition.calibrated(composition.correlated(pairs.select(F.col("id").alias("a"), F.col("seed").alias("b")), comp, seed_comp), cutoffs)
    return scored.select(F.col("a").alias("id"), F.col("b").alias("seed"), F.coalesce("p", F.lit(0.0)).alias("value"), F.col("cor").alias("tie"))


def short_markers(pairs: DataFrame, counts: DataFrame, lengths: DataFrame, logs: DataFrame) -> DataFrame:
    """``pairs(id, seed)`` to candidates of ``occupancy``: the naive Bayes score, none without k-mers."""
    return pairs.join(naive_bayes.scores(counts, lengths, logs, pairs), ["id", "seed"], "left").select("id", "seed", F.col("score").alias("value"), F.lit(0.0).alias("tie"))


def classify_by_composition(counts: DataFrame, lengths: DataFrame, logs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(id, seed, score)`` over all seeds of logs; an id keeps its row in ``before`` if that scores higher."""
    best = naive_bayes.best(naive_bayes.scores(counts, lengths, logs))
    if before is None:
        return best
    both = best.unionByName(before.select("id", "seed", "score"))
    return naive_bayes.best(both)
