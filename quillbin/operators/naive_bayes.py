"""k-mer naive Bayes: log probabilities of seeds and length-normalised scores of sequences."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbin.functions.sequences import CODE, FOURMERS, LETTERS, counts
from quillbin.operators.shared import shared_folder

#: Scores are given for so many letters.
PER_LETTERS = 500.0
MARGIN = 7.0


def kmer_counts(sequences: DataFrame, by: str, k: int | Sequence[int] = 4) -> DataFrame:
    """``sequences(by, seq)`` to ``(by, kmer, n)`` for one k or several; a batch's sums for each key go to the shuffle, not k-mers."""
    sizes = [k] if isinstance(k, int) else [*k]
    names = {k: np.array(["".join(x) for x in itertools.product(LETTERS, repeat=k)], object) for k in sizes}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keys, group = p[by].factorize(use_na_sentinel=False)[::-1]
            order = np.argsort(group, kind="stable")
            seqs, group = p["seq"].to_numpy()[order], group[order]
            for i in range(0, len(order), 1024):
                g = group[i : i + 1024]
                first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                for k, name in names.items():
                    sums = np.add.reduceat(counts_of(seqs[i : i + 1024], k), first)
                    at, kmer = np.nonzero(sums)
                    yield pd.DataFrame({by: keys.take(g[first][at]), "kmer": name[kmer], "n": sums[at, kmer]})

    kind = sequences.schema[by].dataType.simpleString()
    return sequences.select(by, "seq").mapInPandas(run, f"`{by}` {kind}, kmer string, n long").groupBy(by, "kmer").agg(F.sum("n").alias("n"))


def counts_of(seqs: Sequence[str | None], k: int) -> np.ndarray:
    """One row for each sequence: how often each k-mer of A, C, G and T occurs, in alphabetical order."""
    out = np.zeros((len(seqs), 4**k), np.int64)
    for i, s in enumerate(seqs):
        code = CODE[np.frombuffer((s or "").encode("ascii", "ignore"), np.uint8)].astype(np.int64)
        out[i] = (counts(code, k) - 1).astype(np.int64)
    return out


def log_probabilities(counts: DataFrame, by: str) -> DataFrame:
    """``(by, kmer, logp)`` of all 256 4-mers; those never seen count once."""
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    grid = total.withColumn("kmer", F.explode(F.array(*map(F.lit, FOURMERS))))
    return grid.join(counts, [by, "kmer"], "left").select(by, "kmer", F.log10(F.coalesce("n", F.lit(1)) / F.col("total")).alias("logp"))


def scores(counts: DataFrame, lengths: DataFrame, logs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(id, seed, score)``: sum of n * logp * 500 / length over the k-mers of a sequence.

    counts: ``(id, kmer, n)``, lengths: ``(id, length)``, logs: ``(seed, kmer, logp)``.
    Only for ``pairs(id, seed)`` if given, else for all seeds.
    """
    own = counts if pairs is None else counts.join(pairs, "id")
    sums = own.join(logs, ["kmer"] if pairs is None else ["seed", "kmer"]).groupBy("id", "seed").agg(F.sum(F.col("n") * F.col("logp")).alias("s"))
    return sums.join(lengths, "id").select("id", "seed", (F.col("s") * PER_LETTERS / F.col("length")).alias("score"))


#: Seeds whose log probabilities, 256 numbers each, go to all tasks at a time.
MOST_SEEDS = 16_384


def matrices(logs: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """About ``block`` seeds of ``logs(seed, kmer, logp)`` at a time: their names in order, and a row of 256 log probabilities for each, 2 KB."""
    shared_folder(logs.sparkSession)
    each = logs.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("kmer", "logp"))), lambda x: x["logp"]).alias("logp")).checkpoint()
    parts = max(1, -(-each.count() // block))
    for k in range(parts):
        some = each.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == k).toPandas().sort_values("seed")
        if len(some):
            yield some["seed"].to_numpy(), np.stack(some["logp"].to_numpy())


def scores_of_all(sequences: DataFrame, logs: DataFrame, block: int = MOST_SEEDS) -> DataFrame:
    """``sequences(id, seq)`` to ``(id, seed, score)`` with every seed of ``logs(seed, kmer, logp)``: counts of a batch times the seeds' matrix.

    Sequences without a k-mer have no row.
    """
    return by_blocks(sequences, logs, block, best=False)


def best_of_all(sequences: DataFrame, logs: DataFrame, block: int = MOST_SEEDS) -> DataFrame:
    """``sequences(id, seq)`` to ``(id, seed, score)``, the best seed of ``logs(seed, kmer, logp)`` for each; equal ones by the seed's name.

    Sequences without a k-mer have no row.
    """
    return best(by_blocks(sequences, logs, block, best=True))


def by_blocks(sequences: DataFrame, logs: DataFrame, block: int, best: bool) -> DataFrame:
    """``(id, seed, score)`` with all seeds, or with the best of each block of them."""
    schema = f"id {sequences.schema['id'].dataType.simpleString()}, seed {logs.schema['seed'].dataType.simpleString()}, score double"
    out = sequences.sparkSession.createDataFrame([], schema)
    for names, matrix in matrices(logs, block):
        out = out.unionByName(sequences.select("id", "seq").mapInPandas(scorer(names, sequences.sparkSession.sparkContext.broadcast(matrix), best), schema))
    return out


def scorer(names: np.ndarray, shared: Broadcast, best: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scores of batches with the seeds of a matrix, one row each in the order of their names; only the best one if asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i in range(0, len(p), 256):
                some = p.iloc[i : i + 256]
                n = counts_of(some["seq"].to_numpy(), 4)
                own = n.sum(axis=1) > 0
                ids, score = some["id"].to_numpy()[own], n[own] @ shared.value.T * PER_LETTERS / some["seq"].str.len().to_numpy(float)[own][:, None]
                if best:
                    at = score.argmax(axis=1) if len(score) else np.zeros(0, int)
                    yield pd.DataFrame({"id": ids, "seed": names[at], "score": score[np.arange(len(score)), at]})
                else:
                    yield pd.DataFrame({"id": np.repeat(ids, len(names)), "seed": np.tile(names, len(ids)), "score": score.ravel()})

    return run


def best(scored: DataFrame) -> DataFrame:
    """``(id, seed, score)`` of the greatest score; equal ones by the seed's name."""
    return scored.groupBy("id").agg(F.min_by(F.struct("seed", "score"), F.struct(-F.col("score"), "seed")).alias("b")).select("id", "b.*")


def best_with_margin(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``(id, seed, score, ambiguous)``: whether another seed's score is less than ``margin`` below the best."""
    top = scored.groupBy("id").agg(F.min_by(F.struct("seed", "score"), F.struct(-F.col("score"), "seed")).alias("b"), F.array_sort(F.collect_list(-F.col("score"))).alias("all"))  # as many as seeds
    return top.select("id", "b.seed", "b.score", F.coalesce(F.try_element_at("all", F.lit(2)) - F.col("all")[0] < margin, F.lit(False)).alias("ambiguous"))
