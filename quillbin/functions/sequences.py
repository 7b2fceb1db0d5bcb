"""Sequences as text columns: cleaning, reverse complements, k-mers and their z-scores."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

LETTERS = "ACGT"
#: All 4-mers in alphabetical order, the order of composition vectors.
FOURMERS = ["".join(x) for x in itertools.product(LETTERS, repeat=4)]


def cleaned(seq: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(seq, F.lit("")), "(?i)[^ATGC]", ""))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ATGC", "TACG")


def kmers(seq: Column, k: int) -> Column:
    """All overlapping pieces of k letters; none if there are fewer."""
    last = F.length(seq) - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def length_bucket(length: Column) -> Column:
    """Tens of thousands of letters as thousands, 210 at most."""
    return F.least(F.floor(length / 10_000) * 10, F.lit(210)).cast("int")


def counts(code: np.ndarray, k: int) -> np.ndarray:
    """Counts of all k-mers of letters coded 0 to 3, each one more than it occurs."""
    at = np.zeros(max(0, len(code) - k + 1), np.int64)
    for i in range(k):
        at = at * 4 + code[i : len(code) - k + 1 + i]
    return np.bincount(at, minlength=4**k).astype(float) + 1


CODE = np.full(256, 255, np.uint8)
CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(4)


def zscores(seq: str | None) -> np.ndarray:
    """Of each 4-mer abcd how far its count is from the one expected of abc, bcd and bc, over both strands."""
    own = CODE[np.frombuffer((seq or "").encode("utf-8", "replace"), np.uint8)]
    own = own[own < 4].astype(np.int64)
    both = np.concatenate((own, 3 - own[::-1]))
    return expected_scores(counts(both, 4), counts(both, 3), counts(both, 2))


def expected_scores(n4: np.ndarray, n3: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """From the counts of both strands, each one more than it is."""
    at = np.arange(256)
    abc, bcd, bc = n3[at >> 2], n3[at & 63], n2[at >> 2 & 15]
    below = (bc - abc) * (bc - bcd) * abc * bcd
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.sqrt(bc) * (n4 * bc - abc * bcd) / np.sqrt(below)
    return np.where(below > 0, z, 0.0)


def zscores_of(one_strand: dict[str, int]) -> np.ndarray:
    """From counts of 2-, 3- and 4-mers of one strand."""
    n = {k: np.ones(4**k) for k in (2, 3, 4)}
    for kmer, count in one_strand.items():
        own = CODE[np.frombuffer(kmer.encode(), np.uint8)].astype(np.int64)
        for code in (own, 3 - own[::-1]):
            n[len(own)][int((code * 4 ** np.arange(len(own))[::-1]).sum())] += count
    return expected_scores(n[4], n[3], n[2])


@F.pandas_udf(ArrayType(DoubleType()))
def composition(seqs: pd.Series) -> pd.Series:
    """The z-scores less their mean."""
    return pd.Series([(z := zscores(s)) - z.mean() for s in seqs])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def correlation(a: Column, b: Column, aa: Column, bb: Column) -> Column:
    """Of centred vectors with their sums of squares; 0 if one of them is 0."""
    return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(aa * bb))
