"""Seeds of several sequences: composites of short ones, and seeds that a user names.

A composite's id is its members' ids joined by ``;``.  It has less than twice the letters of
a long sequence, so its text and windows are small, however many composites there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbin.functions.statistics import deviation, given, toward_zero, trimmed
from quillbin.operators import composition, coverage, naive_bayes, seeds

#: Places of packs within a seed, in a rank that holds the seed's place as well.
PLACES = 1 << 33


def is_key(member: Column, seed: Column) -> Column:
    """Whether a sequence is one of those that a seed is named by."""
    return F.array_contains(F.split(seed, ";"), member)


def members_of(named: DataFrame) -> DataFrame:
    """``named(id)`` to ``(seed, id, place)``."""
    return named.select(F.col("id").alias("seed"), F.posexplode(F.split("id", ";")).alias("place", "id")).select("seed", "id", "place")


def texts(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """``members(seed, id, place)`` to ``(id, seq, length)`` of the seeds: their members' letters one after another."""
    rows = members.join(sequences.select("id", "seq"), "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("place", "seq"))).alias("s"))
    seq = F.array_join(F.transform("s", lambda x: x["seq"]), "")
    return rows.select(F.col("seed").alias("id"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


def intervals(members: DataFrame, depth: DataFrame, lengths: DataFrame, dispersions: DataFrame, fold: float = coverage.FOLD, low_is_free: bool = True) -> DataFrame:
    """``(seed, sample, mean, lo, hi)`` of ``members(seed, id, place)``: the whole part of the weighted mean, ``fold`` dispersions of all members' windows about it.

    A mean below ``LOW`` has the interval (0, 0), or with low_is_free off that of the
    sample's own dispersion; fewer than three windows also leave that.
    """
    own = members.join(lengths, "id").join(depth, "id").groupBy("seed", "sample").agg(F.array_sort(F.collect_list(F.struct("place", "mean", "length", "windows"))).alias("s"))
    letters = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    total = F.aggregate("s", F.lit(0.0), lambda n, x: n + x["mean"] * x["length"])
    rows = own.select("seed", "sample", toward_zero(F.try_divide(total, letters)).alias("mean"), F.flatten(F.transform("s", lambda x: F.coalesce(x["windows"], F.array().cast("array<double>")))).alias("windows"))
    spread = F.try_divide(given(trimmed(F.col("windows")), lambda x: deviation(x, F.col("mean"))), F.col("mean"))
    known = (F.size("windows") >= 3) & (F.col("mean") >= coverage.LOW)
    rows = rows.withColumn("ratio", F.when(known, spread)).join(F.broadcast(dispersions), "sample")  # one row for each sample
    lo, hi = coverage.large_interval(F.col("mean"), F.col("ratio"), F.col("sd1"), F.col("sd2"), fold)
    free = (F.col("mean") < coverage.LOW) if low_is_free else F.lit(False)
    return rows.select("seed", "sample", F.col("mean").cast("double").alias("mean"), F.when(free, F.lit(0)).otherwise(lo).cast("long").alias("lo"), F.when(free, F.lit(0)).otherwise(hi).cast("long").alias("hi"))


def samples_of(short: DataFrame, depth: DataFrame, dispersions: DataFrame) -> DataFrame:
    """``(id, length, means, sds)`` of short sequences with a mean in every sample; sds: each sample's own dispersion."""
    by_sample = F.array_sort(F.collect_list(F.struct("sample", F.col("mean").cast("double").alias("mean"), F.col("sd1").cast("double").alias("sd1"))))
    rows = depth.where("mean is not null").join(F.broadcast(dispersions), "sample").join(short.select("id", "length"), "id").groupBy("id", "length").agg(by_sample.alias("s"))
    whole = rows.join(dispersions.agg(F.count("*").alias("all")), F.size("s") == F.col("all"), "left_semi")
    return whole.select("id", "length", F.transform("s", lambda x: x["mean"]).alias("means"), F.transform("s", lambda x: x["sd1"]).alias("sds"))


@dataclass(frozen=True)
class Corpus:
    """sequences(id, seq, length) of at least the least length, depth(id, sample, mean, windows), dispersions(sample, sd1, sd2).

    diff and cutoff: thresholds by the pair of length buckets.
    """

    sequences: DataFrame
    depth: DataFrame
    dispersions: DataFrame
    diff: dict[tuple[int, int], float]
    cutoff: dict[tuple[int, int], float]
    fold: float
    large: int

    def short(self) -> DataFrame:
        return self.sequences.where(F.col("length") < self.large)

    def best(self, named: DataFrame) -> DataFrame:
        """``(id, seed, score)`` of short sequences: the best of seeds given as ``(id, seq)``."""
        logs = naive_bayes.log_probabilities(naive_bayes.kmer_counts(named.select(F.col("id").alias("seed"), "seq"), "seed"), "seed")
        return naive_bayes.best_of_all(self.short(), logs)

    def packs(self, scored: DataFrame) -> DataFrame:
        """``(seed, n, id)``: packs of each seed's sequences, id being the composite's."""
        rows = scored.join(samples_of(self.short(), self.depth, self.dispersions), "id")
        return seeds.packs(rows, self.large, 7, coverage.LOW).select("seed", "n", F.array_join("members", ";").alias("id"))


def by_composition(own: Corpus, nodes: DataFrame, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(added(id), scored(id, seed, score))``: composites unlike all seeds chosen by composition alone, and the best of these seeds for each short sequence.

    nodes: ``(id, rank, vec, bucket)`` of long sequences, rank below ``PLACES``; pinned:
    ``(id, seq, rank, vec, bucket)``.  Composites of seeds with many sequences come first.
    """
    alone = seeds.leaders_by_vector(nodes, seeds.Alike(own.cutoff), before=pinned).checkpoint()
    chosen = nodes.join(alone, "id", "left_semi").select("id", "rank", "vec", "bucket")
    named = own.sequences.join(alone, "id", "left_semi").select("id", "seq")
    if pinned is not None:
        chosen, named = chosen.unionByName(pinned.select(*chosen.columns)), named.unionByName(pinned.select("id", "seq"))
    scored = own.best(named).checkpoint()
    number = scored.groupBy("seed").agg((-F.count("*")).alias("less"))
    placed = coverage.numbered(number, "less", ties=["seed"]).select("seed", (F.col("n") * PLACES).alias("from"))
    packed = own.packs(scored).join(placed, "seed").select("id", (F.col("from") + F.col("n")).alias("rank")).checkpoint()
    vectors = composition.vectors(texts(members_of(packed), own.sequences)).join(packed, "id")
    return seeds.leaders_by_vector(vectors, seeds.Alike(own.diff), before=chosen).checkpoint(), scored


def of_short(own: Corpus, nodes: DataFrame, standing: DataFrame, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(intervals(seed, sample, mean, lo, hi), members(seed, id, place))`` of the composites that no seed is like in coverage and composition.

    nodes and pinned: see ``by_composition``; standing: ``(id, rank, vec, bucket, means, lo,
    hi)`` of the seeds there are.  Short sequences go to the best of all seeds by composition,
    those of the first pass if they score higher; where that pass adds none, there are no
    composites at all, as the pipeline has always had it.
    """
    added, scored = by_composition(own, nodes, pinned)
    lengths = own.sequences.select("id", "length")
    again = own.best(texts(members_of(added), own.sequences))
    both = again.withColumn("late", F.lit(0)).unionByName(scored.withColumn("late", F.lit(1)))
    if added.isEmpty():
        both = both.limit(0)
    best = both.groupBy("id").agg(F.min_by(F.struct("seed", "score"), F.struct(-F.col("score"), "late", "seed")).alias("b")).select("id", "b.*").checkpoint()
    packed = own.packs(best).select("id").distinct().checkpoint()
    members = members_of(packed).checkpoint()
    spans = intervals(members, own.depth, lengths, own.dispersions, own.fold).checkpoint()
    vectors = composition.vectors(texts(members, own.sequences)).join(by_samples(spans), "id")
    kept = seeds.leaders_by_vector(vectors, seeds.Alike(own.diff, coverage=True), before=standing).withColumnRenamed("id", "seed").checkpoint()
    return spans.join(kept, "seed", "left_semi"), members.join(kept, "seed", "left_semi")


def by_samples(spans: DataFrame) -> DataFrame:
    """``(id, rank, means, lo, hi)`` of ``(seed, sample, mean, lo, hi)``: one array entry for each sample; rank: by the first sample's mean, greatest first."""
    by_sample = F.array_sort(F.collect_list(F.struct("sample", "mean", "lo", "hi")))
    rows = spans.groupBy(F.col("seed").alias("id")).agg(by_sample.alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name].cast("double"))
    first = F.col("s")[0]["mean"]
    return rows.select("id", (-first * 100).cast("long").alias("rank"), pick("mean").alias("means"), pick("lo").alias("lo"), pick("hi").alias("hi"))
