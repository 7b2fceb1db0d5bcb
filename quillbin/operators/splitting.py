"""Splitting of clusters that hold several species by their marker genes.

A cluster with k copies of enough marker genes gets k seeds: its core (what it is named by,
and marker sequences without repeated genes), then, one after another, the candidate that
is least alike to the seeds it has.  Candidates are the long sequences inside and packs of
short ones, see ``seeds.packs``.  All clusters are split at once, in as many rounds as the
largest k.  All seeds of a cluster have the coverage interval of the cluster, so whether a
sequence fits is a join on the cluster and never one of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbin.functions.statistics import toward_zero
from quillbin.operators import classify, composites, composition, coverage, markers, naive_bayes, occupancy
from quillbin.operators.seeds import packs
from quillbin.operators.shared import shared_folder

MARGIN = 7


@dataclass(frozen=True)
class Cover:
    """What coverage says: depth(id, sample, mean), dispersions(sample, sd1, sd2), intervals(seed, sample, mean, lo, hi) of the clusters, scores(id, seed, score) of their short sequences by naive Bayes, the fallback seed ``first``, and the sequences fixed(id, seed) that no step moves."""

    depth: DataFrame
    dispersions: DataFrame
    intervals: DataFrame
    scores: DataFrame
    first: str
    fixed: DataFrame


def repeated_ids(own: DataFrame, genes: DataFrame) -> DataFrame:
    """``(id, seed)`` of sequences with a gene that their cluster has more than once."""
    many = markers.copies(genes, own).where("copies > 1").select("seed", "gene")
    return own.join(genes, "id").join(many, ["seed", "gene"]).select("id", "seed").distinct()


def pairs_with(left: DataFrame, chosen: DataFrame, vectors: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``(seed, sub, p)``: candidates ``(seed, sub)`` with the one seed ``(seed, new)`` of their cluster."""
    both = left.join(chosen, "seed").select(F.col("sub").alias("a"), F.col("new").alias("b"), "seed")
    scored = composition.calibrated(composition.correlated(both, vectors), cutoffs)
    return scored.select("seed", F.col("a").alias("sub"), F.coalesce("p", F.lit(0.0)).alias("p"))


def farthest_first(candidates: DataFrame, species: DataFrame, vectors: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``(seed, sub)``: of each cluster itself, then in each round the one of ``candidates(seed, sub)`` with the least sum of p over the seeds it has, until there are ``species(seed, species)``.

    A pair is compared once, when its second member was chosen.
    """
    new = species.select("seed", F.col("seed").alias("new")).checkpoint()
    chosen, left = new, candidates.withColumn("sum", F.lit(0.0)).checkpoint()
    for k in range(1, int(species.agg(F.max("species")).first()[0] or 1)):
        still = left.join(species.where(F.col("species") > k).select("seed"), "seed", "left_semi")
        left = still.join(pairs_with(still, new, vectors, cutoffs), ["seed", "sub"]).select("seed", "sub", (F.col("sum") + F.col("p")).alias("sum")).checkpoint()
        new = left.groupBy("seed").agg(F.min_by("sub", F.struct("sum", "sub")).alias("new")).checkpoint()
        if new.isEmpty():
            break
        chosen = chosen.unionByName(new).checkpoint()
        left = left.join(new.withColumnRenamed("new", "sub"), ["seed", "sub"], "left_anti").checkpoint()
    return chosen.withColumnRenamed("new", "sub")


def packed(inside: DataFrame, lengths: DataFrame, cover: Cover | None, large: int) -> DataFrame:
    """``(seed, sub)``: packs of a cluster's short sequences ``inside(id, seed)``, named by their members."""
    if cover is None:
        return inside.select("seed", F.col("id").alias("sub")).limit(0)
    short = inside.join(lengths.where(F.col("length") < large), "id")
    rows = composites.samples_of(short.select("id", "length"), cover.depth, cover.dispersions).join(short.select("id", "seed"), "id").join(cover.scores, ["id", "seed"])
    return packs(rows, large, MARGIN, coverage.LOW).select("seed", F.array_join("members", ";").alias("sub")).distinct()


def sub_means(chosen: DataFrame, lengths: DataFrame, cover: Cover) -> DataFrame:
    """``(seed, sub, sample, mean, lo, hi)``: a cluster's own mean, a sequence's, or the whole part of a pack's weighted one, in the cluster's interval."""
    parts = composites.members_of(chosen.where("sub <> seed").select(F.col("sub").alias("id"))).withColumnRenamed("seed", "sub")
    own = parts.join(lengths, "id").join(cover.depth.select("id", "sample", "mean"), "id").groupBy("sub", "sample").agg(F.try_divide(F.sum(F.col("mean") * F.col("length")), F.sum("length")).alias("m"), F.count("*").alias("k"))
    of_parts = own.select("sub", "sample", F.when(F.col("k") > 1, toward_zero(F.col("m")).cast("double")).otherwise(F.col("m")).alias("own"))
    rows = chosen.join(cover.intervals, "seed").join(of_parts, ["sub", "sample"], "left")
    return rows.select("seed", "sub", "sample", F.coalesce("own", F.col("mean").cast("double")).alias("mean"), "lo", "hi")


def fitting(inside: DataFrame, chosen: DataFrame, means: DataFrame | None, cover: Cover | None, wildcard: bool = True, open_end: bool = False) -> DataFrame:
    """``(id, seed, sub)``: sequences with the seeds of their cluster whose coverage fits in all samples."""
    pairs = inside.select("id", "seed").join(chosen, "seed")
    if cover is None:
        return pairs
    m = F.col("m")
    upper = m < F.col("hi") if open_end else m <= F.col("hi")
    fits = (m >= F.col("lo")) & upper
    free = F.col("mean") < coverage.LOW
    ok = (free | fits) if wildcard else fits
    each = pairs.join(means, ["seed", "sub"]).join(cover.depth.select("id", "sample", F.col("mean").alias("m")), ["id", "sample"], "left")
    return each.groupBy("id", "seed", "sub").agg(F.min(F.coalesce(ok, free if wildcard else F.lit(False)).cast("int")).alias("ok")).where("ok = 1").select("id", "seed", "sub")


def split_clusters(assigned: DataFrame, genes: DataFrame, lengths: DataFrame, counts: DataFrame, cutoffs: DataFrame, least_genes: int = 7, large: int = 10_000, cover: Cover | None = None) -> DataFrame:
    """``assigned(id, seed)`` with clusters of several species split; sequences of other clusters keep their seed.

    counts: see ``composition.counted``.  Marker sequences with repeated genes are dealt out
    under copy-number rules, then long others by likeness and short ones by their naive
    Bayes score, to the seeds' vectors from what they have by then.  With ``cover``, a
    sequence has to fit a seed's coverage, and leaves the cluster if it fits none; a short
    one goes to the fallback seed then, if that is one of the cluster's.
    """
    shared_folder(assigned.sparkSession)
    species = markers.species_number(markers.copies(genes, assigned), least_genes).where("species > 1").checkpoint()
    own = assigned.join(species.select("seed"), "seed", "left_semi").select("id", "seed").checkpoint()
    if own.isEmpty():
        return assigned.select("id", "seed")
    marked = genes.select("id").distinct()
    once = own.join(marked, "id", "left_semi").join(repeated_ids(own, genes), ["id", "seed"], "left_anti")
    core = once if cover is None else once.unionByName(own.join(cover.fixed.select("id"), "id", "left_semi")).distinct()
    core = core.checkpoint()
    inside = own.join(core.select("id"), "id", "left_anti").checkpoint()
    long_ids = lengths.where(F.col("length") >= large).select("id")
    candidates = inside.join(long_ids, "id", "left_semi").select("seed", F.col("id").alias("sub")).unionByName(packed(inside, lengths, cover, large)).where("sub <> seed").checkpoint()
    # what stands for a seed: the core and what it is named by; a candidate is what it is named by
    named = lambda subs: composites.members_of(subs.select(F.col("sub").alias("id")).distinct()).select("id", "seed")
    stand = core.unionByName(named(species.select(F.col("seed").alias("sub")))).unionByName(named(candidates)).distinct().checkpoint()
    vectors = composition.cluster_vectors(counts, stand, lengths).checkpoint()
    chosen = farthest_first(candidates, species, vectors, cutoffs).checkpoint()
    means = None if cover is None else sub_means(chosen, lengths, cover).checkpoint()
    fit = lambda rows, **how: fitting(rows, chosen, means, cover, **how).select("id", F.col("sub").alias("seed"))
    fours = counts.where(F.length("kmer") == 4)
    logs_of = lambda rows: naive_bayes.log_probabilities(fours.join(rows, "id").groupBy("seed", "kmer").agg(F.sum("n").alias("n")), "seed")
    subs = chosen.select(F.col("sub").alias("seed"))
    single = composition.cluster_vectors(counts.join(inside.select("id"), "id", "left_semi"), inside.join(long_ids, "id", "left_semi").select("id", F.col("id").alias("seed")), lengths).checkpoint()
    # marker sequences
    tagged = inside.join(marked, "id", "left_semi").checkpoint()
    twins = markers.duplicates(genes)
    twin_ids = twins.select(F.col("a").alias("id")).union(twins.select("b")).distinct()
    short = tagged.join(long_ids, "id", "left_anti")
    short_pairs = fit(short.join(twin_ids, "id", "left_semi"), wildcard=False).unionByName(fit(short.join(twin_ids, "id", "left_anti")))
    long_rows = classify.long_markers(fit(tagged.join(long_ids, "id", "left_semi")), single, vectors.join(subs.withColumnRenamed("seed", "id"), "id", "left_semi"), cutoffs)
    short_rows = classify.short_markers(short_pairs, fours, lengths, logs_of(stand.join(subs, "seed", "left_semi")))
    by_gene = occupancy.assign_markers(long_rows, short_rows, genes, twins)
    # the others, with the seeds' vectors from what they have now
    has = core.unionByName(by_gene.select("id", "seed")).checkpoint()
    size = subs.join(has.join(lengths, "id").groupBy("seed").agg(F.sum("length").alias("size")), "seed", "left")
    small = size.where(F.coalesce("size", F.lit(0)) < large).select(F.col("seed").alias("sub"))
    again = has.unionByName(named(small)).distinct().checkpoint()
    rest = inside.join(tagged.select("id"), "id", "left_anti").checkpoint()
    by_likeness = classify.alike_of_several(fit(rest.join(long_ids, "id", "left_semi")), single, composition.cluster_vectors(counts, again, lengths), cutoffs)
    short = rest.join(long_ids, "id", "left_anti").checkpoint()
    pairs = fit(short, open_end=True)
    if cover is not None:
        home = chosen.where(F.col("sub") == cover.first).select("seed", F.col("sub"))
        pairs = pairs.unionByName(short.join(pairs.select("id"), "id", "left_anti").join(home, "seed").select("id", F.col("sub").alias("seed")))
    by_score = naive_bayes.best(naive_bayes.scores(fours, lengths, logs_of(again), pairs)).select("id", "seed")
    placed = core.unionByName(by_gene).unionByName(by_likeness).unionByName(by_score)
    if cover is None:  # what has no k-mers, and so no score, keeps its cluster
        placed = placed.unionByName(inside.join(placed.select("id"), "id", "left_anti"))
    return assigned.select("id", "seed").join(own.select("id"), "id", "left_anti").unionByName(placed)
