"""The whole binning: seeds, classification, splitting, merging, size filter, final classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbin.operators import classify, composites, composition, coverage, evaluation, markers, merging, naive_bayes, occupancy, seeds, splitting

LARGE = 10_000


@dataclass(frozen=True)
class Parameters:
    fold: float = 2.58
    min_length: int = 0
    large_length: int = 200_000
    small_length: int = 100_000
    bin_length: int = 500_000
    most_duplicates: int = 7
    most_shared: int = 9
    genes_for_split: int = 7
    genes_for_bin: int = 10


@dataclass(frozen=True)
class Inputs:
    """sequences(id, seq, length), depth(id, sample, mean, windows), genes(gene, id), cutoffs: see the readers.

    pinned(seed, id): seeds that a user names by their members, joined by ``;``.
    """

    sequences: DataFrame
    depth: DataFrame
    genes: DataFrame
    cutoffs: DataFrame
    pinned: DataFrame | None = None


def intervals_of(depth: DataFrame, dispersions: DataFrame, fold: float) -> DataFrame:
    """``(id, sample, mean, lo, hi)`` of long sequences as seeds."""
    rows = depth.join(F.broadcast(dispersions), "sample")  # one row for each sample
    ratio = coverage.dispersion(F.col("windows"), F.col("mean"))
    lo, hi = coverage.large_interval(F.col("mean"), ratio, F.col("sd1"), F.col("sd2"), fold)
    return rows.select("id", "sample", "mean", lo.alias("lo"), hi.alias("hi"))


def pair_table(cutoffs: DataFrame, column: str) -> dict[tuple[int, int], float]:
    """At most 21 by 21 thresholds."""
    return {(r["len1"], r["len2"]): r[column] for r in cutoffs.select("len1", "len2", column).collect()}


@dataclass(frozen=True)
class Seeds:
    """intervals(seed, sample, mean, lo, hi) and members(id, seed) of all seeds; fixed(id, seed): of those a user names, which no step moves; long: intervals of the long and named ones; first: the seed for short sequences that no seed's coverage fits."""

    intervals: DataFrame
    members: DataFrame
    fixed: DataFrame
    long: DataFrame
    first: str


def named_seeds(own: Inputs) -> DataFrame:
    """``(seed, id, place)`` of the seeds a user names."""
    if own.pinned is None:
        return own.sequences.limit(0).select(F.col("id").alias("seed"), "id", F.lit(0).alias("place"))
    known = own.pinned.join(own.sequences.select("id"), "id", "left_semi")
    return known.select("seed", "id", (F.array_position(F.split("seed", ";"), F.col("id")) - 1).cast("int").alias("place")).distinct()


def first_seed(own: Inputs, named: DataFrame, nodes: DataFrame, found: DataFrame) -> str:
    """The first seed that a user names, else the first long one, by the mean in the first sample; none without seeds.

    Named seeds are in the order of ``line``, if they have it, else of their names.
    """
    if own.pinned is not None and not named.isEmpty():
        line = F.col("line") if "line" in own.pinned.columns else F.lit(0)
        return own.pinned.join(named.select("seed").distinct(), "seed", "left_semi").agg(F.min_by("seed", F.struct(line, "seed"))).first()[0]
    return nodes.join(found, "id", "left_semi").agg(F.min_by("id", F.struct("rank", "id"))).first()[0] or ""


def all_seeds(own: Inputs, dispersions: DataFrame, par: Parameters) -> Seeds:
    """Seeds a user names, long sequences that no earlier seed is like in coverage and composition, and composites of short ones.

    Gaps between the intervals of all seeds are filled.
    """
    lengths = own.sequences.select("id", "length")
    named = named_seeds(own).checkpoint()
    free = own.sequences.where(F.col("length") >= par.min_length).join(named.select("id"), "id", "left_anti")
    spans = composites.intervals(named, own.depth, lengths, dispersions, par.fold, low_is_free=False).checkpoint()
    texts = composites.texts(named, own.sequences)
    before = composition.vectors(texts).join(composites.by_samples(spans), "id").join(texts.select("id", "seq"), "id").checkpoint()
    big = free.where(F.col("length") >= LARGE)
    big_spans = intervals_of(own.depth, dispersions, par.fold).join(big.select("id"), "id", "left_semi").withColumnRenamed("id", "seed").checkpoint()
    nodes = composition.vectors(big).join(composites.by_samples(big_spans), "id").checkpoint()
    diff = pair_table(own.cutoffs, "diff")
    found = seeds.leaders_by_vector(nodes, seeds.Alike(diff, coverage=True), before=before).checkpoint()
    long_spans = spans.unionByName(big_spans.join(found.withColumnRenamed("id", "seed"), "seed", "left_semi")).checkpoint()
    standing = nodes.join(found, "id", "left_semi").unionByName(before.select(*nodes.columns))
    corpus = composites.Corpus(free, own.depth, dispersions, diff, pair_table(own.cutoffs, "cutoff"), par.fold, LARGE)
    more, packed = composites.of_short(corpus, nodes, standing, before)
    whole = long_spans.unionByName(more).checkpoint()
    gapless = coverage.gaps_filled(whole.select("seed", "sample", "lo", "hi"), own.depth.select("sample", "mean"))
    members = named.unionByName(packed).select("id", "seed").unionByName(found.select("id", F.col("id").alias("seed")))
    return Seeds(gapless.join(whole.select("seed", "sample", "mean"), ["seed", "sample"]).checkpoint(), members.checkpoint(), named.select("id", "seed").distinct().checkpoint(), long_spans, first_seed(own, named, nodes, found))


@dataclass(frozen=True)
class Features:
    """counts: 2-, 3- and 4-mers of every sequence; vectors: of the long ones."""

    counts: DataFrame
    vectors: DataFrame

    @classmethod
    def of(cls, own: Inputs) -> Features:
        return cls(composition.counted(own.sequences).checkpoint(), composition.vectors(own.sequences.where(F.col("length") >= LARGE)).checkpoint())


def assign(own: Inputs, features: Features, seed_intervals: DataFrame, members: DataFrame, n_samples: int, first: str) -> DataFrame:
    """``(id, seed, score)``: all sequences by coverage and composition, short ones with their score; members: ``(id, seed)`` that stand for the seeds."""
    lengths = own.sequences.select("id", "length")
    long_ids = features.vectors.select("id")
    means = own.depth.select("id", "sample", "mean")
    seed_comp = composition.cluster_vectors(features.counts, members, lengths)
    large = classify.classify_large(means.join(long_ids, "id", "left_semi"), seed_intervals, features.vectors, seed_comp, own.cutoffs, n_samples)
    fours = features.counts.where(F.length("kmer") == 4)
    logs = naive_bayes.log_probabilities(fours.join(members, "id").groupBy("seed", "kmer").agg(F.sum("n").alias("n")), "seed")
    small = classify.classify_small(means.join(long_ids, "id", "left_anti"), seed_intervals, fours.join(long_ids, "id", "left_anti"), lengths, logs, n_samples, first)
    return large.withColumn("score", F.lit(None).cast("double")).unionByName(small.select("id", "seed", "score"))


def place_markers(own: Inputs, features: Features, seed_intervals: DataFrame, members: DataFrame, n_samples: int) -> DataFrame:
    """``(id, seed)`` of the marker sequences whose coverage fits a seed, see ``occupancy``; seeds of low coverage are no candidates of short ones with duplicates."""
    lengths = own.sequences.select("id", "length")
    ids = own.genes.select("id").distinct().join(lengths, "id").checkpoint()
    depth = own.depth.select("id", "sample", "mean")
    twins = markers.duplicates(own.genes).checkpoint()
    twin_ids = twins.select(F.col("a").alias("id")).union(twins.select("b")).distinct()
    long, short = ids.where(F.col("length") >= LARGE).select("id"), ids.where(F.col("length") < LARGE).select("id")
    within = lambda some, **how: coverage.within(depth.join(some, "id", "left_semi"), seed_intervals, n_samples, **how)
    pairs = within(short.join(twin_ids, "id", "left_semi"), wildcard=False).unionByName(within(short.join(twin_ids, "id", "left_anti")))
    fours = features.counts.where(F.length("kmer") == 4)
    logs = naive_bayes.log_probabilities(fours.join(members.select("id", "seed"), "id").groupBy("seed", "kmer").agg(F.sum("n").alias("n")), "seed")
    seed_comp = composition.cluster_vectors(features.counts, members.select("id", "seed"), lengths)
    long_rows = classify.long_markers(within(long), features.vectors, seed_comp, own.cutoffs)
    return occupancy.assign_markers(long_rows, classify.short_markers(pairs, fours, lengths, logs), own.genes, twins)


def species_of(own: Inputs, clusters: DataFrame, least: int, more_than: bool = True) -> DataFrame:
    """``(seed, species, length)`` of clusters."""
    sizes = clusters.join(own.sequences.select("id", "length"), "id").groupBy("seed").agg(F.sum("length").alias("length"))
    species = markers.species_number(markers.copies(own.genes, clusters), least, more_than)
    return sizes.join(species, "seed", "left").na.fill(0, ["species"])


def merge_all(own: Inputs, features: Features, assigned: DataFrame, dispersions: DataFrame, par: Parameters) -> tuple[DataFrame, DataFrame]:
    """Clusters after the first and after the last of three merges: of clusters of one species at most, the others set aside; of all, by marker sequences and the genes in both; and of all again, where short ones need no likeness."""
    lengths, means = own.sequences.select("id", "length"), own.depth.select("id", "sample", "mean")
    several = species_of(own, assigned, par.genes_for_split).where("species > 1").select("seed").checkpoint()
    rest = (means, lengths, features.counts, own.genes, own.cutoffs)
    one = merging.merged(assigned.join(several, "seed", "left_anti"), *rest, par.most_duplicates)
    first = one.unionByName(assigned.join(several, "seed", "left_semi").select("id", "seed")).checkpoint()
    state = merging.merged(first, *rest, par.most_shared, "both", dispersions)
    return first, merging.merged(state, *rest, par.most_duplicates, "twice", dispersions, par.bin_length)


@dataclass(frozen=True)
class Result:
    """What the stages give: clusters as ``(id, seed)``, intervals as ``(seed, sample, mean, lo, hi)``.

    long, seeds: intervals of the long seeds and of all; raw, split, first, merged: clusters
    after classification, splitting, the first and the last merge; final: intervals of the
    bins; bins: see ``bin_sequences``.
    """

    long: DataFrame
    seeds: DataFrame
    raw: DataFrame
    split: DataFrame
    first: DataFrame
    merged: DataFrame
    final: DataFrame
    bins: DataFrame


def bin_sequences(own: Inputs, par: Parameters = Parameters()) -> DataFrame:
    """``(id, seq, length, seed, bin)``: every sequence, bins numbered by mean, ``unassigned`` where no seed fits."""
    return stages(own, par).bins


def stages(own: Inputs, par: Parameters = Parameters()) -> Result:
    """The whole binning; what several stages read (vectors, k-mer counts, assignments) is checkpointed once."""
    seeds.shared_folder(own.sequences.sparkSession)
    dispersions = coverage.sample_dispersion(own.depth).checkpoint()
    n_samples = dispersions.count()
    found = all_seeds(own, dispersions, par)
    features = Features.of(own)
    scored = assign(own, features, found.intervals, found.members, n_samples, found.first).join(found.fixed, "id", "left_anti").unionByName(found.fixed, allowMissingColumns=True).checkpoint()
    raw = scored.select("id", "seed")
    cover = splitting.Cover(own.depth, dispersions, found.intervals, scored.where("score is not null"), found.first, found.fixed)
    split = splitting.split_clusters(raw, own.genes, own.sequences.select("id", "length"), features.counts, own.cutoffs, par.genes_for_split, LARGE, cover).checkpoint()
    lengths, means = own.sequences.select("id", "length"), own.depth.select("id", "sample", "mean")
    after = markers.kept_after_split(species_of(own, split, par.genes_for_split), par.large_length, par.small_length).select("seed")
    assigned = split.join(after, "seed", "left_semi").select("id", "seed").checkpoint()
    first, merged = merge_all(own, features, assigned, dispersions, par)
    kept = markers.kept_at_last(species_of(own, merged, par.genes_for_bin, more_than=False), par.bin_length).select("seed")
    clusters = merged.join(kept, "seed", "left_semi").select("id", "seed").checkpoint()
    if clusters.isEmpty():
        bins = own.sequences.select("*", F.lit(None).cast("string").alias("seed"), F.lit(evaluation.UNASSIGNED).alias("bin"))
        return Result(found.long, found.intervals, raw, split, first, merged, found.intervals.limit(0), bins)
    stand = merging.standing(clusters, own.genes, lengths).checkpoint()
    filled = merging.cluster_intervals(stand, means, lengths, dispersions, par.fold)
    stand = stand.select("id", "seed")
    gapless = coverage.gaps_filled(filled.select("seed", "sample", "lo", "hi"), means.select("sample", "mean"))
    final = gapless.join(filled.select("seed", "sample", "mean"), ["seed", "sample"]).checkpoint()
    means_of = final.groupBy("seed").agg(F.max_by("mean", -F.col("sample")).alias("mean"))
    # what a user named stays; marker sequences first, under copy-number rules; those without a fitting seed stay where they are
    named = clusters.join(found.fixed.select("id"), "id", "left_semi")
    placed = named.unionByName(place_markers(own, features, final, stand, n_samples).join(named.select("id"), "id", "left_anti")).checkpoint()
    fixed = placed.unionByName(clusters.join(own.genes.select("id").distinct(), "id", "left_semi").join(placed, "id", "left_anti"))
    again = assign(own, features, final, stand, n_samples, found.first).select("id", "seed").join(fixed.select("id"), "id", "left_anti")
    bins = evaluation.classified(fixed.unionByName(again), own.sequences, means_of)
    return Result(found.long, found.intervals, raw, split, first, merged, final, bins)
