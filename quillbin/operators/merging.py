"""Agglomeration of clusters whose composition and coverage agree, guarded by marker genes.

Pairs whose coverage agrees come from a join of intervals by cells of one sample, that in
which the first cluster's interval is narrowest; the merges of a round are those of one
pass over the clusters in order, most of which need the partners they like best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.operators import composition, coverage, markers, shared
from quillbin.operators.composites import is_key
from quillbin.operators.shared import shared_folder, tiles


#: So many marker sequences of a cluster stand for all of it.
MARKERS = 10
#: Pairs of whole lists and of lists that are cut that a task streams through, about, and partners of a lead in the latter.
RANGE_PAIRS, HEAD_PAIRS, HEAD = 1_000_000, 4_000_000, 16
#: Clusters of each side whose intervals are compared at once.
MEETING = 1_024


def standing(assigned: DataFrame, genes: DataFrame, lengths: DataFrame, least: int = MARKERS, short: int = 10_000) -> DataFrame:
    """``(id, seed, marked)``: the sequences that stand for a cluster: its marker sequences where there are ``least`` of them (and its seed, if they are ``short`` together), else all."""
    own = assigned.select("id", "seed").join(genes.select("id").distinct(), "id", "left_semi").join(lengths, "id")
    many = own.groupBy("seed").agg(F.count("*").alias("n"), F.sum("length").alias("size")).where(F.col("n") >= least)
    marked = own.join(many.select("seed"), "seed", "left_semi").select("id", "seed")
    key = assigned.join(many.where(F.col("size") < short).select("seed"), "seed", "left_semi").where(is_key(F.col("id"), F.col("seed"))).select("id", "seed")
    rest = assigned.select("id", "seed").join(many.select("seed"), "seed", "left_anti")
    return marked.unionByName(key).distinct().withColumn("marked", F.lit(True)).unionByName(rest.withColumn("marked", F.lit(False)))


def cluster_intervals(stand: DataFrame, depth: DataFrame, lengths: DataFrame, dispersions: DataFrame, fold: float = coverage.FOLD) -> DataFrame:
    """``(seed, sample, mean, lo, hi)`` from ``standing`` sequences: by their dispersion for marked clusters, else from the least to the greatest mean."""
    rows = stand.join(depth, "id").join(lengths, "id").select("seed", "sample", "mean", "length", "marked")
    by_marker = coverage.marker_interval(rows.where("marked").drop("marked"), dispersions, fold)
    return by_marker.unionByName(coverage.member_interval(rows.where("not marked").drop("marked")))


def met(a: pa.Table, b: pa.Table, least: float) -> pa.Table:
    """The pairs of a tile's two sides (see ``meeting``), each in the last of its cells' firsts only."""
    number = lambda t, c: t.column(c).to_numpy()
    wide = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    names, scored = ["a", "b", "ra", "inside", "distance"], "vec" in a.column_names
    i = j = np.zeros(0, np.int64)
    inside, distance, cor = np.zeros(0, bool), np.zeros(0), np.zeros(0)
    if len(a) and len(b):
        _, rank = np.unique(np.array(a.column("seed").to_pylist() + b.column("seed").to_pylist(), object), return_inverse=True)
        (am, bm), (af, bf), (ar, br) = [(number(a, c), number(b, c)) for c in ("m", "first")] + [(rank[: len(a)], rank[len(a) :])]
        al, bl = ([wide(t, c).T for c in ("mean", "lo", "hi")] for t in (a, b))
        found = []
        for s in range(0, len(a), 256):  # a slice's tables of flags fit a processor's memory
            x = slice(s, s + 256)
            own = am[x, None]
            fits = (np.maximum(af[x, None], bf) == a.column("cell")[0].as_py()) & ((own > bm) | ((own == bm) & (ar[x, None] < br)))
            for (m, lo, hi), (om, olo, ohi) in zip(zip(*al, strict=True), zip(*bl, strict=True), strict=True):
                lo, hi = lo[x, None], hi[x, None]
                fits &= (m[x, None] < coverage.LOW) | ((om >= lo) & (om <= hi)) | ((olo < hi) & (ohi > lo))
            p, q = np.nonzero(fits)
            found.append((p + s, q))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True))
        if scored:
            u, v, square = wide(a, "vec"), wide(b, "vec"), number(a, "ss")[i] * number(b, "ss")[j]
            cor = np.zeros(len(i))
            for k in range(u.shape[1]):
                cor += u[i, k] * v[j, k]
            zero = (number(a, "ss")[i] == 0) | (number(b, "ss")[j] == 0)
            cor = np.where(zero, 0.0, cor / np.sqrt(np.where(zero, 1.0, square)))
            some = cor >= least
            i, j, cor = i[some], j[some], cor[some]
        inside, distance = np.ones(len(i), bool), np.zeros(len(i))
        for (m, lo, hi), om in zip(zip(*al, strict=True), bl[0], strict=True):
            inside &= (m[i] < coverage.LOW) | ((om[j] >= lo[i]) & (om[j] <= hi[i]))
            distance += (m[i] - om[j]) * (m[i] - om[j])
    columns = [a.column("seed").take(pa.array(i)), b.column("seed").take(pa.array(j)), a.column("m").take(pa.array(i)), pa.array(inside), pa.array(distance)]
    return pa.table(dict(zip([*names, "cor"], [*columns, pa.array(cor)], strict=True)) if scored else dict(zip(names, columns, strict=True)))


def meeting(intervals: DataFrame, vectors: DataFrame | None = None, least: float = -2.0) -> DataFrame:
    """``intervals(seed, sample, mean, lo, hi)``, in the same samples for all, to pairs ``(a, b, ra, inside, distance)``, a before b by mean.

    In every sample b's mean lies in a's interval, or the intervals overlap, or a's mean is
    low; inside: everywhere without the second.  ra is a's mean in the first sample.
    Only one sample of a is cut to cells, so what is joined does not grow with the samples;
    the others are compared where two rows meet, in tiles of a cell (see ``tiled``).
    With ``vectors(seed, vec, ss)``, centred and alike in size, pairs have their correlation
    ``cor``, at least ``least``: it is asked for where two rows meet, so no pair looks up a vector.
    """
    shared_folder(intervals.sparkSession)
    width = {r["sample"]: max(float(r["w"] or 1.0), 1e-9) for r in intervals.groupBy("sample").agg(F.avg(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).alias("w")).collect()}  # a number for each sample
    widths = F.array(*[F.lit(width[k]) for k in sorted(width)])
    by_sample = F.array_sort(F.collect_list(F.struct("sample", "mean", "lo", "hi")))
    rows = intervals.groupBy("seed").agg(by_sample.alias("s"), F.max_by("mean", -F.col("sample")).cast("double").alias("m"))
    pick = lambda name: F.transform("s", lambda x: x[name].cast("double")).alias(name)
    rows = rows.select("seed", "m", pick("mean"), pick("lo"), pick("hi"))
    more = [] if vectors is None else ["vec", "ss"]
    if vectors is not None:
        rows = rows.join(vectors.select("seed", *more), "seed")
    places = F.sequence(F.lit(0), F.size("mean") - 1)
    # a's narrowest bound sample; where it is low in all, b lies below its own mean in the first
    bound = F.filter(F.transform(places, lambda k: F.struct((F.greatest(F.get("hi", k) - F.get("lo", k), F.lit(0.0)) / F.get(widths, k)).alias("part"), k.alias("k"), F.get("lo", k).alias("lo"), F.get("hi", k).alias("hi"), F.get("mean", k).alias("mean"))), lambda x: x["mean"] >= coverage.LOW)
    low = F.struct(F.lit(0.0).alias("part"), F.lit(0).alias("k"), F.least(F.lit(0.0), F.get("mean", F.lit(0))).alias("lo"), F.get("mean", F.lit(0)).alias("hi"), F.get("mean", F.lit(0)).alias("mean"))
    cell = lambda x, k: F.floor(x / F.get(widths, k)).cast("long")
    a = rows.withColumn("c", F.coalesce(F.get(F.array_sort(bound), F.lit(0)), low)).select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], F.col("c.k").alias("k"), cell(F.col("c.lo"), F.col("c.k")).alias("a_first"), cell(F.greatest("c.lo", "c.hi"), F.col("c.k")).alias("a_last"))
    a = a.withColumn("cell", F.explode(F.sequence("a_first", "a_last")))
    # a mean may lie outside its interval
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], F.explode(places).alias("k"))
    b = b.withColumn("b_first", cell(F.least(F.get("b_lo", F.col("k")), F.get("b_mean", F.col("k"))), F.col("k"))).withColumn("b_last", cell(F.greatest(F.get("b_hi", F.col("k")), F.get("b_mean", F.col("k"))), F.col("k")))
    b = b.withColumn("cell", F.explode(F.sequence("b_first", "b_last")))
    a = a.select("k", "cell", *[F.col(f"a_{c}").alias(c) for c in ("seed", "m", "first", "mean", "lo", "hi", *more)]).checkpoint()
    b = b.select("k", "cell", *[F.col(f"b_{c}").alias(c) for c in ("seed", "m", "first", "mean", "lo", "hi", *more)]).checkpoint()
    a, b, keys = tiles(a, b, ["k", "cell"], "seed", "seed", min(shared.TILE, MEETING))
    kind = intervals.schema["seed"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, ra double, inside boolean, distance double" + (", cor double" if more else "")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: met(x, y, least), schema)


def candidates(intervals: DataFrame, comp: DataFrame, copied: DataFrame, cutoffs: DataFrame, most_duplicates: int, guard: str = "twice", small: DataFrame | None = None) -> DataFrame:
    """``(a, b, inside, p, distance)``, a before b by mean: pairs that may merge.

    Their correlation reaches the cutoff, the guard (genes ``twice`` in both together, or in
    ``both``) is at most ``most_duplicates``, and b's mean lies in a's interval in every
    sample (inside) or their intervals overlap.  With ``small(seed)``, those clusters merge
    whatever the correlation, and only the mean inside counts.
    """
    pairs = meeting(intervals)
    shared = markers.shared_genes(copied)
    shared = shared.unionByName(shared.withColumnsRenamed({"a": "x", "b": "a"}).withColumnsRenamed({"x": "b"}))
    own = copied.groupBy("seed").agg(F.count(F.when(F.col("copies") > 1, 1)).alias("own"))
    pairs = pairs.join(shared, ["a", "b"], "left").join(own.withColumnsRenamed({"seed": "a", "own": "own_a"}), "a", "left").join(own.withColumnsRenamed({"seed": "b", "own": "own_b"}), "b", "left")
    count = F.coalesce(F.col(guard), F.lit(0) if guard == "both" else F.coalesce("own_a", F.lit(0)) + F.coalesce("own_b", F.lit(0)))
    scored = composition.calibrated(composition.correlated(pairs.where(count <= most_duplicates), comp), cutoffs)
    enough = F.col("cor") >= F.col("cutoff")
    if small is not None:
        flag = lambda c: small.select(F.col("seed").alias(c), F.lit(True).alias(f"small_{c}"))
        scored = scored.where("inside").join(flag("a"), "a", "left").join(flag("b"), "b", "left")
        enough = F.coalesce(enough, F.lit(False)) | F.col("small_a").isNotNull() | F.col("small_b").isNotNull()
    return scored.where(enough).select("a", "b", "ra", "inside", "p", "distance")


def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows ``(a, b, m, more)`` in the order of lead and preference: each lead that is not gone takes its first partner that is not.

    A row with ``more`` ends a list that was cut: a lead that comes to it free ends the pass, and is named without a seed.
    """
    lead = None
    gone: set[str] = set()
    free = over = False
    for batch in batches:
        new = []
        for a, b, m, more in () if over else zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "more")), strict=True):
            if a != lead:
                lead, free = a, a not in gone
            if not free:
                continue
            if more:
                new.append((None, a, m))
                over = True
                break
            if b not in gone:
                gone.add(b)
                free = False
                new.append((b, a, m))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["seed", "to", "m"])


def matched(pairs: DataFrame, farthest: bool = True, range_pairs: int | None = None) -> DataFrame:
    """Of candidate pairs ``(a, b, ra, inside, p, distance)`` the merges of one round, ``(seed, to)``, one partner for each lead.

    Leads come by mean, then by name, and each takes one partner that is still free, unless
    it was taken itself.  Partners with their mean inside come first, the most alike one; of
    others the farthest (as the pipeline has always had it) or the nearest.  A pass in one task
    reads the first ``range_pairs`` pairs, about (``RANGE_PAIRS`` by default), whole and of later
    leads the ``HEAD`` partners they want most, up to ``HEAD_PAIRS``.  It ends where a lead finds
    all of those taken; what is left over and free is ordered anew for the next pass.
    """
    spark = pairs.sparkSession
    shared_folder(spark)
    most = range_pairs or RANGE_PAIRS
    far = F.when(F.col("inside"), -F.coalesce("p", F.lit(0.0))).otherwise(F.col("distance") * (-1 if farthest else 1))
    rest = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (-F.col("ra").cast("double")).alias("m"), (~F.col("inside")).alias("out"), far.cast("double").alias("far")).checkpoint()
    found = rest.select(F.col("b").alias("seed"), F.col("a").alias("to")).limit(0)
    while n := rest.count():
        rows, at, again = rest.withColumn("more", F.lit(False)), None, False
        if n > most:
            each = rest.groupBy("m", "a").agg(F.count("*").alias("k")).select(F.lit(0).alias("all"), F.struct("m", "a").alias("lead"), "k", F.least("k", F.lit(HEAD + 1)).alias("head"))
            leads = coverage.running(coverage.running(each, "all", "lead", "k").withColumnRenamed("to", "upto"), "all", "lead", "head")
            leads = leads.where(F.col("to") - F.col("head") < HEAD_PAIRS).select("lead", F.col("lead.a").alias("a"), (F.col("upto") - F.col("k") < most).alias("whole")).checkpoint()
            at = leads.agg(F.max("lead")).first()[0]  # one lead
            place = F.row_number().over(W.partitionBy("a").orderBy("out", "far", "b"))
            heads = rest.join(leads.where("not whole").select("a"), "a", "left_semi").withColumn("place", place).where(F.col("place") <= HEAD + 1)
            rows = rest.join(leads.where("whole").select("a"), "a", "left_semi").withColumn("more", F.lit(False)).unionByName(heads.withColumn("more", F.col("place") > HEAD).drop("place"))
        rows = rows.repartition(1).sortWithinPartitions("m", "a", "out", "far", "b").select("a", "b", "m", "more")
        step = rows.mapInArrow(choices, "seed string, to string, m double").checkpoint()
        taken = step.where("seed is not null").select("seed", "to")
        found = found.unionByName(taken).checkpoint()
        if stop := step.where("seed is null").first():  # one lead
            at, again = {"m": stop["m"], "a": stop["to"]}, True
        if at is None:
            break
        m, a = F.lit(at["m"]), F.lit(at["a"])
        rest = rest.where((F.col("m") > m) | ((F.col("m") == m) & (F.col("a") >= a if again else F.col("a") > a)))
        for c in ("a", "b"):
            rest = rest.join(taken.select(F.col("seed").alias(c)), c, "left_anti")
        rest = rest.checkpoint()
    return found


def merged(
    assigned: DataFrame, depth: DataFrame, lengths: DataFrame, counts: DataFrame, genes: DataFrame, cutoffs: DataFrame, most_duplicates: int = 7, guard: str = "twice",
    dispersions: DataFrame | None = None, small_below: int | None = None, max_rounds: int = 100,
) -> DataFrame:
    """``assigned(id, seed)`` with clusters merged until no pair may merge any more; vectors and intervals are renewed each round.

    counts: see ``composition.counted``; genes: ``(gene, id)``.  With ``dispersions``, clusters
    of many marker sequences have vectors and intervals from those; clusters shorter than
    ``small_below`` merge whatever their correlation, if their mean lies inside.
    """
    shared_folder(assigned.sparkSession)
    state = assigned.select("id", "seed").checkpoint()
    for _ in range(max_rounds):
        if dispersions is None:
            stand = state
            intervals = coverage.member_interval(state.join(depth, "id").join(lengths, "id"))
        else:
            stand = standing(state, genes, lengths).checkpoint()
            intervals = cluster_intervals(stand, depth, lengths, dispersions)
        comp = composition.cluster_vectors(counts, stand.select("id", "seed"), lengths)
        small = None
        if small_below is not None:
            small = state.join(lengths, "id").groupBy("seed").agg(F.sum("length").alias("size")).where(F.col("size") < small_below).select("seed")
        moves = matched(candidates(intervals, comp, markers.copies(genes, state), cutoffs, most_duplicates, guard, small)).checkpoint()
        if moves.isEmpty():
            return state
        state = state.join(moves, "seed", "left").select("id", F.coalesce("to", "seed").alias("seed")).checkpoint()
    raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
