"""Coverage depth: windows, dispersion, intervals of seeds, and joins of sequences to intervals."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.functions.statistics import decimals, dispersion, exact_sum, mean, toward_zero
from quillbin.operators.shared import shared_folder, tiled

#: Below this mean a sample says nothing about coverage.
LOW = 5.0
FOLD = 2.58
#: Rows that a task numbers.
RANGE_ROWS = 200_000
#: Seeds with equal intervals that one row stands for, about, at most.
ALIKE = 65_536


def sliding(depths: Column, size: int = 500, step: int = 250) -> Column:
    """Means of ``size`` places every ``step``, the rest at the end left out; the whole mean of shorter arrays."""
    n = F.size(depths)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(step))
    return F.when(n < size, F.array(mean(depths))).otherwise(F.transform(starts, lambda i: F.aggregate(F.slice(depths, i, F.lit(size)), F.lit(0.0), lambda s, x: s + x) / size))


def trimmed_ends(depths: Column, read_length: Column, least: Column) -> Column:
    """The places less a read's length at both ends; null for arrays shorter than ``least``."""
    n = F.size(depths)
    return F.when(n >= least, F.slice(depths, read_length + 1, F.greatest(n - 2 * read_length, F.lit(0))))


def window_means(depths: DataFrame) -> DataFrame:
    """``depths(id, sample, depths, read_length)`` to ``(id, sample, mean, windows)``, to two decimals; all-zero depths have one window of 0."""
    inner = trimmed_ends(F.col("depths"), F.col("read_length"), 2 * F.col("read_length") + 1)
    rows = depths.select("id", "sample", inner.alias("x")).where("x is not null").withColumn("mean", F.round(mean(F.col("x")), 2))
    windows = F.when(F.forall("x", lambda v: v == 0), F.array(F.lit(0.0))).otherwise(F.transform(sliding(F.col("x")), lambda w: F.round(w, 2)))
    return rows.select("id", "sample", "mean", windows.alias("windows"))


def numbered(rows: DataFrame, order: str, by: Sequence[str] = (), ties: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``n``, each row's place from 1 in the order of a column, then of ``ties``, for itself in each group of ``by``.

    Rows are sorted to ranges of both, as many as ``range_rows`` rows each need, and numbered
    within their range after the rows of earlier ranges, so neither a group nor the rows of
    a frequent value are gathered in one task, unless their ties are equal as well.
    """
    shared_folder(rows.sparkSession)
    part = next(c for c in ("range", "range_", "range__") if c not in rows.columns)
    tasks = max(1, -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(tasks, order, *ties).withColumn(part, F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy(*by, part).agg(F.count("*").alias("k"))
    before = sizes.select(*by, part, F.coalesce(F.sum("k").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row for each group and range
    place = F.row_number().over(W.partitionBy(*by, part).orderBy(order, *ties))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, part)]
    on = functools.reduce(lambda x, y: x & y, same)
    found = ranged.withColumn("i", place).alias("r").join(before.alias("b"), on)
    return found.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("before") + F.col("i")).alias("n"))


def running(rows: DataFrame, by: str, order: str, k: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``to``: the sum of ``k`` of a group's rows up to this one in the order of a column whose values are distinct in the group.

    Groups and values are sorted to ranges, as many as ``range_rows`` rows each need; sums of
    earlier ranges come first, so a group of any size is summed in as many tasks as it needs.
    """
    shared_folder(rows.sparkSession)
    kept = rows.checkpoint()
    part = next(c for c in ("range", "range_", "range__") if c not in rows.columns)
    tasks = max(1, -(-kept.count() // range_rows))
    ranged = kept.repartitionByRange(tasks, by, order).withColumn(part, F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy(by, part).agg(F.sum(k).alias("sum"))
    before = sizes.select(F.col(by).alias("group"), F.col(part).alias("at"), F.coalesce(F.sum("sum").over(W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row for each group and range
    own = F.sum(k).over(W.partitionBy(by, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    found = ranged.withColumn("own", own).join(before, F.col(by).eqNullSafe(F.col("group")) & (F.col(part) == F.col("at")))
    return found.select(*rows.columns, (F.col("before") + F.col("own")).alias("to"))


def window_sums(rows: DataFrame, by: str, value: str, size: int = 500, step: int = 250) -> DataFrame:
    """``rows(by, n, value)``, numbered within each group, to ``(by, w, depth)``: what ``sliding`` gives, for groups of any size.

    Each row goes to the windows it lies in; size must be a multiple of step.
    """
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    last = F.floor((F.col("n") - 1) / step)
    each = rows.join(total, by).withColumn("w", F.explode(F.when(F.col("total") < size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.greatest(last - (size // step - 1), F.lit(0)), last))))
    whole = (F.col("total") < size) | (F.col("w") * step + size <= F.col("total"))
    return each.where(whole).groupBy(by, "w").agg(F.avg(value).alias("depth"))


def fences(rows: DataFrame, by: str, value: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The fences of ``statistics.fence`` for groups of any size: ``(by, n, average, low, high)``, and how often each value occurs as ``(by, value, k)``.

    Equal values are counted first and numbered in ranges (see ``running``), so no task sorts a group.
    """
    counted = running(rows.groupBy(by, value).agg(F.count("*").alias("k")), by, value, "k", range_rows)
    total = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("average"))
    place = counted.join(total, by)
    n = F.col("n")

    def at(i: Column) -> Column:
        i = F.when(i < 1, n).otherwise(F.least(i, n))  # a place before the first element wraps to the last one
        return F.max(F.when((F.col("to") >= i) & (F.col("to") - F.col("k") < i), F.col(value)))

    def quartile(k: int) -> Column:
        below = F.floor((n + 1) * k / 4)
        part = F.max((n + 1) * k / 4.0 - below)
        return F.when(part == 0, at(below)).otherwise(part * at(below) + (1 - part) * at(below + 1))

    found = place.groupBy(by).agg(F.max("n").alias("n"), F.max("average").alias("average"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return found.select(by, "n", "average", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")), counted.drop("to")


def trimmed_deviation(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, n, kept, low, high, ratio)`` for groups of any size; kept: values within the fences, ratio: see ``statistics.dispersion``, about the mean of all."""
    limits, counted = fences(rows, by, value)
    inside = counted.join(limits, by).where(F.col(value).between(F.col("low"), F.col("high")))
    sums = inside.groupBy(by).agg(F.sum("k").alias("kept"), F.sum(F.col("k") * (F.col(value) - F.col("average")) * (F.col(value) - F.col("average"))).alias("squares"))
    sd = F.sqrt(F.try_divide(F.col("squares"), F.when(F.col("kept") > 1, F.col("kept") - 1)))
    ratio = F.when(F.col("n") < 10, F.lit(None).cast("double")).when(F.col("average") <= 1, F.lit(0.0)).otherwise(sd / F.col("average"))
    return limits.join(sums, by, "left").select(by, "n", F.coalesce("kept", F.lit(0)).alias("kept"), "low", "high", ratio.alias("ratio"))


def pooled(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Row n of one list with row n of the other (see ``numbered``); the ids of the left one count."""
    return left.join(right.drop(*ids), "n")


def sample_dispersion(depths: DataFrame, most: float = 0.38) -> DataFrame:
    """``depths(id, sample, mean, windows)`` to ``(sample, sd1, sd2)``: median and upper quarter of the dispersions below ``most`` of sequences with a mean over 1."""
    ratio = dispersion(F.col("windows"), F.col("mean"))
    rows = depths.where("mean > 1").select("sample", ratio.alias("ratio")).where(F.col("ratio").isNotNull() & (F.col("ratio") < most))
    return quarters(rows).select("sample", F.round("middle", 2).alias("sd1"), F.round("upper", 2).alias("sd2"))


def quarters(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows(sample, ratio)`` to ``(sample, middle, upper)``: the median, and the element at int(3 n / 4) counted from 1, the first where there are fewer.

    Equal ratios are counted first and numbered in ranges (see ``running``), so no task sorts a sample.
    """
    counted = running(rows.groupBy("sample", "ratio").agg(F.count("*").alias("k")), "sample", "ratio", "k", range_rows)
    place = counted.join(counted.groupBy("sample").agg(F.sum("k").alias("n")), "sample")
    has = lambda i: F.when((F.col("to") >= i) & (F.col("to") - F.col("k") < i), F.col("ratio"))
    low, high, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.greatest(F.floor(F.col("n") * 3 / 4), F.lit(1))
    return place.groupBy("sample").agg(((F.max(has(low)) + F.max(has(high))) / 2).alias("middle"), F.max(has(upper)).alias("upper"))


def large_interval(mean: Column, ratio: Column, sd1: Column, sd2: Column, fold: float = FOLD) -> tuple[Column, Column]:
    """``(lo, hi)`` of a long sequence: ``fold`` dispersions about its mean, each dispersion between sd1 and sd2."""
    sd = F.least(F.greatest(F.coalesce(ratio, sd1), sd1), sd2)
    return toward_zero(mean * (1 - sd * fold)), toward_zero(mean * (1 + sd * fold)) + 1


def small_interval(mean: Column, sd1: Column) -> tuple[Column, Column]:
    return toward_zero(mean * (1 - sd1)), toward_zero(mean * (1 + sd1)) + 1


def within(rows: DataFrame, seeds: DataFrame, n_samples: int, open_end: bool = False, wildcard: bool = True, width: float | None = None) -> DataFrame:
    """``(id, seed)`` where the sequence's mean lies in the seed's interval in all samples.

    rows: ``(id, sample, mean)``, seeds: ``(seed, sample, mean, lo, hi)``, each with one row
    for a sample.  A seed with a mean below ``LOW`` in a sample takes any sequence there,
    unless wildcard is off; open_end leaves out hi itself.  See ``meeting_cells``.
    """
    return unfolded(*meeting_cells(rows, seeds, n_samples, open_end, wildcard, width))


def unfolded(means: DataFrame, own: DataFrame, fits: Column) -> DataFrame:
    """``(id, seed)`` of what ``meeting_cells`` gives; seeds with equal intervals are compared as one and told apart where pairs come out."""
    found = tiled(means, own, ["place", "cell"], "id", "seed", fits, weight=F.size("seeds"))
    return found.select("id", F.explode("seeds").alias("seed"))


def meeting_cells(rows: DataFrame, seeds: DataFrame, n_samples: int, open_end: bool, wildcard: bool, width: float | None) -> tuple[DataFrame, DataFrame, Column]:
    """``(id, place, cell, x...)``, ``(seed, place, cell, lo..., hi..., seeds)`` and the condition on both for a sequence to lie in a seed's intervals.

    Seeds with equal intervals in all samples, up to about ``ALIKE``, are one row under the first of their names.
    Intervals are cut at multiples of ``width`` and met by equality; without a width it is
    taken from the intervals' mean length.  Of several samples each seed has cells in one,
    that with the fewest sequences in its cells.  An id's means and a seed's ends of all
    samples go with each of their rows, so all samples are checked where the two meet and no
    candidate is shuffled.  Place 0 is of seeds that are
    free in all samples.
    """
    shared_folder(rows.sparkSession)
    free = (F.col("mean") < LOW) if wildcard else F.lit(False)
    every = seeds.withColumn("free", free).where("free is not null").select("seed", "sample", "free", "lo", "hi").checkpoint()
    places = every.select("sample").distinct().withColumn("place", F.row_number().over(W.orderBy("sample")))  # a row for each sample

    def gathered(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        pairs = F.collect_list(F.struct("place", value.alias("x")))
        at = lambda i: F.try_element_at(F.filter("own", lambda y: y["place"] == i), F.lit(1))["x"]
        return df.join(places, "sample", "left").groupBy(key).agg(pairs.alias("own")).select(key, F.transform(F.sequence(F.lit(1), F.lit(n_samples)), at).alias(name))

    spans = gathered(every, "seed", F.struct("free", "lo", "hi"), "spans")
    parts = F.pmod(F.xxhash64("seed"), F.lit(-(-every.select("seed").distinct().count() // ALIKE) or 1))
    spans = spans.groupBy("spans", parts.alias("part")).agg(F.min("seed").alias("seed"), F.collect_list("seed").alias("seeds")).drop("part").checkpoint()
    s = every.join(spans.select("seed"), "seed", "left_semi").checkpoint()
    bound = s.where("not free and lo <= hi")
    if width is None:
        width = bound.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0]  # one number
        width = max(float(width or 1.0), 1e-9)
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    cut = bound.select("seed", "sample", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    if n_samples > 1:
        cut = cut.join(rarest(rows.select("sample", cell(F.col("mean")).alias("cell")), cut), ["seed", "sample"], "left_semi")
    means = gathered(rows, "id", F.col("mean"), "means")
    at = F.transform(F.concat(F.array(F.lit(None).cast("double")), "means"), lambda x, i: F.struct(i.alias("place"), F.when(i == 0, F.lit(0).cast("long")).otherwise(cell(x)).alias("cell")))
    own = cut.join(places, "sample").select("seed", "place", "cell")
    if wildcard:
        own = own.unionByName(s.groupBy("seed").agg(F.count_if("free").alias("freed")).where(F.col("freed") == n_samples).select("seed", F.lit(0).alias("place"), F.lit(0).cast("long").alias("cell")))
    used = own.select("place").distinct()
    placed = means.select("id", "means", F.inline(at)).where("cell is not null").join(F.broadcast(used), "place", "left_semi")
    # plain numbers compare fast: a missing mean is above all ends, a free sample has NaN as its end, above everything, and one without an interval holds nothing
    top, end = F.lit(float("inf")), F.lit(float("nan"))
    xs, ends, fits = [], [], F.lit(True)
    for i in range(n_samples):
        x, span = F.get("means", F.lit(i)).cast("double"), F.get("spans", F.lit(i))
        xs.append(F.coalesce(F.nanvl(x, top), top).alias(f"x{i}"))
        ends.append(F.when(span["free"], -top).otherwise(F.coalesce(span["lo"].cast("double"), top)).alias(f"lo{i}"))
        ends.append(F.when(span["free"], end).otherwise(F.when(span["lo"].isNull(), -top).otherwise(F.coalesce(span["hi"].cast("double"), -top))).alias(f"hi{i}"))
        fits = fits & (F.col(f"x{i}") >= F.col(f"lo{i}")) & ((F.col(f"x{i}") < F.col(f"hi{i}")) if open_end else (F.col(f"x{i}") <= F.col(f"hi{i}")))
    return placed.select("id", "place", "cell", *xs).checkpoint(), own.join(spans, "seed").select("seed", "place", "cell", *ends, "seeds").checkpoint(), fits


def rarest(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """``(seed, sample)``: for each seed of ``cut(seed, sample, cell)`` the sample with the fewest rows of ``placed(sample, cell)`` in its cells, then the first by name."""
    often = placed.groupBy("sample", "cell").agg(F.count("*").alias("k"))
    each = cut.select("seed", "sample", "cell").join(often, ["sample", "cell"], "left").groupBy("seed", "sample").agg(F.sum(F.coalesce("k", F.lit(0))).alias("k"))
    return each.groupBy("seed").agg(F.min_by("sample", F.struct("k", "sample")).alias("sample"))


def within_or_first(rows: DataFrame, seeds: DataFrame, n_samples: int, first: str) -> DataFrame:
    """Like ``within`` with an open end; sequences in no interval go to the seed ``first``."""
    means, own, fits = meeting_cells(rows, seeds, n_samples, True, True, None)
    found = unfolded(means, own, fits)
    some = tiled(means, own.drop("seeds"), ["place", "cell"], "id", "seed", fits, "left_semi")
    rest = rows.select("id").distinct().join(some.select("id").distinct(), "id", "left_anti").select("id", F.lit(first).alias("seed"))
    return found.unionByName(rest)


def alike(a_mean: Column, a_sd: Column, b_mean: Column) -> Column:
    """Whether two means of a sample are compatible: the lesser within the greater's interval, or the greater below ``LOW``."""
    high, low = F.greatest(a_mean, b_mean), F.least(a_mean, b_mean)
    return (high < LOW) | ((low >= toward_zero(high * (1 - a_sd))) & (low <= toward_zero(high * (1 + a_sd)) + 1))


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (b_lo < a_hi) & (b_hi > a_lo)


def weighted_mean() -> Column:
    """A group's mean by length to two decimals, the same in any order of its rows."""
    return decimals(F.try_divide(exact_sum(F.col("mean") * F.col("length")), exact_sum(F.col("length"))), 2)


def member_interval(members: DataFrame) -> DataFrame:
    """``members(seed, sample, mean, length)`` to ``(seed, sample, mean, lo, hi)``: from the least mean to the greatest."""
    return members.groupBy("seed", "sample").agg(weighted_mean().alias("mean"), toward_zero(F.min("mean")).alias("lo"), (toward_zero(F.max("mean")) + 1).alias("hi"))


def marker_interval(members: DataFrame, dispersions: DataFrame, fold: float = FOLD) -> DataFrame:
    """Intervals from marker sequences: ``members(seed, sample, mean, length)``, fences trimmed, widened by their own dispersion.

    With fewer than twenty members the ends go out to ``fold`` dispersions, between sd1 and
    sd2, from the mean; the ends are then widened by the dispersion, which sd1 raises but
    sd2 does not cut.  With one member left, the dispersion is sd1.  A mean below ``LOW``
    has the interval (0, 0).
    """
    keyed = members.withColumn("key", F.struct("seed", "sample"))
    limits, _ = fences(keyed.select("key", "mean"), "key", "mean")
    kept = keyed.join(limits.select("key", "n", "low", "high"), "key").where(F.col("mean").between(F.col("low"), F.col("high"))).select("key", "mean", "length", "n").checkpoint()  # read twice
    sums = kept.groupBy("key").agg(weighted_mean().alias("m"), F.min("mean").alias("least"), F.max("mean").alias("most"), F.count("*").alias("k"), F.max("n").alias("n"))
    off = F.col("mean") - F.col("m")
    about = kept.select("key", "mean").join(sums.select("key", "m"), "key").groupBy("key").agg(exact_sum(off * off).alias("about"))  # of the rounded mean: ends are cut to whole numbers, where one digit counts
    m, sd1, sd2 = F.col("m"), F.col("sd1"), F.col("sd2")
    own = F.when(F.col("k") > 1, F.coalesce(F.try_divide(F.sqrt(F.col("about") / (F.col("k") - 1)), m), sd1)).otherwise(sd1)
    few = F.col("n") < 20
    rows = sums.join(about, "key").select("key.*", "m", "least", "most", "k", "n", "about").join(dispersions, "sample").withColumn("own", own)
    rows = rows.withColumn("sd", F.when(few, F.greatest("own", "sd1")).otherwise(F.col("own"))).withColumn("near", F.least(F.greatest("own", "sd1"), sd2))
    least = F.when(few, F.least("least", toward_zero(m * (1 - F.col("near") * fold)).cast("double"))).otherwise(F.col("least"))
    most = F.when(few, F.greatest("most", (toward_zero(m * (1 + F.col("near") * fold)) + 1).cast("double"))).otherwise(F.col("most"))
    low = m < LOW
    return rows.select("seed", "sample", m.alias("mean"), F.when(low, 0).otherwise(toward_zero(least * (1 - F.col("sd")))).alias("lo"), F.when(low, 0).otherwise(toward_zero(most * (1 + F.col("sd"))) + 1).alias("hi"))


def gaps_filled(intervals: DataFrame, means: DataFrame) -> DataFrame:
    """``intervals(seed, sample, lo, hi)`` without gaps between them; means: ``(sample, mean)`` of the sequences.

    First the least lo of a sample goes down to the least mean.  Then a gap between two
    neighbouring ends that no interval covers is filled from both sides: those that begin at
    its end begin at its start, those that end at its start end at its end.  The running
    maximum of hi in the order of lo finds the gaps in one pass for each sample.
    """
    floor = means.groupBy("sample").agg(toward_zero(F.min("mean")).alias("floor"))
    least = W.partitionBy("sample")
    rows = intervals.join(floor, "sample", "left").withColumn("first", F.min("lo").over(least))
    rows = rows.withColumn("lo", F.when(F.col("lo") == F.col("first"), F.least("lo", F.coalesce("floor", "lo"))).otherwise(F.col("lo"))).drop("floor", "first")
    spans = rows.select("sample", "lo", "hi").distinct()
    reach = F.max("hi").over(W.partitionBy("sample").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    gaps = spans.select("sample", reach.alias("start"), F.col("lo").alias("end")).where("start < end").distinct()
    down = gaps.select("sample", F.col("end").alias("lo"), F.col("start").alias("new_lo"))
    up = gaps.select("sample", F.col("start").alias("hi"), F.col("end").alias("new_hi"))
    out = rows.join(down, ["sample", "lo"], "left").join(up, ["sample", "hi"], "left")
    return out.select("seed", "sample", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "hi").alias("hi"))
