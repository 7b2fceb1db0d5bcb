"""How good a binning is: bins against species, and bins against a set of wanted sequences.

All inputs are rows ``(id, bin, length)`` with the bin ``unassigned`` for sequences in none,
and ``(id, species)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNASSIGNED = "unassigned"


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(100.0 * a, b)


def first_of(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group: one aggregate with partial sums of the order, no window over the group."""
    keys = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*keys), F.struct(*order)).alias("best")).select(*by, "best.*")


def confusion(bins: DataFrame, truth: DataFrame) -> DataFrame:
    """``(bin, species, length)``: letters of each species in each bin."""
    return bins.join(truth, "id").groupBy("bin", "species").agg(F.sum("length").alias("length"))


def main_species(matrix: DataFrame) -> DataFrame:
    """``(species, bin, length, bin_length)``: the species with most letters in each bin, and of its bins the one with most."""
    own = matrix.where(F.col("bin") != UNASSIGNED)
    total = F.sum("length").alias("bin_length")
    best = F.min_by(F.struct("species", "length"), F.struct(-F.col("length"), "species")).alias("best")
    by_bin = own.groupBy("bin").agg(best, total).select("bin", "best.*", "bin_length")
    return first_of(by_bin, ["species"], -F.col("length"), F.col("bin"))


def wholes(matrix: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(species, total, unassigned)``; total: letters of ``wanted(species, length)`` where it is given, else of all."""
    out = matrix.groupBy("species").agg(F.sum("length").alias("total"), F.sum(F.when(F.col("bin") == UNASSIGNED, F.col("length")).otherwise(0)).alias("unassigned"))
    if wanted is None:
        return out
    return out.drop("total").join(wanted.groupBy("species").agg(F.sum("length").alias("total")), "species", "left")


def per_species(matrix: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(species, bin, precision, sensitivity, assigned)`` in percent, for species that are the main one of some bin.

    wanted: see ``wholes``; sensitivity and assigned are of its letters, and null where it has none.
    """
    rows = main_species(matrix).join(wholes(matrix, wanted), "species")
    n = F.col("length")
    return rows.select(
        "species", "bin", percent(n, F.col("bin_length")).alias("precision"), percent(n, F.col("total")).alias("sensitivity"), percent(F.col("total") - F.col("unassigned"), F.col("total")).alias("assigned")
    )


def overall(matrix: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row ``(performance, precision, sensitivity, assigned)`` in percent; all but precision, which is of the letters in bins, of ``wanted``'s letters where it is given (see ``wholes``)."""
    own = matrix.where(F.col("bin") != UNASSIGNED)
    total = wholes(matrix, wanted).agg(F.sum("total").alias("total"), F.sum("unassigned").alias("unassigned"))
    best = own.groupBy("bin").agg(F.max("length").alias("most"), F.sum("length").alias("inside")).agg(F.sum("most").alias("most"), F.sum("inside").alias("inside"))
    main = main_species(matrix).agg(F.sum("length").alias("kept"), F.sum(F.col("length") * F.col("length") / F.col("bin_length")).alias("weighted"))
    one = total.crossJoin(best).crossJoin(main)  # three rows of one
    inside = F.col("total") - F.col("unassigned")
    return one.select(percent(F.col("weighted"), F.col("total")).alias("performance"), percent(F.col("most"), F.col("inside")).alias("precision"), percent(F.col("kept"), F.col("total")).alias("sensitivity"), percent(inside, F.col("total")).alias("assigned"))


def one_genome(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for a set of wanted ids: the bin with most of their letters, the number of their bins, and percentages.

    precision: of that bin's letters; sensitivity and assigned: of the wanted letters;
    assigned_all: of all letters.
    """
    flagged = bins.join(wanted.select("id").distinct(), "id", "left_semi")
    by_bin = flagged.groupBy("bin").agg(F.sum("length").alias("length"))
    own = by_bin.where(F.col("bin") != UNASSIGNED)
    best = own.agg(F.min_by("bin", F.struct(-F.col("length"), F.col("bin"))).alias("bin"), F.max("length").alias("most"), F.sum("length").alias("inside"), F.count("*").alias("n_bins"))
    whole = by_bin.agg(F.sum("length").alias("total"))
    size = bins.groupBy("bin").agg(F.sum("length").alias("bin_length"))
    everything = size.agg(F.sum("bin_length").alias("all"), F.sum(F.when(F.col("bin") != UNASSIGNED, F.col("bin_length")).otherwise(0)).alias("all_inside"))
    rows = best.crossJoin(whole).crossJoin(everything).join(size, "bin", "left")  # one row each, but for the bins
    return rows.select("bin", "n_bins", percent(F.col("most"), F.col("bin_length")).alias("precision"), percent(F.col("most"), F.col("total")).alias("sensitivity"), percent(F.col("inside"), F.col("total")).alias("assigned"), percent(F.col("all_inside"), F.col("all")).alias("assigned_all"))


#: Spans that a task sorts, about.
TASK_SPANS = 1_000_000


def covered(spans: DataFrame, by: list[str]) -> DataFrame:
    """``spans(by..., start, end)``, ends included and in either order, to ``(by..., covered)``: places in any of them.

    Groups are dealt out to as many tasks as the spans need, so a task's memory does not grow with the
    table; equal spans are left for the sort, where the second adds nothing.
    """
    tasks = max(1, -(-spans.count() // TASK_SPANS))
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    order = W.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.select(*by, lo.alias("lo"), hi.alias("hi")).repartition(tasks, *by).withColumn("reach", reach)
    new = F.greatest(F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("reach", F.col("lo") - 1)), F.lit(0))
    return rows.groupBy(*by).agg(F.sum(new).alias("covered"))


def best_reference(coords: DataFrame) -> DataFrame:
    """``(qry, ref, part)``: the reference that covers most of a query, or of itself if that is no longer than the query; equal ones by name."""
    query_shorter = F.col("len_q") < F.col("len_r")
    spans = coords.select("qry", "ref", F.least("len_q", "len_r").alias("size"), F.when(query_shorter, F.col("s2")).otherwise(F.col("s1")).alias("start"), F.when(query_shorter, F.col("e2")).otherwise(F.col("e1")).alias("end"))
    part = covered(spans, ["qry", "ref", "size"]).select("qry", "ref", F.try_divide(F.col("covered"), F.col("size")).alias("part"))
    return first_of(part, ["qry"], -F.col("part"), F.col("ref"))


def best_rows(coords: DataFrame) -> DataFrame:
    return coords.join(best_reference(coords), ["qry", "ref"], "left_semi")


def well_covered(coords: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The rows of queries of which at least such a part is covered, and the others."""
    part = covered(coords.select("qry", "len_q", F.col("s2").alias("start"), F.col("e2").alias("end")), ["qry", "len_q"])
    good = part.where(F.col("covered") >= least * F.col("len_q")).select("qry")
    return coords.join(good, "qry", "left_semi"), coords.join(good, "qry", "left_anti")


def least_evalue(hits: DataFrame) -> DataFrame:
    """``(gene, model)``: the model with the least E-value; equal ones by name."""
    return hits.groupBy("gene").agg(F.min_by("model", F.struct("evalue", "model")).alias("model"))


def classified(assigned: DataFrame, sequences: DataFrame, seeds: DataFrame) -> DataFrame:
    """Bins numbered by the seed's mean, greatest first; sequences in none are unassigned.

    assigned: ``(id, seed)``, sequences: ``(id, ...)``, seeds: ``(seed, mean)``, one row for each bin.
    """
    bins = seeds.select("seed", F.row_number().over(W.orderBy(F.desc("mean"), "seed")).cast("string").alias("bin"))
    return sequences.join(assigned.join(bins, "seed"), "id", "left").withColumn("bin", F.coalesce("bin", F.lit(UNASSIGNED)))
