"""Reports of the binning pipeline as rows of text, ready for ``df.write.text``.

``report`` functions return ``(value)`` rows with an ``n`` to sort by, so that a caller can
write them in order from as many tasks as the rows need.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("quillbin")


def write_lines(report: DataFrame, path: str) -> None:
    """Writes a report in the order of n: part files follow each other."""
    report.repartitionByRange("n").sortWithinPartitions("n", "value").select("value").write.text(path)


def row(*cells: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in cells])


def interval_report(intervals: DataFrame, means: DataFrame, twice: bool = False) -> DataFrame:
    """``seed[, seed], lo, hi`` of each sample; seeds by mean, greatest first.  means: ``(seed, mean)``."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("sample", "lo", "hi"))), lambda x: F.concat_ws("\t", x["lo"].cast("string"), x["hi"].cast("string")))
    rows = intervals.groupBy("seed").agg(cells.alias("cells")).join(means, "seed")
    return rows.select((-F.col("mean")).alias("n"), row(*[F.col("seed")] * (1 + twice), F.concat_ws("\t", "cells")).alias("value"))


def member_report(seeds: DataFrame, assigned: DataFrame) -> DataFrame:
    """``seed, a;b;c`` or ``NA``; seeds: ``(seed, mean)``, assigned: ``(id, seed)``."""
    members = assigned.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("members"))
    return seeds.join(members, "seed", "left").select((-F.col("mean")).alias("n"), row(F.col("seed"), F.coalesce("members", F.lit("NA"))).alias("value"))


def length_report(seeds: DataFrame, assigned: DataFrame, lengths: DataFrame, members: bool = False) -> DataFrame:
    """``seed, length[, number, members]``; lengths: ``(id, length)``."""
    total = assigned.join(lengths, "id").groupBy("seed").agg(F.sum("length").alias("length"), F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("id")), ";").alias("members"))
    rows = seeds.join(total, "seed", "left")
    if not members:
        return rows.select((-F.col("mean")).alias("n"), row(F.col("seed"), F.coalesce("length", F.lit(0))).alias("value"))
    empty = row(F.col("seed"), *map(F.lit, ("NA", "0", "0", "NA")))  # a cell more, as the pipeline has always had it
    return rows.select((-F.col("mean")).alias("n"), F.when(F.col("length").isNull(), empty).otherwise(row(F.col("seed"), F.col("length"), F.col("n_members"), F.col("members"))).alias("value"))


def marker_matrix(cells: DataFrame, seeds: DataFrame, assigned: DataFrame, means: DataFrame) -> DataFrame:
    """A line for each gene, by name: ``id(mean[,mean...],length);...`` or ``NA`` for each seed, greatest mean first, below a head line of seeds.

    cells: ``(gene, place, id)`` in the order of the table, seeds: ``(seed, mean)``, means:
    ``(id, means array<double>, length)``.  A line is as long as there are seeds.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("d"), "seed"))), lambda x: x["seed"])
    head = seeds.agg(order.alias("order")).withColumn("one", F.lit(1))
    cell = F.concat(F.col("id"), F.lit("("), F.array_join(F.transform("means", lambda x: F.format_string("%.2f", x)), ","), F.lit(","), F.col("length").cast("string"), F.lit(")"))
    own = cells.join(assigned.select("id", "seed"), "id").join(means, "id").select("gene", "seed", "place", cell.alias("cell"))
    joined = own.groupBy("gene", "seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]), ";").alias("cell"))
    by_gene = joined.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("seed", "cell"))).alias("by_seed"))
    genes = cells.select("gene").distinct().join(by_gene, "gene", "left").withColumn("one", F.lit(1)).join(head, "one")
    line = F.transform("order", lambda x: F.coalesce(F.try_element_at("by_seed", x), F.lit("NA")))
    first = head.select(F.struct(F.lit(0).alias("k"), F.lit("").alias("gene")).alias("n"), F.concat_ws("\t", F.lit("SCG"), F.col("order")).alias("value"))
    return first.unionByName(genes.select(F.struct(F.lit(1).alias("k"), "gene").alias("n"), F.concat_ws("\t", F.col("gene"), line).alias("value")))


def classified_report(bins: DataFrame) -> DataFrame:
    """``id, bin, length, mean..., seed``; bins: ``(id, bin, length, means array<double>, seed)``; greatest mean first, unassigned last."""
    means = F.array_join(F.transform("means", lambda x: F.format_string("%.2f", x)), "\t")
    n = F.struct((F.col("bin") == "unassigned").alias("late"), (-F.col("means")[0]).alias("mean"))
    return bins.select(n.alias("n"), row(F.col("id"), F.col("bin"), F.col("length"), means, F.coalesce("seed", F.lit("unassigned"))).alias("value"))


def marker_report(cells: DataFrame) -> DataFrame:
    """``gene, id(depth,...,length), ...`` by depth, greatest first; cells: ``(gene, id, depths array<double>, length)``; without depth a sequence is left out."""
    cell = F.concat(F.col("id"), F.lit("("), F.array_join(F.transform("depths", lambda x: F.format_string("%.2f", x)), ","), F.lit(","), F.col("length").cast("string"), F.lit(")"))
    found = cells.where(F.coalesce(F.col("depths")[0], F.lit(0.0)) > 0)
    rows = found.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depths")[0]).alias("d"), "id", cell.alias("cell")))), lambda x: x["cell"]).alias("cells"))
    return rows.select(F.col("gene").alias("n"), row(F.col("gene"), F.concat_ws("\t", "cells")).alias("value"))
