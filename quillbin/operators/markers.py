"""Single-copy marker genes: duplicates, copy numbers, merge guards and the pivot report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(markers: DataFrame, least: int = 2) -> DataFrame:
    """``markers(gene, id)``, distinct, to ``(a, b, genes)``, a < b: pairs that share at least so many genes.

    An id's genes are put in the order of their frequency, and all but its ``least - 1`` most
    frequent ones are looked up: two ids with so many in common share one of those.  So a
    gene of a third of all ids pairs nobody by itself, and of the genes that a pair shares
    only the rarest one makes its row.
    """
    often = markers.groupBy("gene").agg(F.count("*").alias("often"))
    own = markers.join(often, "gene").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "gene"))), lambda x: x["gene"]).alias("all")).where(F.size("all") >= least)
    rows = own.withColumn("few", F.slice("all", F.lit(1), F.size("all") - (least - 1))).withColumn("gene", F.explode("few"))
    sides = [rows.select("gene", F.col("id").alias(c), F.col("all").alias(f"all_{c}"), F.col("few").alias(f"few_{c}")) for c in ("a", "b")]
    pairs = sides[0].join(sides[1], "gene").where((F.col("a") < F.col("b")) & (F.array_intersect("few_a", "few_b")[0] == F.col("gene")))
    return pairs.select("a", "b", F.size(F.array_intersect("all_a", "all_b")).cast("long").alias("genes")).where(F.col("genes") >= least)


def copies(markers: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(seed, gene, copies)``: sequences with the gene in each cluster."""
    return markers.join(assigned, "id").groupBy("seed", "gene").agg(F.count("*").alias("copies"))


def species_number(copied: DataFrame, least: int, more_than: bool = True) -> DataFrame:
    """``(seed, species)``: the greatest number of copies that more than ``least`` genes have (or at least so many), else 0."""
    histogram = copied.groupBy("seed", "copies").agg(F.count("*").alias("genes"))
    enough = F.col("genes") > least if more_than else F.col("genes") >= least
    return histogram.groupBy("seed").agg(F.coalesce(F.max(F.when(enough, F.col("copies"))), F.lit(0)).alias("species"))


def shared_genes(copied: DataFrame) -> DataFrame:
    """``(a, b, both, twice)``, a < b: genes that both clusters have, and genes with two or more copies in them together.

    Only pairs with a gene in common have a row; for others twice is the sum of their own.
    """
    own = copied.groupBy("seed").agg(F.count(F.when(F.col("copies") > 1, 1)).alias("own"))
    x, y = copied.withColumnsRenamed({"seed": "a", "copies": "m"}), copied.withColumnsRenamed({"seed": "b", "copies": "n"})
    pairs = x.join(y, "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.count(F.when((F.col("m") == 1) | (F.col("n") == 1), 1)).alias("mixed"), F.count(F.when((F.col("m") == 1) & (F.col("n") > 1) | (F.col("m") > 1) & (F.col("n") == 1), 1)).alias("one_many"), F.count(F.when((F.col("m") > 1) & (F.col("n") > 1), 1)).alias("many"))
    sums = pairs.join(own.withColumnsRenamed({"seed": "a", "own": "own_a"}), "a").join(own.withColumnsRenamed({"seed": "b", "own": "own_b"}), "b")
    singles = F.col("mixed") - F.col("one_many")  # genes with one copy in each: two together
    return sums.select("a", "b", "both", (F.col("own_a") + F.col("own_b") - F.col("many") + singles).alias("twice"))


def pivot(cells: DataFrame, seeds: list[str]) -> DataFrame:
    """``cells(gene, seed, place, cell)`` to one column for each of ``seeds``: its cells joined by ``;`` in the order of place, or ``NA``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]), ";")
    wide = cells.groupBy("gene").pivot("seed", seeds).agg(F.when(F.count("cell") > 0, joined))
    return wide.na.fill("NA", seeds)


def kept_after_split(clusters: DataFrame, large: int = 200_000, small: int = 100_000) -> DataFrame:
    """``clusters(seed, species, length)``: with a species, or long enough for a seed of one or of many sequences."""
    alone = ~F.col("seed").contains(";")
    return clusters.where((F.col("species") >= 1) | (alone & (F.col("length") >= large)) | (~alone & (F.col("length") >= small)))


def kept_at_last(clusters: DataFrame, bin_length: int = 500_000) -> DataFrame:
    """``clusters(seed, species, length)``: long enough, or with a species by the final count."""
    return clusters.where((F.col("length") >= bin_length) | (F.col("species") >= 1))
