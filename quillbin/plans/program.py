"""Files in, reports out: ``python -m quillbin.plans.program --fafile ... --depthfile ... --tablefile ... --cutoffs ...``.

Each report is a folder of text parts under ``--outdir`` whose lines follow each other in the
order of the parts.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.operators import coverage
from quillbin.plans import binning
from quillbin.sources import readers, writers


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    own, p = binning.Parameters(), argparse.ArgumentParser(description=__doc__)
    for name in ("fafile", "depthfile", "tablefile", "cutoffs"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--seedfile")
    p.add_argument("--outdir", default=".")
    p.add_argument("--fold", type=float, default=own.fold)
    p.add_argument("--minlen", type=int, default=own.min_length)
    p.add_argument("--LargeLen", type=int, default=own.large_length)
    p.add_argument("--SmallLen", type=int, default=own.small_length)
    p.add_argument("--BinLen", type=int, default=own.bin_length)
    p.add_argument("--scgNum", type=int, default=own.genes_for_split)
    p.add_argument("--scgNum4bin", type=int, default=own.genes_for_bin)
    return p.parse_args(argv)


def reports(own: binning.Inputs, found: binning.Result, cells: DataFrame) -> dict[str, DataFrame]:
    """All reports by name; cells: see ``readers.marker_cells``."""
    lengths = own.sequences.select("id", "length")
    by_sample = F.array_sort(F.collect_list(F.struct("sample", "mean")))
    means = own.depth.groupBy("id").agg(F.transform(by_sample, lambda x: x["mean"]).alias("means")).join(lengths, "id").checkpoint()
    at_first = lambda x: x.groupBy("seed").agg(F.min_by("mean", "sample").alias("mean"))
    of_clusters = lambda x: at_first(coverage.member_interval(x.join(own.depth.select("id", "sample", "mean"), "id").join(lengths, "id")))
    seeds, final = at_first(found.seeds), at_first(found.final)
    split, first, merged = of_clusters(found.split), of_clusters(found.first), of_clusters(found.merged)
    empty = seeds.join(split, "seed", "left_anti")  # seeds that got nothing
    cells = cells.select("gene", "place", "id")
    placed = found.bins.where("seed is not null").select("id", "seed")
    return {
        "largeScaffoldSeed_CovInterval": writers.interval_report(found.long, at_first(found.long)),
        "allscaffoldSeed_CovInterval": writers.interval_report(found.seeds, seeds, twice=True),
        "allscaffold_RawClassified": writers.member_report(seeds, found.raw),
        "SCGscaffold_RawClassified": writers.marker_matrix(cells, seeds, found.raw, means),
        "allscaffoldSeed_ClassifiedLength_AfterSplit": writers.length_report(split.unionByName(empty), found.split, lengths, members=True),
        "SCGscaffold_AfterSplit": writers.marker_matrix(cells, split, found.split, means),
        "SCGscaffold_AfterMerge_FirstTime": writers.marker_matrix(cells, first, found.first, means),
        "SCGscaffold_AfterMerge_SecondTime": writers.marker_matrix(cells, merged, found.merged, means),
        "allscaffoldSeed_ClassifiedLength_Final": writers.length_report(merged, found.merged, lengths),
        "FinalSeed_CovInterval": writers.interval_report(found.final, final),
        "SCGscaffold_FinalClassified": writers.marker_matrix(cells, final, placed, means),
        "classified_allscaffold": writers.classified_report(found.bins.join(means.select("id", "means"), "id", "left")),
    }


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> dict[str, str]:
    """Reads the files, bins, and writes the reports and a log; returns the path of each.

    Sequences shorter than ``--minlen`` take no part and are in no report.
    """
    a = arguments(argv)
    par = binning.Parameters(a.fold, a.minlen, a.LargeLen, a.SmallLen, a.BinLen, genes_for_split=a.scgNum, genes_for_bin=a.scgNum4bin)
    binning.seeds.shared_folder(spark)
    said: list[tuple[int, str]] = []

    def say(text: str) -> None:
        line = f"{time.strftime('%Y-%m-%d %H:%M:%S')}: {text}"
        writers.log.info(line)
        said.append((len(said), line))

    cells = readers.marker_cells(spark, a.tablefile).checkpoint()
    own = binning.Inputs(
        readers.fasta(spark, a.fafile, a.minlen).checkpoint(),
        readers.window_depths(spark, a.depthfile).checkpoint(),
        cells.select("gene", "id").distinct().checkpoint(),
        readers.cutoffs(spark, a.cutoffs),
        readers.pinned_seeds(spark, a.seedfile, with_line=True) if a.seedfile else None,
    )
    own = binning.Inputs(own.sequences, own.depth.join(own.sequences.select("id"), "id", "left_semi"), own.genes.join(own.sequences.select("id"), "id", "left_semi"), own.cutoffs, own.pinned)
    say(f"Sequences: {own.sequences.count()}, of {binning.LARGE} letters and more: {own.sequences.where(F.col('length') >= binning.LARGE).count()}")
    found = binning.stages(own, par)
    for name, rows in (("Long seeds", found.long), ("All seeds", found.seeds), ("Clusters after splitting", found.split), ("Clusters after the first merge", found.first), ("Clusters after the last merge", found.merged), ("Bins", found.final)):
        say(f"{name}: {rows.select('seed').distinct().count()}")
    at = {}
    for name, rows in reports(own, found, cells).items():
        at[name] = f"{a.outdir.rstrip('/')}/{name}"
        writers.write_lines(rows, at[name])
        say(f"Wrote {at[name]}")
    at["log"] = f"{a.outdir.rstrip('/')}/log"
    writers.write_lines(spark.createDataFrame(said, "n int, value string"), at["log"])
    return at


if __name__ == "__main__":
    run(SparkSession.builder.appName("quillbin").getOrCreate())
