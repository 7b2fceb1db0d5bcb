"""What comes before and after binning, from files to files: ``python -m quillbin.plans.tools NAME --flag ...``.

Each output is a folder of text parts whose lines follow each other in the order of the parts.
Genes and their matches in the marker table come from other programs' files.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.operators import coverage, depth, evaluation
from quillbin.operators.shared import shared_folder
from quillbin.sources import readers, stretches, writers

TOOLS: dict[str, tuple[Callable[..., dict[str, DataFrame]], tuple[str, ...]]] = {}


def tool(*flags: str) -> Callable:
    """Registers a function of (spark, values of flags) that gives each output's lines by name; a flag with ``?`` may be left out."""

    def add(f: Callable) -> Callable:
        TOOLS[f.__name__.replace("_", "-")] = f, flags
        return f

    return add


def in_order(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("line").alias("n"), "value")


def percents(*columns: str) -> list[Column]:
    return [depth.two_decimals(F.col(c)) for c in columns]


@tool("list", "morelen")
def depths(spark: SparkSession, list: str, morelen: str) -> dict[str, DataFrame]:
    """Mean and window depths of all samples of a list ``file, read length``; records of fewer than morelen places are left out."""
    listed = readers.depth_list(spark, list).collect()  # a line for each sample
    samples = spark.createDataFrame([(r["file"], r["sample"], r["read_length"]) for r in listed], "file string, sample int, read_length int")
    rows = stretches.depths(spark, [r["file"] for r in listed])
    return {"depths": depth.prepared_report(depth.prepared(rows, samples, int(morelen)))}


@tool("fafile", "cutfile", "depthfile")
def piece_depths(spark: SparkSession, fafile: str, cutfile: str, depthfile: str) -> dict[str, DataFrame]:
    """``id, mean depth`` of cut sequences, in their order: pieces ``parent.N`` at their first place in their parent, others of their own depths.

    Letters other than A, T, G and C take part in no comparison, so parents and pieces are read without them; then their depths
    need to be those of the letters kept.
    """
    own = stretches.depths(spark, depthfile).select(F.col("id").alias("parent"), "position", "depths").checkpoint()
    parents = stretches.letters(spark, fafile).select(F.col("id").alias("parent"), "position", "seq")
    cut = readers.pieces(spark, cutfile).withColumn("line", F.monotonically_increasing_id()).checkpoint()
    found = depth.piece_means(cut.where("id <> parent").select("id", "parent", "seq"), parents, own)
    whole = own.groupBy("parent").agg((F.sum(F.aggregate("depths", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("depths"))).alias("mean")).withColumnRenamed("parent", "id")
    means = found.select("id", "mean").unionByName(cut.where("id = parent").select("id").join(whole, "id"))
    return {"piece_depths": in_order(cut.join(means, "id").select("line", F.concat_ws("\t", "id", *percents("mean")).alias("value")))}


@tool("first", "second")
def pool(spark: SparkSession, first: str, second: str) -> dict[str, DataFrame]:
    """``id, depth, depth``: the lines of two depth files side by side; the first one's ids count."""
    sides = [coverage.numbered(readers.numbered_lines(spark, at), "line").select("n", F.split("value", "\t")[0].alias("id"), F.split("value", "\t")[1].alias(c)) for at, c in ((first, "a"), (second, "b"))]
    joined = sides[0].join(sides[1].drop("id"), "n", "left")
    return {"pooled": joined.select("n", F.concat_ws("\t", "id", "a", F.coalesce("b", F.lit(""))).alias("value"))}


@tool("coords")
def best_references(spark: SparkSession, coords: str) -> dict[str, DataFrame]:
    """The coordinates of each query with the reference that covers most, below the file's fourth line; of equal references the first by name."""
    rows = readers.coords(spark, coords).checkpoint()
    head = readers.numbered_lines(spark, coords).orderBy("line").limit(4).orderBy(F.desc("line")).limit(1)
    return {"coords_filter": in_order(evaluation.best_rows(rows).select("line", "value").unionByName(head.select(F.lit(-1).cast("long").alias("line"), "value")))}


@tool("coords")
def covered_queries(spark: SparkSession, coords: str) -> dict[str, DataFrame]:
    """The coordinates of queries of which nine tenths are covered, and those of the others."""
    good, rest = evaluation.well_covered(readers.coords(spark, coords).checkpoint())
    return {"covered": in_order(good), "remain": in_order(rest)}


@tool("classified", "minlen", "truth?", "coords?", "names?")
def evaluate(spark: SparkSession, classified: str, minlen: str, truth: str | None = None, coords: str | None = None, names: str | None = None) -> dict[str, DataFrame]:
    """Bins against species: ``bin, species[, name], precision, sensitivity, assigned`` for each, the four figures of all, and each sequence's line.

    Species come from ``truth`` (``id, species``), or from best coordinates (reference and query
    last), whose references ``names`` gives a name.  Sensitivity, assigned and performance are
    of the sequences of minlen letters or more.
    """
    if (truth is None) == (coords is None):
        raise ValueError("either --truth or --coords")
    bins = readers.classified(spark, classified).checkpoint()
    if truth is not None:
        species = readers.truth(spark, truth)
    else:
        own = readers.coords(spark, coords)
        species = own.groupBy(F.col("qry").alias("id")).agg(F.max_by("ref", "line").alias("species"))
    each = bins.join(species, "id").checkpoint()
    matrix = each.groupBy("bin", "species").agg(F.sum("length").alias("length")).checkpoint()
    wanted = each.where(F.col("length") >= int(minlen)).select("species", "length")
    found = evaluation.per_species(matrix, wanted)
    label = []
    if names:
        known = readers.lines(spark, names).select(F.split("value", "\t")[0].alias("species"), F.split("value", "\t")[1].alias("name")).dropDuplicates(["species"])
        found, label = found.join(known, "species", "left"), [F.coalesce("name", F.lit(""))]
    total = evaluation.overall(matrix, wanted)
    return {
        "species": found.select(F.struct(F.col("bin").try_cast("long").alias("number"), "bin", "species").alias("n"), F.concat_ws("\t", "bin", "species", *label, *percents("precision", "sensitivity", "assigned")).alias("value")),
        "total": total.select(F.lit(0).alias("n"), F.concat_ws("\t", *percents("performance", "precision", "sensitivity", "assigned")).alias("value")),
        "sequences": each.select(F.col("id").alias("n"), F.concat_ws("\t", "id", "bin", "species", F.col("length").cast("string")).alias("value")),
    }


@tool("classified", "coords")
def one_genome(spark: SparkSession, classified: str, coords: str) -> dict[str, DataFrame]:
    """How well one bin holds the sequences that coordinates name: their lines ``id, bin, depth, length``, and a line of figures below its head."""
    bins = readers.classified(spark, classified).checkpoint()
    wanted = readers.coords(spark, coords).select(F.col("qry").alias("id")).distinct().checkpoint()
    table = bins.join(wanted, "id", "left_semi")
    sums = bins.agg(F.sum(F.when(F.col("bin") == evaluation.UNASSIGNED, F.col("length")).otherwise(0)).alias("unassigned"), F.count_distinct(F.when(F.col("bin") != evaluation.UNASSIGNED, F.col("bin"))).alias("bins"))
    row = evaluation.one_genome(bins, wanted).crossJoin(sums)  # one row each
    head = F.lit("Precision(%)\tSencitivity(%)\tAssign(%)\tIndividual_Assigned\tUnassigned\tBinNum")  # spelled as its readers know it
    figures = F.concat_ws("\t", *percents("precision", "sensitivity", "assigned_all", "assigned"), F.col("unassigned").cast("string"), F.col("bins").cast("string"))
    return {
        "table": table.select(F.col("id").alias("n"), F.concat_ws("\t", "id", "bin", F.format_string("%s", F.try_element_at("depths", F.lit(1))), F.col("length").cast("string")).alias("value")),
        "stat": row.select(F.explode(F.array(F.struct(F.lit(0).alias("n"), head.alias("value")), F.struct(F.lit(1).alias("n"), figures.alias("value")))).alias("r")).select("r.*"),
    }


@tool("fafile", "minlen")
def long_sequences(spark: SparkSession, fafile: str, minlen: str) -> dict[str, DataFrame]:
    """The FASTA records with at least minlen letters A, T, G and C, as they stand: what gene prediction reads."""
    return {"long": in_order(readers.long_records(spark, fafile, int(minlen)).withColumn("line", F.monotonically_increasing_id()))}


@tool("fafile", "depthfile", "genes", "hits", "synonyms")
def markers(spark: SparkSession, fafile: str, depthfile: str, genes: str, hits: str, synonyms: str) -> dict[str, DataFrame]:
    """The marker table from predicted genes, search tables (several, parted by commas), synonyms, window depths and lengths.

    A gene has the model with its least E-value; sequences without depth are left out, and one
    with two genes of a model is named twice.
    """
    found = evaluation.least_evalue(readers.marker_hits(spark, hits.split(",")))
    same = readers.synonyms(spark, synonyms).withColumnRenamed("gene", "shared").dropDuplicates(["model"])
    models = found.join(same, "model", "left").select("gene", F.coalesce("shared", "model").alias("model"))
    on = readers.gene_places(spark, genes).join(models, "gene").select(F.col("model").alias("gene"), "id")
    means = readers.window_depths(spark, depthfile).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "mean"))), lambda x: x["mean"]).alias("depths"))
    lengths = stretches.letters(spark, fafile).groupBy("id").agg(F.sum(F.length("seq")).cast("long").alias("length"))
    return {"SCGtype_SCGscaffoldDepth": writers.marker_report(on.join(means, "id").join(lengths, "id"))}


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> dict[str, str]:
    """Runs a tool and writes its outputs below ``--outdir``; returns the path of each."""
    p = argparse.ArgumentParser(prog="quillbin.plans.tools", description=__doc__)
    names = p.add_subparsers(dest="name", required=True)
    for name, (f, flags) in TOOLS.items():
        sub = names.add_parser(name, help=(f.__doc__ or "").splitlines()[0])
        for flag in flags:
            sub.add_argument(f"--{flag.removesuffix('?')}", required=not flag.endswith("?"))
        sub.add_argument("--outdir", default=".")
    a = vars(p.parse_args(argv))
    name, outdir = a.pop("name"), a.pop("outdir").rstrip("/")
    shared_folder(spark)
    at = {}
    for output, rows in TOOLS[name][0](spark, **a).items():
        at[output] = f"{outdir}/{output}"
        writers.write_lines(rows, at[output])
    return at


if __name__ == "__main__":
    run(SparkSession.builder.appName("quillbin tools").getOrCreate())
