"""Text formats of the binning pipeline as DataFrames.

Every reader gives one row for each record and lets Spark split the file; nothing is read on
the driver.  Lines that do not fit the format are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.functions.sequences import cleaned


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def fields(line: str = "value") -> Column:
    return F.split(line, "\t")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records that begin with ``>``: ``(id, body, record)``; id is the first run of non-blank characters of the head line, record all of it as it stands."""
    whole = spark.read.option("lineSep", ">").text(path)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\\n') + 1)")).otherwise("")
    return whole.select(head.alias("id"), body.alias("body"), F.col("value").alias("record")).where("id <> ''")


def fasta(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """``(id, seq, length)``: letters A, T, G and C only, in upper case."""
    seq = cleaned(F.col("body"))
    return records(spark, path).select("id", seq.alias("seq")).withColumn("length", F.length("seq").cast("long")).where(F.col("length") >= min_length)


def long_records(spark: SparkSession, path: str, min_length: int) -> DataFrame:
    """``(value)``: the FASTA records as they stand whose A, T, G and C number at least min_length."""
    return records(spark, path).where(F.length(cleaned(F.col("body"))) >= min_length).select(F.concat(F.lit(">"), F.regexp_replace("record", r"\s+$", "")).alias("value"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """FASTA of cut sequences named ``parent.N``: ``(id, parent, seq)``."""
    return fasta(spark, path).select("id", F.regexp_extract("id", r"^([^.]*)", 1).alias("parent"), "seq")


def base_depths(spark: SparkSession, path: str) -> DataFrame:
    """``(id, depths array<double>)`` from FASTA-shaped depth files."""
    numbers = F.filter(F.split("body", r"\s+"), lambda x: x != "")
    return records(spark, path).select("id", F.transform(numbers, lambda x: x.cast("double")).alias("depths"))


def depth_list(spark: SparkSession, path: str) -> DataFrame:
    """``(sample int, file, read_length int)``, samples from 1 in the order of the list."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    kept = numbered.where(F.trim("line") != "").select("n", F.split(F.trim("line"), r"\s+").alias("f"))
    return kept.select(F.row_number().over(W.orderBy("n")).alias("sample"), F.col("f")[0].alias("file"), F.try_element_at("f", F.lit(2)).cast("int").alias("read_length"))


def window_depths(spark: SparkSession, path: str) -> DataFrame:
    """``(id, sample int, mean double, windows array<double>)`` from ``id, mean, windows...``, samples parted by ``#``."""
    split = F.split("value", "\t", 2)
    rows = lines(spark, path).select(split[0].alias("id"), F.posexplode(F.split(split[1], "#")).alias("n", "cells"))
    numbers = F.transform(F.filter(F.split("cells", "\t"), lambda x: x != ""), lambda x: x.cast("double"))
    return rows.select("id", (F.col("n") + 1).alias("sample"), numbers.alias("x")).select("id", "sample", F.col("x")[0].alias("mean"), F.expr("slice(x, 2, size(x))").alias("windows"))


def marker_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(gene, place int, id, depths array<double>, length long)`` from rows ``gene, id(depth[,depth...],length), ...``."""
    rows = lines(spark, path).select(fields()[0].alias("gene"), F.posexplode(F.slice(fields(), 2, F.greatest(F.size(fields()) - 1, F.lit(0)))).alias("place", "cell"))
    numbers = F.transform(F.split(F.regexp_extract("cell", r"\(([^()]*)\)$", 1), ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999999.999999")).cast("double"))
    rows = rows.select("gene", "place", F.regexp_extract("cell", r"^([^(]+)", 1).alias("id"), numbers.alias("x")).where("id <> ''")
    return rows.select("gene", "place", "id", F.expr("slice(x, 1, greatest(size(x) - 1, 0))").alias("depths"), F.try_element_at("x", F.lit(-1)).cast("long").alias("length"))


def markers(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """Distinct ``(gene, id)`` of sequences of at least min_length."""
    return marker_cells(spark, path).where((F.col("length") >= min_length) | F.lit(min_length <= 0)).select("gene", "id").distinct()


def cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """``(len1, len2, smean, ssd, dmean, dsd, diff, cutoff)``, both ways round, from ``A vs B`` and seven numbers."""
    x = fields()
    pair = F.split(x[0], " vs ")
    number = [x[i].cast("double") for i in range(1, 8)]
    rows = lines(spark, path).select(
        pair[0].cast("int").alias("len1"), pair[1].cast("int").alias("len2"), *[number[i].alias(n) for i, n in enumerate(("smean", "ssd", "dmean", "dsd"))], number[4].alias("diff"), F.greatest(*number[4:7]).alias("cutoff")
    )
    swapped = rows.where("len1 <> len2").select(F.col("len2").alias("len1"), F.col("len1").alias("len2"), *rows.columns[2:])
    return rows.unionByName(swapped)


def pinned_seeds(spark: SparkSession, path: str, with_line: bool = False) -> DataFrame:
    """``(seed, id)``: one seed in each line, its members joined by ``;``; with_line adds ``line``, which grows along the file."""
    rows = lines(spark, path).select(F.trim("value").alias("seed"), F.monotonically_increasing_id().alias("line"))
    rows = rows.select("seed", F.explode(F.split("seed", ";")).alias("id"), "line").where("id <> ''")
    return rows if with_line else rows.drop("line")


def coords(spark: SparkSession, path: str) -> DataFrame:
    """Alignment coordinates: ``(s1, e1, s2, e2, len_r, len_q, ref, qry, value, line)``, line grows along the file; the four head lines do not begin with a number."""
    x = fields()
    number = lambda i: F.expr(f"try_cast(split(value, '\\t')[{i}] as bigint)")
    rows = lines(spark, path).withColumn("line", F.monotonically_increasing_id()).where(F.size(x) >= 11)
    return rows.select(number(0).alias("s1"), number(1).alias("e1"), number(2).alias("s2"), number(3).alias("e2"), number(7).alias("len_r"), number(8).alias("len_q"), F.element_at(x, -2).alias("ref"), F.element_at(x, -1).alias("qry"), "value", "line").where("s1 is not null and e2 is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)``: the lines of one file as they stand; line grows along it."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))


def marker_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Search table: ``(gene, model, evalue)`` from the first, fourth and fifth fields of lines without ``#``."""
    x = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where(~F.col("value").startswith("#")).select(x[0].alias("gene"), x[3].alias("model"), x[4].cast("double").alias("evalue"))


def gene_places(spark: SparkSession, path: str) -> DataFrame:
    """``(gene, id)``: genes named ``>id_start_end_strand`` and the sequences they lie on."""
    name = F.regexp_extract("value", r"^>(\S+)", 1)
    return lines(spark, path).where(F.col("value").startswith(">")).select(name.alias("gene"), F.regexp_extract(name, r"^(.+)_\d+_\d+_[+-]$", 1).alias("id")).where("id <> ''")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``(model, gene)``: both names of a line stand for ``a|b``."""
    x = fields()
    return lines(spark, path).select(F.explode(F.array(x[0], x[1])).alias("model"), F.concat_ws("|", x[0], x[1]).alias("gene"))


def classified(spark: SparkSession, path: str) -> DataFrame:
    """``(id, bin, length, depths array<double>)``; bin is a number as text or ``unassigned``."""
    x = fields()
    return lines(spark, path).where(F.size(x) >= 4).select(x[0].alias("id"), x[1].alias("bin"), x[2].cast("long").alias("length"), F.filter(F.transform(F.slice(x, 4, F.size(x) - 3), lambda c: c.try_cast("double")), lambda c: c.isNotNull()).alias("depths"))


def truth(spark: SparkSession, path: str, skip_first: bool = True) -> DataFrame:
    """``(id, species)``; the last line of an id counts.  skip_first leaves out the file's first line, as a head."""
    rows = spark.read.schema("id string, species string").csv(path, sep="\t", header=skip_first, quote="", mode="PERMISSIVE")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("n", place).where("species is not null").groupBy("id").agg(F.max_by("species", "n").alias("species"))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """``(seed, sample int, lo long, hi long)`` from ``seed, lo, hi[, lo, hi ...]``."""
    x = fields()
    rows = lines(spark, path).select(x[0].alias("seed"), x.alias("x"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor((F.size("x") - 1) / 2).cast("int")), lambda i: F.struct(i.alias("sample"), F.element_at("x", 2 * i).cast("long").alias("lo"), F.element_at("x", 2 * i + 1).cast("long").alias("hi")))
    return rows.where(F.size("x") >= 3).select("seed", F.explode(pairs).alias("p")).select("seed", "p.*")
