"""Depths of records of any size: pieces with positions instead of one array for each record.

``depths`` rows are ``(file, record, id, position, depths array<double>)``, as
``sources.stretches.depths`` gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbin.sources.stretches import blocks

RECORD = ("file", "record", "id")


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounded as C does: by the double's exact value."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.2f}", na_action="ignore")

    return run(value)


def binned(depths: DataFrame, step: int) -> DataFrame:
    """``(file, record, id, bin, depth, k)``: sums and counts of each step's places, of pieces first; rows need ``read_length`` and ``inner`` places after it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for file, record, name, position, x, skip, inner in zip(p["file"], p["record"], p["id"], p["position"], p["depths"], p["read_length"], p["inner"], strict=True):
                at = np.arange(position - 1, position - 1 + len(x)) - skip
                inside = (at >= 0) & (at < inner)
                if inside.any():
                    b, x = at[inside] // step, np.asarray(x, float)[inside]
                    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                    out.append(pd.DataFrame({"file": file, "record": record, "id": name, "bin": b[first], "depth": np.add.reduceat(x, first), "k": np.diff(np.append(first, len(b)))}))
            if out:
                yield pd.concat(out)

    rows = depths.select(*RECORD, "position", "depths", "read_length", "inner").mapInPandas(run, "file string, record long, id string, bin long, depth double, k long")
    return rows.groupBy(*RECORD, "bin").agg(F.sum("depth").alias("depth"), F.sum("k").alias("k"))


def prepared(depths: DataFrame, samples: DataFrame, least: int, size: int = 500, step: int = 250) -> DataFrame:
    """``(id, sample, record, mean, windows array<string>)`` as text of two decimals; samples: ``(file, sample, read_length)``.

    Records with fewer than ``least`` places are left out.  Of the others a read's length is cut
    off both ends; means are of ``size`` places every ``step``, or the whole mean where there
    are fewer.  Where nothing is left, or all of it is 0, both are ``0``.  size is a multiple of
    step, so a window is a few bins' sum.
    """
    total = depths.groupBy(*RECORD).agg(F.sum(F.size("depths")).alias("total")).where(F.col("total") >= least)
    kept = total.join(samples, "file").withColumn("inner", F.greatest(F.col("total") - 2 * F.coalesce("read_length", F.lit(0)), F.lit(0)))
    kept = kept.withColumn("read_length", F.coalesce("read_length", F.lit(0))).checkpoint()
    bins = binned(depths.join(kept.select(*RECORD, "read_length", "inner"), [*RECORD]), step).checkpoint()
    whole = bins.groupBy(*RECORD).agg(F.sum("depth").alias("all"))
    per = size // step
    each = bins.withColumn("w", F.explode(F.sequence(F.greatest(F.col("bin") - (per - 1), F.lit(0)), F.col("bin"))))
    sums = each.groupBy(*RECORD, "w").agg((F.sum("depth") / size).alias("depth"), F.sum("k").alias("k")).where(F.col("k") == size)
    text = sums.select(*RECORD, "w", two_decimals(F.col("depth")).alias("depth"))
    lists = text.groupBy(*RECORD).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "depth"))), lambda x: x["depth"]).alias("windows"))
    rows = kept.join(whole, [*RECORD], "left").join(lists, [*RECORD], "left")
    zero = F.coalesce("all", F.lit(0.0)) == 0
    rows = rows.withColumn("mean", two_decimals(F.when(~zero, F.col("all") / F.col("inner"))))
    return rows.select("id", "sample", "record", F.when(zero, F.lit("0")).otherwise(F.col("mean")).alias("mean"), F.when(zero, F.array(F.lit("0"))).otherwise(F.coalesce("windows", F.array("mean"))).alias("windows"))


def prepared_report(found: DataFrame) -> DataFrame:
    """``id, mean, windows...``, samples parted by ``#``, ids in the order in which they first come; see ``sources.writers``."""
    order = F.struct("sample", "record")
    cells = F.concat_ws("\t", F.col("mean"), F.concat_ws("\t", "windows"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), cells.alias("x")))), lambda p: p["x"])
    return found.groupBy("id").agg(F.min(order).alias("n"), F.array_join(parts, "#").alias("x")).select("n", F.concat_ws("\t", "id", "x").alias("value"))


# --- pieces in their parents -------------------------------------------------------------

#: Letters of an anchor, and how many anchors in a row one is chosen of.
ANCHOR, CHOICE = 16, 16
BLOCK = 4_096


def mixed(seq: str | None) -> np.ndarray:
    """A number for each run of ANCHOR letters A, C, G and T."""
    code = np.frombuffer((seq or "").encode(), np.uint8)
    code = ((code >> 1) & 3).astype(np.uint64)  # A, C, T and G differ in these two bits
    n = len(code) - ANCHOR + 1
    if n < 1:
        return np.empty(0, np.uint64)
    at = np.zeros(n, np.uint64)
    for i in range(ANCHOR):
        at = (at << np.uint64(2)) | code[i : i + n]
    at *= np.uint64(0x9E3779B97F4A7C15)
    return at ^ (at >> np.uint64(29))


def chosen(seq: str | None, only_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 and numbers of the least of each CHOICE runs, the first of equal ones: a text that has another one in it has its first choice there as well."""
    x = mixed(seq)
    if only_first:
        x = x[:CHOICE]
    if len(x) < CHOICE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x, CHOICE)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, x[at].view(np.int64)


def anchors(rows: DataFrame, by: list[str], column: str, only_first: bool = False) -> DataFrame:
    """``rows(by..., column)`` to ``(by..., at, anchor)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [chosen(s, only_first) for s in p[column]]
            sizes = [len(a) for a, _ in found]
            out = p[by].loc[p.index.repeat(sizes)].reset_index(drop=True)
            out["at"] = np.concatenate([a for a, _ in found]) if found else []
            out["anchor"] = np.concatenate([h for _, h in found]) if found else []
            yield out

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, column).mapInPandas(run, f"{kinds}, at long, anchor long")


def first_places(pieces: DataFrame, parents: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(id, parent, place)``: where each piece first stands in its parent, from 1; pieces that do not stand there have no row.

    pieces: ``(id, parent, seq)``, parents: ``(parent, position, seq)``, both of the letters A, C, G
    and T.  Anchors of pieces meet those of parents by equality; whether a whole piece stands
    at such a place is then checked block by block, so no row holds a parent.  Pieces too short
    for an anchor are looked for in all of their parent's blocks.  In a run of one letter every
    place is an anchor, so a piece of such letters is checked at each of them.
    """
    overlap = ANCHOR + CHOICE - 2
    if block <= overlap:
        raise ValueError(f"blocks need more than {overlap} letters")
    by_block = blocks(parents, ["parent"], "seq", block, overlap).checkpoint()
    sized = pieces.where("seq <> ''").withColumn("n", F.length("seq"))
    known = anchors(by_block, ["parent", "block"], "seq").select("parent", "anchor", (F.col("block") * block + F.col("at") + 1).alias("found")).distinct()
    wanted = anchors(sized.where(F.col("n") > overlap), ["id", "parent"], "seq", only_first=True)
    places = wanted.join(known, ["parent", "anchor"]).select("id", "parent", (F.col("found") - F.col("at")).alias("place")).where("place >= 1")
    spans = places.join(sized, ["id", "parent"])
    low, high = F.floor((F.col("place") - 1) / block), F.floor((F.col("place") + F.col("n") - 2) / block)
    spans = spans.withColumn("asked", high - low + 1).select("id", "parent", "place", "asked", "n", "seq", F.explode(F.sequence(low, high)).alias("block"))
    start = F.greatest(F.col("place") - 1, F.col("block") * block)
    size = F.least(F.col("place") - 1 + F.col("n"), (F.col("block") + 1) * block) - start
    spans = spans.select("id", "parent", "place", "asked", "block", (start - F.col("block") * block + 1).cast("int").alias("from"), F.substring("seq", (start - F.col("place") + 2).cast("int"), size.cast("int")).alias("part"))
    same = spans.join(by_block.withColumnRenamed("seq", "own"), ["parent", "block"]).where(F.col("part") == F.substring("own", F.col("from"), F.length("part")))
    long = same.groupBy("id", "parent", "place").agg(F.count("*").alias("k"), F.max("asked").alias("asked")).where("k = asked").select("id", "parent", "place")
    short = sized.where(F.col("n") <= overlap).join(by_block.withColumnRenamed("seq", "own"), "parent").withColumn("i", F.expr("locate(seq, own)"))
    short = short.where("i > 0").select("id", "parent", (F.col("block") * block + F.col("i")).alias("place"))
    return long.unionByName(short).groupBy("id", "parent").agg(F.min("place").alias("place"))


def piece_means(pieces: DataFrame, parents: DataFrame, depths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(id, parent, place, mean)``: the mean depth of each piece at its first place in its parent, of all of the parent's depths where it stands nowhere (place is null).

    pieces, parents: see ``first_places``; depths: ``(parent, position, depths array<double>)``.
    A pair of id and parent is one piece; parents without depths have no mean.
    """
    own = blocks(depths, ["parent"], "depths", block).checkpoint()
    places = first_places(pieces, parents, block)
    rows = pieces.select("id", "parent", F.length("seq").alias("n")).join(places, ["id", "parent"], "left").checkpoint()
    low, high = F.floor((F.col("place") - 1) / block), F.floor((F.col("place") + F.col("n") - 2) / block)
    each = rows.where("place is not null").select("id", "parent", "place", "n", F.explode(F.sequence(low, high)).alias("block"))
    start = F.greatest(F.col("place") - 1 - F.col("block") * block, F.lit(0))
    size = F.least(F.col("place") - 1 + F.col("n") - F.col("block") * block, F.lit(block)) - start
    each = each.join(own, ["parent", "block"]).withColumn("x", F.slice("depths", (start + 1).cast("int"), size.cast("int")))
    plus = lambda s, x: s + x
    each = each.select("id", "parent", F.aggregate("x", F.lit(0.0), plus).alias("s"), F.size("x").alias("k"))
    found = each.groupBy("id", "parent").agg((F.sum("s") / F.sum("k")).alias("of_piece"))
    whole = own.groupBy("parent").agg((F.sum(F.aggregate("depths", F.lit(0.0), plus)) / F.sum(F.size("depths"))).alias("of_all"))
    out = rows.join(found, ["id", "parent"], "left").join(whole, "parent", "left")
    return out.select("id", "parent", "place", F.when(F.col("place").isNull(), F.col("of_all")).otherwise(F.col("of_piece")).alias("mean"))
