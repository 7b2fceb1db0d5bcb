"""I-Match fingerprints with randomised lexicons, in DataFrame functions alone.

Terms are the lower-case runs of letters and digits of a text.  The lexicon holds those
whose inverse document frequency lies in a band; document frequencies are counted over all
documents in a table of 2^20 hashed terms, whose size does not grow with the corpus.  The
band's floor is far above what rare terms add up to in a cell of the table, so a term is in
the lexicon by its own frequency.

A text's terms in the lexicon are made distinct, sorted, and hashed once for each of a
number of random subsets of the lexicon.
Subsets are of several sizes, so that texts of any length have some that hold few of their
terms; those hashes survive edits.  The likeness of two texts is the part of the subsets
with a term of either on which they agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.llm.common import table
from quillbin.llm.mixing import given

CELL_BITS = 20
#: Parts of all documents that a term of the lexicon is in.
BAND = (0.002, 0.2)
#: A subset of rate b holds one of 2^b terms; so many chains of subsets, one of each rate.
RATES, CHAINS = (1, 3, 5, 7, 9, 11), 16
SEED = 42
#: Stands in a fingerprint for a subset without a term.
NONE = "----"


def terms(text: Column) -> Column:
    """Sorted distinct hashes of the terms of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lit(SEED), w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> bytes:
    """Seven cells of the table of hashed terms in each byte: 1 where the cell's document frequency lies in the band.

    The table's size is fixed, so it can come to the driver and go to every task.
    """
    cells = F.transform(terms(F.col("text")), lambda t: F.shiftrightunsigned(t, 64 - CELL_BITS).cast("int"))
    frequency = docs.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    n = docs.count()
    rows = frequency.where(F.col("n").between(max(2.0, band[0] * n), max(2.0, band[1] * n))).select("cell").toPandas()
    flags = np.zeros(-(-(1 << CELL_BITS) // 7), np.uint8)
    cell = rows["cell"].to_numpy(np.int64)
    np.bitwise_or.at(flags, cell // 7, (1 << cell % 7).astype(np.uint8))
    return flags.tobytes()


def fingerprint(term_hashes: str, flags: str) -> str:
    """SQL: four hex digits for each subset; flags is a binary column.

    Subsets of one chain lie within each other, each with more bits of the terms' hashes
    set than the one before, so a chain looks at each term about once.
    """
    cell = f"cast(shiftrightunsigned(t, {64 - CELL_BITS}) as int)"
    known = f"filter(v.all, t -> shiftright(ascii(cast(substring({flags}, {cell} div 7 + 1, 1) as string)), {cell} % 7) & 1 = 1)"
    own = given({"all": term_hashes}, f"array_sort({known})")
    shifts = ", ".join(str(k * (64 - CELL_BITS - max(RATES)) // CHAINS) for k in range(CHAINS))
    masks = ", ".join(f"{(1 << bits) - 1}L" for bits in RATES)
    digits = f"if(size(v.in) = 0, '{NONE}', substring(lpad(lower(hex(xxhash64({SEED}, v.in))), 16, '0'), 13, 4))"
    step = given({"in": "filter(s.in, t -> shiftrightunsigned(t, r) & m = m)", "out": "s.out"}, f"named_struct('in', v.in, 'out', concat(v.out, {digits}))")
    chain = f"aggregate(array({masks}), named_struct('in', v.own, 'out', ''), (s, m) -> {step}, s -> s.out)"
    return given({"own": own}, f"concat_ws('', transform(array({shifts}), r -> {chain}))")


def likeness(a: str, b: str) -> str:
    """SQL: of the subsets with a term on either side, the part that agree; 1 if there are none."""
    n = len(RATES) * CHAINS
    parts = given({"x": f"substring({a}, i * 4 + 1, 4)", "y": f"substring({b}, i * 4 + 1, 4)"}, f"named_struct('any', v.x <> '{NONE}' or v.y <> '{NONE}', 'same', v.x = v.y)")
    count = f"aggregate(transform(sequence(0, {n - 1}), i -> {parts}), named_struct('any', 0D, 'same', 0D), (s, x) -> named_struct('any', s.any + if(x.any, 1D, 0D), 'same', s.same + if(x.any and x.same, 1D, 0D)), s -> if(s.any = 0D, 1D, s.same / s.any))"
    return count


#: Bytes of text in a range, about.
RANGE_BYTES = 64 << 20


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows with their range of doc_id, an order within it (nulls last, equal ids by their text's hash), and borrowed copies.

    The last row of a range is the borrowed first row of the next range, of the first range
    after the last, so that every row's next one by doc_id stands in its range.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    edges = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    own = F.size(F.filter(F.lit(sorted({*(edges or [])})).cast("array<bigint>"), lambda e: e <= F.col("doc_id")))
    rows = docs.withColumn("range", F.when(F.col("doc_id").isNull(), n).otherwise(own)).withColumn("order", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.xxhash64("text").alias("hash")))
    firsts = rows.groupBy("range").agg(F.min_by(F.struct(*docs.columns), "order").alias("row"))
    lend = firsts.withColumn("range", F.coalesce(F.lag("range").over(W.orderBy("range")), F.max("range").over(W.partitionBy())))  # one row for each range
    both = rows.withColumn("borrowed", F.lit(False)).unionByName(lend.select("range", "row.*").withColumn("borrowed", F.lit(True)), allowMissingColumns=True)
    return both


def compared(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one row for each of docs.

    Null texts are empty; texts without terms of the lexicon have a fingerprint of dashes, which is like itself alone.  Repeated rows
    follow each other in the order, and rows with a null id come last.
    """
    flags = bytearray(lexicon(docs, band))
    rows = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("flags", F.lit(flags)).withColumn("terms", terms(F.col("text"))).withColumn("fingerprint", F.expr(fingerprint("terms", "flags"))).drop("terms", "flags")
    order = W.partitionBy("range").orderBy("borrowed", "order")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not borrowed")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("flags", F.lit(flags)).withColumn("terms", terms(F.col("edited"))).withColumn("edited_fingerprint", F.expr(fingerprint("terms", "flags")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.expr(likeness("fingerprint", "edited_fingerprint")).alias("near_edited"),
        F.expr(likeness("fingerprint", "next_fingerprint")).alias("near_next"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
