"""Ranked lexical search: postings bucketed by term, integer scores.

``postings`` makes the index: tasks count the terms of their documents and give one block
of each term, so a frequent term is many blocks of a bounded size and never one row, and
the blocks are dealt out and sorted by the bucket of their term.  Blocks of the empty term,
in a bucket of their own, list the documents themselves.  ``search`` joins the blocks of the
queries' terms, deals their entries out by document, scores each match in 64-bit integers,
sums the scores of a query and a document, and ranks them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillbin.llm.common import lean, materialize, table

#: Buckets of terms, that of the documents, best documents of a query.
BUCKETS, DOCUMENTS, BEST = 64, -1, 50
#: Bytes of text after which a task gives its blocks, and most entries of a block.
BLOCK_BYTES, BLOCK_ENTRIES = 32 << 20, 65_536
#: Entries of queries' terms that a task scores.
TASK_ENTRIES = 500_000
#: Places of documents within one task.
PLACES = 1 << 40
#: Documents are at ``base + rows``; counts: occurrences of the term, or of all terms where it is the empty one, which alone has ids.
SCHEMA = "bucket int, term string, base long, rows array<int>, counts array<int>, ids array<long>"

#: ASCII letters and digits, in lower case, and all other bytes of UTF-8; the rest are blanks.
KEPT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


class Blocks:
    """Postings of the documents from place ``base`` on, each term's entries in their order."""

    def __init__(self, base: int) -> None:
        self.base, self.rows, self.bytes = base, 0, 0
        self.entries: list[tuple[int, int | None, Counter[bytes], int]] = []

    def add(self, text: str | None, doc_id: int | None) -> None:
        own = terms(text)
        if own:
            self.entries.append((self.rows, doc_id, Counter(own), len(own)))
            self.bytes += len(text or "")
        self.rows += 1

    def batch(self) -> pa.RecordBatch:
        """Columns of SCHEMA but the bucket: the documents, then a block for each term, cut at BLOCK_ENTRIES."""
        size = np.array([len(c) for _, _, c, _ in self.entries], np.int64)
        place = np.array([e[0] for e in self.entries], np.int32)
        flat = pa.array([t for _, _, c, _ in self.entries for t in c], pa.binary()).dictionary_encode()
        code = np.asarray(flat.indices).astype(np.int64)
        count = np.fromiter((n for _, _, c, _ in self.entries for n in c.values()), np.int32, len(code))
        order = np.argsort(code, kind="stable")
        # the documents' entries come first, with the number of no term
        key = np.concatenate((np.full(len(size), -1), code[order]))
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        nth = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        start = np.flatnonzero(nth % BLOCK_ENTRIES == 0)
        offsets = pa.array(np.append(start, len(key)).astype(np.int32))
        documents = key[start] < 0
        names = pa.concat_arrays([pa.array([""] * int(documents.sum())), flat.dictionary.take(pa.array(key[start[~documents]])).cast(pa.string())])
        rows = np.concatenate((place, np.repeat(place, size)[order]))
        counts = np.concatenate((np.array([e[3] for e in self.entries], np.int32), count[order]))
        id_of = pa.array([e[1] for e in self.entries], pa.int64())
        ids = [id_of.slice(i, BLOCK_ENTRIES).to_pylist() if d else None for i, d in zip(start.tolist(), documents.tolist(), strict=True)]
        lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
        return pa.RecordBatch.from_arrays([names, pa.array([self.base] * len(start), pa.int64()), lists(rows), lists(counts), pa.array(ids, pa.list_(pa.int64()))], ["term", "base", "rows", "counts", "ids"])


def postings(docs: DataFrame, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` to the written index, blocks of ``SCHEMA``: of a term its documents' places, ids, occurrences and sizes.

    Every row is a document of its own, repeated rows and ids as well; a null id stays null.
    Texts that are null or have no term are in no block; an empty table has no blocks.
    Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(TaskContext.get().partitionId() * PLACES)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(text.as_py(), doc_id)
                if held.bytes >= block_bytes:
                    yield held.batch()
                    held = Blocks(held.base + held.rows)
        if held.entries:
            yield held.batch()

    blocks = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCHEMA.removeprefix("bucket int, "))
    bucket = F.when(F.col("term") == "", DOCUMENTS).otherwise(bucket_of(F.col("term"), buckets))
    # as many tasks as texts are read in; where these are more than buckets, a bucket is cut by the blocks' documents
    tasks = max(1, docs.rdd.getNumPartitions())
    part = F.pmod(F.xxhash64("base"), F.lit(-(-tasks // buckets)))
    dealt = blocks.select(bucket.alias("bucket"), "*").repartition(tasks, "bucket", part)
    return materialize(dealt.sortWithinPartitions("bucket", "term"), "postings", "zstd")


def weight(n: int, entries: Column) -> Column:
    """Of a term in ``entries`` of n documents: floor(1000 ln((2 n + 2) / (2 entries + 1)))."""
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * entries + 1).cast("double")))


def search(index: DataFrame, queries: DataFrame, best: int = BEST, buckets: int = BUCKETS) -> DataFrame:
    """``queries(item_id, text)`` to ``(item_id, rank int, doc_id long, score long)``, the ``best`` documents of each item with a score above 0.

    Equal scores by doc_id, null ids last, then by the document's place.  A document's score
    sums ``weight * ((10^9 tf) div (1000 tf + 20 m))`` over the item's distinct terms, where
    ``m = 50 + (50 size N) div L``.  Rows of one item_id, null as well, are one item; an item
    without a known term has no row.  Products stay below 2^63 for ``size * N`` below 10^17.
    """
    docs = index.where(F.col("bucket") == DOCUMENTS)
    total = docs.agg(F.sum(F.size("rows")).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 1
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    # small tables of known size, so that Spark broadcasts them only below its threshold
    items = materialize(queries.select("item_id", F.explode(words).alias("term")).distinct(), "items")
    wanted = items.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term").distinct()
    hit = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most as many as buckets
    index = index.where(F.col("bucket").isin(hit))
    own = index.where(F.col("bucket").isin(hit)).join(wanted, ["bucket", "term"])
    found = materialize(own.groupBy("term").agg(F.sum(F.size("rows").cast("long")).alias("entries")), "frequencies")
    tasks = max(1, -(-(found.agg(F.sum("entries")).first()[0] or 0) // TASK_ENTRIES))
    weighted = materialize(items.join(found, "term").select("item_id", "term", weight(n, F.col("entries")).alias("w")).where("w > 0"), "weights")
    entries = own.select("term", "base", F.explode(F.arrays_zip("rows", "counts")).alias("e")).select((F.col("base") + F.col("e.rows")).alias("row"), "term", F.col("e.counts").cast("long").alias("tf"))
    sized = docs.select("base", F.explode(F.arrays_zip("rows", "counts", "ids")).alias("e")).select((F.col("base") + F.col("e.rows")).alias("row"), F.col("e.ids").alias("doc_id"), F.expr(f"50 + (50L * e.counts * {n}L) div {length}L").alias("m"))
    # entries and documents meet by place, in parts of documents of even size, and a document's matches stay where they are
    matched = entries.repartition(tasks, "row").join(sized.repartition(tasks, "row").hint("shuffle_hash"), "row").select("row", "doc_id", "term", F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)").alias("part"))
    sums = matched.join(weighted, "term").groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return sums.withColumn("rank", place).where(F.col("rank") <= best).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, doc_id, size, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS size, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT i.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.size * s.n) // s.l)))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY i.item_id, p.r, p.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS k FROM x WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM o WHERE k <= {BEST}
"""
