"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (most frequent first), so that most take one
byte.  A document is coded once, as 2-bit byte counts of four ids in each control byte,
kept apart from its data bytes; the coded documents are dealt out by ranges of doc_id and
joined up to blocks.  Decoding a block is a lookup of control bytes in a table, a running
sum and four gathers.

    file   := b"QTF1" block*
    block  := n_docs u32, n_ids u32, n_control u32, n_data u32,
              doc ids i64[n_docs], present u8[n_docs], ids of each document u32[n_docs],
              control u8[n_control], data u8[n_data]
    control of a document := ceil(ids / 4) bytes
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.llm.common import fresh_dir, lean, materialize, table
from quillbin.llm.files import open_part, write_part
from quillbin.llm.tokens import batches, default_path, encoder

MAGIC = b"QTF1"
BLOCK_IDS = 1 << 18
#: Pieces that the tokenizer's cache keeps in a worker.
CACHE_WORDS = 1_600_000
#: About so many ids go to a file.
FILE_IDS = 3_000_000
#: Bytes of each of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def own_places(counts: np.ndarray) -> np.ndarray:
    """Which of all quads' places hold an id: not those that fill up a document's last quad."""
    quads = -(-counts // 4)
    own = np.ones(quads.sum() * 4, bool)
    ends = np.cumsum(quads) * 4
    for k in range(1, 4):
        own[ends[quads * 4 - counts >= k] - k] = False
    return own


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint32 values of documents with these counts to (control bytes, data bytes, data bytes of each document); a last quad is filled up with zeros."""
    own = own_places(counts)
    v = np.zeros(len(own), np.uint32)
    v[own] = values
    n = np.ones(len(v), np.uint8)
    longer = [np.flatnonzero(v > 0xFF)]
    for limit in (0xFFFF, 0xFFFFFF):
        longer.append(longer[-1][v[longer[-1]] > limit])
    for i in longer:
        n[i] += 1
    ends = np.cumsum(n, dtype=np.int64)
    at = ends - n
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    data[at] = v.astype(np.uint8)
    for k, i in enumerate(longer, 1):
        data[at[i] + k] = (v[i] >> np.uint32(8 * k)).astype(np.uint8)
    code = (n - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    edges = np.concatenate(([0], ends))[np.cumsum([0, *(-(-counts // 4) * 4)])]
    return control.astype(np.uint8), data, np.diff(edges)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of documents with these counts, end to end."""
    size = LENGTHS[control].ravel()
    at = np.cumsum(size, dtype=np.int64)
    at -= size
    out = data[at].astype(np.uint32)
    longer = np.flatnonzero(size > 1)
    for k in range(1, 4):
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        longer = longer[size[longer] > k + 1]
    return out[own_places(counts)]


def write_block(out, docs: list[tuple[int | None, int, bytes, bytes]]) -> None:
    """docs: (doc_id, ids, control, data)."""
    ids, counts, control, data = zip(*docs, strict=True)
    out.write(np.array([len(ids), sum(counts), sum(map(len, control)), sum(map(len, data))], "<u4").tobytes())
    out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
    out.write(np.array([i is not None for i in ids], np.uint8).tobytes())
    out.write(np.array(counts, "<u4").tobytes())
    out.write(b"".join(control))
    out.write(b"".join(data))


def read_blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each block the doc_ids, their counts, and all ranks end to end."""
    if bytes(stream.read(4)) != MAGIC:
        raise ValueError("not a token file")
    while head := bytes(stream.read(16)):
        n_docs, _, n_control, n_data = np.frombuffer(head, "<u4").tolist()
        ids = np.frombuffer(stream.read(8 * n_docs), "<i8").tolist()
        present = np.frombuffer(stream.read(n_docs), np.uint8).tolist()
        counts = np.frombuffer(stream.read(4 * n_docs), "<u4").astype(np.int64)
        control = np.frombuffer(stream.read(n_control), np.uint8)
        values = unpack(control, np.frombuffer(stream.read(n_data), np.uint8), counts)
        yield [i if p else None for i, p in zip(ids, present, strict=True)], counts, values


def tokenized(docs: DataFrame, end_id: int, path: str, name: str = "tokens") -> DataFrame:
    """``docs(doc_id, text)`` to a table ``(doc_id, ids binary)`` of little-endian ids, end_id last, two bytes each where the vocabulary allows, else four."""
    kind = id_type(path, end_id)
    end = np.array([end_id], kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, CACHE_WORDS)
        for part in parts:
            texts = part.column(1).to_pylist()
            for some in batches(texts):
                ids = [np.concatenate((x.astype(kind), end)).tobytes() for x in own.encode(texts[some])]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(some.start, len(ids)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, ids binary"), name, "zstd")


def id_type(path: str, *more: int) -> str:
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size() - 1, *more) < 1 << 16 else "<u4"


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column end to end, and how many each row has."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].view(kind)
    return flat, np.diff(edges).astype(np.int64) // np.dtype(kind).itemsize


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of bytes that lie end to end."""
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def frequency_ranks(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(rank of each id, id of each rank, number of ids) over all documents; as long as the vocabulary, which bounds it."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for part in parts:
            got = np.bincount(joined(part.column(0), kind)[0])
            if len(got) > len(n):
                n = np.concatenate((n, np.zeros(len(got) - len(n), np.int64)))
            n[: len(got)] += got
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_rank = rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank = np.zeros((by_rank.max() if len(by_rank) else -1) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    return rank, by_rank.astype(np.uint32), int(rows["n"].sum())


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order; returns the files' manifest and the id of each rank.

    The manifest has ``(shard int, file string, n_docs long, n_ids long, start long)``, start
    being the ids in all files before it.  Null doc_ids come last, rows with the same
    doc_id in the order of their ids' hash.  A null or empty text is the end id alone.
    """
    spark = docs.sparkSession
    path = path or default_path()
    kind = id_type(path, end_id)
    tokens = tokenized(docs, end_id, path)
    rank, by_rank, total = frequency_ranks(tokens, kind)
    shared = spark.sparkContext.broadcast(rank)
    n = max(1, -(-total // FILE_IDS))
    edges = tokens.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    edges = np.array(edges or [], np.int64)  # one number for each file

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for part in parts:
            for i in range(0, part.num_rows, 1000):
                some = part.slice(i, 1000)
                ids = some.column(0)
                shard = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
                shard[ids.is_null().to_numpy(zero_copy_only=False)] = len(edges)
                raw, counts = joined(some.column(1), kind)
                control, data, sizes = pack(rank[raw], counts)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array(counts), binaries(control, -(-counts // 4)), binaries(data, sizes)], ["shard", "doc_id", "n", "control", "data"])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["shard"], r["doc_id"], r["n"], r["control"], r["data"]) for part in parts for r in part.to_pylist())
        for shard, own in groupby(rows, itemgetter(0)):
            out, file = write_part(folder, shard, ".qtf")
            n_docs = n_ids = held = 0
            with out:
                out.write(MAGIC)
                block: list[tuple] = []
                for _, *doc in own:
                    block.append(tuple(doc))
                    held += doc[1]
                    n_docs, n_ids = n_docs + 1, n_ids + doc[1]
                    if held >= BLOCK_IDS:
                        write_block(out, block)
                        block, held = [], 0
                if block:
                    write_block(out, block)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "n_docs": [n_docs], "n_ids": [n_ids]})

    coded = tokens.mapInArrow(lean(code), "shard int, doc_id long, n long, control binary, data binary")
    ordered = coded.repartition(n, "shard").sortWithinPartitions("shard", F.asc_nulls_last("doc_id"), F.xxhash64("control", "data"))
    files = materialize(ordered.mapInArrow(lean(write), "shard int, file string, n_docs long, n_ids long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), by_rank


def read_token_files(manifest: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """``(doc_id long, start long, ids binary)`` from the files."""
    shared = manifest.sparkSession.sparkContext.broadcast(by_rank)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for part in parts:
            for file, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with open_part(file) as stream:
                    for doc_ids, counts, ranks in read_blocks(stream):
                        at = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at), binaries(id_of[ranks], 4 * counts)], ["doc_id", "start", "ids"])

    # the number of tasks is given, or else the few rows that name the files would be read by one
    n = manifest.count()
    return manifest.select("file", "start", "shard").repartition(max(1, n), "shard").mapInArrow(lean(read), "doc_id long, start long, ids binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, by_rank = write_token_files(table(spark, sf_dir, "documents"), fresh_dir(spark, "token-files"))
    read = read_token_files(manifest, by_rank)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
