"""FASTA and FASTA-shaped depth files whose records are larger than a row or a task.

A file is read in parts of bytes, each by its own task, and comes out as pieces of records of
bounded length.  A head line or a number belongs to the part where it begins, which reads on to its
end; the next part passes over it.  Files are opened in tasks, by ``pyarrow.fs`` where the path has
a scheme, so all machines must reach them by their path.
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillbin.functions.sequences import cleaned
from quillbin.operators.shared import shared_folder

#: Bytes that one task reads, and those of a piece.
PART_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
#: A head line, or a number, has to end within so many bytes.
HEAD_BYTES = 64 << 10
BLANK = b" \t\r\n"


@contextlib.contextmanager
def opened(path: str) -> Iterator:
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            yield f
    else:
        with open(path.removeprefix("file:"), "rb") as f:
            yield f


def size_of(path: str) -> int:
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        info = system.get_file_info(at)
        if info.size is None:
            raise FileNotFoundError(path)
        return info.size
    return os.path.getsize(path.removeprefix("file:"))


@dataclass
class Part(InputPartition):
    path: str
    part: int
    start: int
    end: int


def first_of(data: bytes, signs: bytes) -> int:
    """The place of the first of some signs, -1 where there is none."""
    return min((i for i in (data.find(bytes([s])) for s in signs) if i >= 0), default=-1)


def bounds(before: bytes, data: bytes, after: bytes, numbers: bool) -> tuple[int, bytes]:
    """How much of a part belongs to the part before it, and the part with what it reads on."""
    whole = before + data
    skip = 0
    if before.rfind(b">") > before.rfind(b"\n"):  # in a head line
        skip = data.find(b"\n") + 1 or len(data)
    elif numbers and before and before[-1:] not in BLANK:
        skip = first_of(data, BLANK + b">")
        skip = len(data) if skip < 0 else skip
    if skip == len(data) or not after:
        return skip, data
    more = 0
    if whole.rfind(b">") > whole.rfind(b"\n"):
        more = after.find(b"\n") + 1
        if not more and len(after) == HEAD_BYTES:
            raise ValueError(f"a head line of more than {HEAD_BYTES} bytes")
        more = more or len(after)
    elif numbers and data[-1:] not in BLANK:
        more = first_of(after, BLANK + b">")
        if more < 0 and len(after) == HEAD_BYTES:
            raise ValueError(f"a number of more than {HEAD_BYTES} bytes")
        more = len(after) if more < 0 else more
    return skip, data + after[:more]


def cuts(body: bytes, piece_bytes: int, numbers: bool) -> Iterator[tuple[int, bytes]]:
    """Pieces of a body with their places; numbers stay whole."""
    at = 0
    while at < len(body):
        end = min(at + piece_bytes, len(body))
        if numbers and end < len(body):
            end = max(body.rfind(bytes([b]), at, end) for b in BLANK) + 1
            if end <= at:
                raise ValueError(f"a number of more than {piece_bytes} bytes")
        yield at, body[at:end]
        at = end


class StretchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        self.numbers = options["numbers"] == "true"
        self.part_bytes, self.piece_bytes = int(options["part_bytes"]), int(options["piece_bytes"])

    def partitions(self) -> Sequence[InputPartition]:
        sizes = [(p, size_of(p)) for p in self.paths]
        return [Part(p, i, s, min(s + self.part_bytes, n)) for p, n in sizes for i, s in enumerate(range(0, n, self.part_bytes))] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.start == part.end:
            return
        with opened(part.path) as f:
            lead = min(part.start, HEAD_BYTES)
            f.seek(part.start - lead)
            before, data, after = f.read(lead), f.read(part.end - part.start), f.read(HEAD_BYTES)
        skip, data = bounds(before, data, after, self.numbers)
        at, record, name = skip, None, None  # what goes on from an earlier part has no record yet
        while at < len(data):
            if data[at : at + 1] == b">":
                record = part.start + at
                line = data.find(b"\n", at)
                sign = data.find(b">", at + 1)
                stop = min(x for x in (line + 1, sign, len(data)) if x > 0)
                words = data[at + 1 : stop].decode("utf-8", "replace")
                name = words.split()[0] if words.strip() and not words[0].isspace() else ""
                yield part.path, part.part, record, record, name, ""
                at = stop
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            for i, piece in cuts(data[at:end], self.piece_bytes, self.numbers):
                yield part.path, part.part, part.start + at + i, record, name, piece.decode("utf-8", "replace")
            at = end


class Stretches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stretches"

    def schema(self) -> str:
        return "file string, part int, at long, record long, id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return StretchReader(dict(self.options))


def stretches(spark: SparkSession, paths: str | Sequence[str], numbers: bool = False, part_bytes: int = PART_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(file, part, at, record, id, text)``: pieces of records in files, in the order of at.

    record is the place of a record's ``>``, and each record has a piece without text there.
    Records without an id, and what stands before the first one, are left out.  An id that a
    file has twice has two records.
    """
    shared_folder(spark)
    spark.dataSource.register(Stretches)
    listed = [paths] if isinstance(paths, str) else [*paths]
    rows = spark.read.format("stretches").option("paths", json.dumps(listed)).option("numbers", str(numbers).lower()).option("part_bytes", part_bytes).option("piece_bytes", piece_bytes).load().checkpoint()
    # a part goes on with the last record that begins before it: one row for each part
    parts = rows.groupBy("file", "part").agg(F.max(F.when(F.col("record").isNotNull(), F.struct("record", "id"))).alias("last"))
    went_on = F.max("last").over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("file", "part", went_on.alias("last"))
    filled = rows.join(parts, ["file", "part"]).select("file", "part", "at", F.coalesce("record", "last.record").alias("record"), F.coalesce("id", "last.id").alias("id"), "text")
    return filled.where("id <> ''")


def placed(rows: DataFrame, size: Column) -> DataFrame:
    """Adds ``position``: 1 more than the sizes of a record's earlier pieces; summed by part first, so that no task gathers a record."""
    k = next(c for c in ("size", "size_", "size__") if c not in rows.columns)
    sized = rows.withColumn(k, size.cast("long"))
    by_part = sized.groupBy("file", "record", "part").agg(F.sum(k).alias("k"))
    earlier = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("file", "record", "part", earlier(W.partitionBy("file", "record").orderBy("part")).alias("parts_before"))
    own = F.coalesce(F.sum(k).over(W.partitionBy("file", "record", "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = sized.withColumn("own", own).join(by_part, ["file", "record", "part"])
    return out.select(*[F.col(c) for c in rows.columns], (F.col("parts_before") + F.col("own") + 1).alias("position"))


def letters(spark: SparkSession, paths: str | Sequence[str], **sizes: int) -> DataFrame:
    """``(file, record, id, position long, seq)``: pieces of the letters A, T, G and C of FASTA records; position: of the first letter, from 1."""
    rows = stretches(spark, paths, **sizes).withColumn("seq", cleaned(F.col("text"))).drop("text")
    return placed(rows, F.length("seq")).select("file", "record", "id", "position", "seq")


def depths(spark: SparkSession, paths: str | Sequence[str], **sizes: int) -> DataFrame:
    """``(file, record, id, position long, depths array<double>)``: pieces of the numbers of depth records."""
    numbers = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = stretches(spark, paths, numbers=True, **sizes).withColumn("depths", numbers).drop("text")
    return placed(rows, F.size("depths")).select("file", "record", "id", "position", "depths")


def blocks(rows: DataFrame, by: Sequence[str], column: str, size: int, overlap: int = 0) -> DataFrame:
    """``rows(by..., position, column)``, text or arrays, to ``(by..., block, column)``: block b has the places from b * size + 1 on, and ``overlap`` more of the next.

    overlap is at most size; empty pieces give nothing.  A group is one block, however long a record is.
    """
    text = rows.schema[column].dataType.typeName() == "string"
    n = F.length(column) if text else F.size(column)
    start, end = F.col("position") - 1, F.col("position") - 1 + n
    first = F.greatest(F.floor((start - overlap) / size), F.lit(0))
    each = rows.where(n > 0).select(*by, "position", column, F.explode(F.sequence(first, F.floor((end - 1) / size))).alias("block"))
    low, high = F.greatest(start, F.col("block") * size), F.least(end, (F.col("block") + 1) * size + overlap)
    cut = F.substring if text else F.slice
    each = each.where(low < high).select(*by, "block", F.struct(low.alias("low"), cut(F.col(column), (low - start + 1).cast("int"), (high - low).cast("int")).alias("x")).alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["x"])
    return each.groupBy(*by, "block").agg((F.array_join(pieces, "") if text else F.flatten(pieces)).alias(column))
