"""Sum-of-squares online packing of token ids into training windows.

Each task packs the documents of its partition as they come.  ``levels[h]`` counts the
open windows filled to h; a document goes into the level (or a new window) that makes the
sum of the squared counts least.  Documents of a window or more fill windows of their own
first.  At the end of the partition the open windows are emptied into each other by
cutting, and what is left is one window, cut into sequences of powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillbin.llm.common import lean, table
from quillbin.llm.tokens import batches, default_path, encoder

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Packer:
    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.next = first_sequence

    def close(self, pieces: list[Piece]) -> list[tuple]:
        """The rows of a finished sequence."""
        rows, at = [], 0
        for p in pieces:
            rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, self.next, at))
            at += len(p.ids)
        self.next += 1
        return rows

    def choose(self, size: int) -> int:
        """The level to put a piece of this size on; 0 is a new window."""
        n = self.levels
        room = self.window - size
        if not room:
            return 0
        # from level h to h + size the sum grows by 2 n[h + size] + 1 - 2 n[h] + 1; a full window is closed and adds nothing
        cost = 2 * (n[size + 1 : self.window + 1] - n[1 : room + 1]) + 2
        cost[-1] -= 1
        cost[n[1 : room + 1] == 0] = 1 << 60
        best = int(cost.argmin())
        return best + 1 if cost[best] < 2 * n[size] + 1 else 0

    def add(self, doc: Piece) -> list[tuple]:
        rows: list[tuple] = []
        while len(doc.ids) >= self.window:
            full, doc = doc.cut(self.window)
            rows += self.close([full])
        size = len(doc.ids)
        if not size:
            return rows
        level = self.choose(size)
        pieces = [doc]
        if level:
            pieces = self.open[level].pop() + pieces
            self.levels[level] -= 1
        if level + size == self.window:
            return rows + self.close(pieces)
        self.open[level + size].append(pieces)
        self.levels[level + size] += 1
        return rows

    def finish(self) -> list[tuple]:
        rows: list[tuple] = []
        left = [w for level in self.open for w in level]  # ascending fill
        fullest: list[Piece] = []
        room = 0
        while left:
            if not room:
                fullest = left.pop()
                room = self.window - sum(len(p.ids) for p in fullest)
                continue
            least = left[0]
            while least and room:
                head, tail = least[-1].cut(len(least[-1].ids) - min(room, len(least[-1].ids)))
                fullest.append(tail)
                room -= len(tail.ids)
                if len(head.ids):
                    least[-1] = head
                else:
                    least.pop()
            if not least:
                left.pop(0)
            if not room:
                rows += self.close(fullest)
                fullest = []
        if fullest:
            rows += self.powers(fullest)
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window)]
        return rows

    def powers(self, pieces: list[Piece]) -> list[tuple]:
        rows: list[tuple] = []
        total = sum(len(p.ids) for p in pieces)
        for bit in reversed(range(total.bit_length())):
            size = 1 << bit & total
            taken: list[Piece] = []
            while size:
                head, tail = pieces[0].cut(min(size, len(pieces[0].ids)))
                taken.append(head)
                size -= len(head.ids)
                pieces[0] = tail
                if not len(tail.ids):
                    pieces.pop(0)
            if taken:
                rows += self.close(taken)
        return rows


def packed(docs: DataFrame, window: int = WINDOW, end_id: int = 1, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to pieces, one row each; every id of every document lies in exactly one.

    A null or empty text is the end id alone.  Null doc_ids are packed and returned as null;
    repeated rows are packed as often as they occur.  sequence_id holds the partition in its
    upper bits, so no two tasks share one.
    """
    path = path or default_path()
    end = np.array([end_id], np.uint32)
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 36)
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        for part in parts:
            doc_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for some in batches(texts):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[some], own.encode(texts[some]), strict=True):
                    ids = np.concatenate((ids, end))
                    rows += packer.add(Piece(doc_id, 0, ids, len(ids)))
                if rows:
                    yield make(rows)
        if rows := packer.finish():
            yield make(rows)

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that came through; see ``packed``.

    Only doc_id and text are read, so other columns may have any names; an empty table has no pieces.
    """
    return packed(docs)
