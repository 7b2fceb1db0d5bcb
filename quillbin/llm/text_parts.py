"""Whole texts as byte strings in part files of the shared folder, addressed by part and row.

Later steps send small rows to the task that reads a part, so the texts themselves are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbin.llm.common import fresh_dir, lean, materialize
from quillbin.llm.files import open_part, write_part

#: Bytes of text after which a part is closed.
PART_BYTES = 8 << 20


def write_texts(docs: DataFrame, name: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes ``docs``, whose first columns are doc_id and text, and returns the manifest ``(part long, file string, n_docs long)``, written as well.

    Further columns go along unchanged, whatever their names.
    """
    folder = fresh_dir(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, k = 0, 0

        def flush() -> pa.RecordBatch:
            part = TaskContext.get().partitionId() << 24 | k
            out, file = write_part(folder, part, ".arrow")
            table = pa.Table.from_batches(held).combine_chunks()
            with out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(table)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [file], "n_docs": pa.array([len(table)], pa.int64())})

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                text = some.column(1).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
                held.append(pa.RecordBatch.from_arrays([some.column(0), text, *some.columns[2:]], some.schema.names))
                size += pc.sum(pc.binary_length(text)).as_py() or 0
                if size >= part_bytes:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()

    return materialize(docs.withColumn(docs.columns[0], F.col(docs.columns[0]).cast("long")).mapInArrow(lean(run), "part long, file string, n_docs long"), f"{name}-manifest")


class Texts:
    """A part: doc_ids (None where null), the bytes of each row, and the further columns."""

    def __init__(self, file: str):
        with open_part(file) as stream:
            table = pa.ipc.open_stream(stream).read_all().combine_chunks()
        self.table = table
        self.doc_ids = table.column(0).to_pylist()
        chunk = table.column(1).chunk(0) if table.num_rows else pa.array([], pa.large_binary())
        self.offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        self.data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.data[self.offsets[row] : self.offsets[row + 1]]
