"""WARC files with a Zstandard dictionary, and the way back.

A file begins with a skippable frame that holds the dictionary (the public layout of
dictionary-compressed WARC files: magic 0x184D2A5D, length, dictionary); each record is a
frame of its own.  The dictionary is trained on records of the file itself.

Of records with equal payloads one is a response with the payload; the others are
revisits, which keep the HTTP head (with the payload's length) and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.common import fresh_dir, lean, materialize, table
from quillbin.llm.files import open_part, write_part

DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a dictionary, and of the records it is trained on.
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 4 << 20
#: Bytes of payload after which a file is closed.
FILE_BYTES = 16 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Page(NamedTuple):
    """refers_to is None for a response."""

    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: tuple[int | None, str] | None


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def page_of(record_id: str) -> int | None:
    own = record_id.split(":")[2]
    return None if own == "none" else int(own)


def record(page: Page, serial: str) -> bytes:
    own = digest(page.payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.payload)}\r\n\r\n".encode()
    body = http + page.payload if page.refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if page.refers_to is None else 'revisit'}"]
    if page.refers_to is None:
        head.append(f"WARC-Record-ID: {record_id(page.page_id, own)}")
    else:
        head += [f"WARC-Record-ID: {record_id(page.page_id, own)[:-1]}:{serial}>", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*page.refers_to)}"]
    url = "".join(c for c in page.url or "" if c not in "\r\n")
    head += [f"WARC-Target-URI: {url}"] * bool(url) + [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{own}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on up to TRAINING_BYTES of records spread over the file; their bytes as they are where there are too few to train on."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    some = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[-DICTIONARY_BYTES:]


def write_file(out, records: list[bytes]) -> None:
    data = dictionary(records)
    out.write(np.array([DICTIONARY_FRAME, len(data)], "<u4").tobytes() + data)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
    for r in records:
        out.write(press.compress(r))


def read_file(stream) -> Iterator[bytes]:
    """The records of a file, one frame at a time."""
    magic, n = np.frombuffer(stream.read(8), "<u4").tolist()
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(stream.read(n))))
    rest, frame, held = b"", data.decompressobj(), []
    while chunk := rest or bytes(stream.read(1 << 16)):
        held.append(frame.decompress(chunk))
        rest = b""
        if frame.eof:
            yield b"".join(held)
            rest, frame, held = frame.unused_data, data.decompressobj(), []


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload."""
    head, body = raw.split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = body[: int(warc["content-length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` and returns the manifest ``(file string, n_records long)``.

    Among rows with equal payloads (null html is the empty payload) the one with the
    greatest page_id is the response, a null id being least; of repeated rows one is.
    """
    key = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)
    rows = materialize(pages.select(F.col("page_id").cast("long"), "url", "html", key.alias("key"), F.monotonically_increasing_id().alias("row")), "warc-pages", "zstd")
    best = F.max(F.struct("page_id", "row"))
    groups = rows.groupBy("key").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("key", F.col("best.page_id").alias("to"), F.col("best.row").alias("to_row"))
    # ids only are joined by payload, so copies of a payload are small rows; then each row finds its own answer
    answers = rows.select("key", "row").join(groups, "key").where("row <> to_row").select("row", "to", F.lit(True).alias("revisit"))
    rows = rows.join(answers, "row", "left").select("page_id", "url", "html", "to", "revisit")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = k = 0

        def close() -> pa.RecordBatch:
            out, file = write_part(folder, TaskContext.get().partitionId(), ".warc.zst")
            with out:
                write_file(out, held)
            return pa.RecordBatch.from_pydict({"file": [file], "n_records": pa.array([len(held)], pa.int64())})

        for part in parts:
            for r in part.to_pylist():
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                k += 1
                held.append(record(Page(r["page_id"], r["url"], payload, (r["to"], digest(payload)) if r["revisit"] else None), f"{TaskContext.get().partitionId()}-{k}"))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return materialize(rows.mapInArrow(lean(write), "file string, n_records long"), "warc-manifest")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row for each record; the payload (null unless keep_payload, and for revisits) is checked against its digest."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file in part.column(0).to_pylist():
                rows: list[tuple] = []
                with open_part(file) as stream:
                    for raw in read_file(stream):
                        warc, http, payload = parse(raw)
                        own, kind, to = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], warc.get("warc-refers-to")
                        n = int(http["content-length"])
                        if kind == "response" and (digest(payload) != own or len(payload) != n):
                            raise ValueError(f"damaged record in {file}")
                        rows.append((page_of(warc["warc-record-id"][:-1]), n, own, kind, page_of(to[:-1]) if to else None, warc.get("warc-target-uri"), payload if keep_payload and kind == "response" else None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # the number of tasks is given, or else the few rows that name the files would be read by one
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(lean(read), SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_archives(manifest).drop("url", "payload")


#: DuckDB has no base32: five bits at a time from the hex digits.
OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM p),
b AS (SELECT *, list_transform(range(0, 4), lambda k: ('0x' || hex[k * 10 + 1:k * 10 + 10])::BIGINT) AS forty FROM g)
SELECT page_id, octet_length(payload) AS payload_bytes,
  list_aggregate(flatten(list_transform(forty, lambda v: list_transform(range(0, 8), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> (35 - 5 * j)) & 31) + 1]))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""
