"""Removal of long byte strings that start earlier in the corpus, by families of suffix arrays.

1. Texts are written once to part files (``text_parts``).
2. Each part is cut into runs of starts that share a content-defined anchor (``anchors``).
   Equal strings have equal anchors, so anchors deal the corpus out into shards that need
   not know of each other, and a run whose anchor is nowhere else holds no repeat.  Each
   part sends its distinct anchors, and learns which of them are in other runs as well.
3. A part's runs of such anchors are the batches of a family of suffix arrays
   (``suffix_arrays``), which finds the strings that start earlier in the part; what is
   left goes on, bytes and all.
4. The parts' runs of an anchor meet in one task and are, in corpus order, the batches of
   another family.  Runs of a frequent anchor are cut to single strings and dealt out by
   those; strings of an anchor that is more frequent still meet in groups of parts first,
   and only the first of each group goes on.
5. The spans found are sent back to their part, joined up and removed.

Every match is one of bytes in a suffix array; hashes only say which bytes are compared.
The corpus order is that of doc_id (nulls last), then of part and row for repeated ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillbin.llm.anchors import mixed, rolling, runs
from quillbin.llm.common import discard, lean, materialize, quoted, table
from quillbin.llm.suffix_arrays import repeated
from quillbin.llm.text_parts import Texts, write_texts

LENGTH = 100
#: About so many suffixes are compared in one task.
TASK_SUFFIXES = 400_000
#: Runs of one anchor beyond which they are dealt out as single strings, and in groups of so many.
HOT = 4096
LAST = np.int64(2**63 - 1)


def spans(part: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans of one part or many, those that touch or overlap in one row joined up."""
    order = np.lexsort((start, row, part))
    part, row, start, end = part[order], row[order], start[order], end[order]
    if not len(part):
        return pd.DataFrame({"part": part, "row": row, "start": start, "end": end})
    same = np.concatenate(([False], (part[1:] == part[:-1]) & (row[1:] == row[:-1])))
    group = np.cumsum(~same) - 1
    reach = np.maximum.accumulate(end + group * (1 << 32)) - group * (1 << 32)
    head = np.flatnonzero(~same | (start > np.concatenate(([0], reach[:-1]))))
    tail = np.append(head[1:], len(part)) - 1
    return pd.DataFrame({"part": part[head], "row": row[head].astype(np.int32), "start": start[head].astype(np.int32), "end": reach[tail].astype(np.int32)})


def order_ids(texts: Texts) -> np.ndarray:
    return np.array([LAST if i is None else i for i in texts.doc_ids], np.int64)


def runs_of(texts: Texts, length: int) -> pd.DataFrame:
    ids, found = order_ids(texts), []
    for row in range(len(texts)):
        r = runs(texts[row], length)
        if len(r.start):
            found.append((r.anchor.view(np.int64), np.full(len(r.start), ids[row]), np.full(len(r.start), row), r.start, r.count))
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
    return pd.DataFrame(dict(zip(("anchor", "id", "row", "start", "count"), cols, strict=True)))


def anchors_of(parts: DataFrame, length: int) -> DataFrame:
    """``(anchor, part, n)``: the distinct anchors of each part, and how many of its runs have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, file in zip(batch["part"], batch["file"], strict=True):
                texts = Texts(file)
                own = [runs(texts[row], length).anchor for row in range(len(texts))]
                anchor, n = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "part": part, "n": n})

    return parts.select("part", "file").mapInPandas(lean(run), "anchor long, part long, n long")


def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's anchors those of two runs or more, with their number of runs in all parts."""
    held = [b for b in batches if len(b)]
    if held:
        p = pd.concat(held)
        _, group = np.unique(p["anchor"].to_numpy(), return_inverse=True)
        n = np.bincount(group, p["n"]).astype(np.int64)[group]
        yield p[n > 1].assign(n=n[n > 1])[["part", "anchor", "n"]]


def stretches(run: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the longest stretches with one run and one flag."""
    if not len(run):
        return run, run
    first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (flag[1:] != flag[:-1]))))
    return first, np.diff(np.append(first, len(run)))


PIECE = "shard long, salt long, id long, part long, row int, start int, count int, bytes binary"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


def found_rows(s: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans as rows without bytes; count is the number of starts."""
    return s.assign(shard=0, salt=0, id=0, count=s["end"] - s["start"] - length + 1, bytes=None)[COLUMNS]


def compared(p: pd.DataFrame, texts: list[bytes], length: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Runs ``(part, row, start, count, ...)`` in corpus order with their bytes, batch by batch: the spans that a family of suffix arrays has had before, and the stretches that are new, with ``run`` and ``at`` for their place in texts.

    Of runs with the same bytes only the first is compared, as all starts of the others are repeats.
    """
    part, row, start, count = (p[c].to_numpy(np.int64) for c in ("part", "row", "start", "count"))
    again = pd.Series(texts, dtype=object).duplicated().to_numpy(bool)
    if again.any():
        yield spans(*(x[again] for x in (part, row, start)), (start + count)[again] + length - 1), pd.DataFrame(dict.fromkeys(("run", "at", "count", "part", "row", "start"), np.zeros(0, np.int64)))
    kept = np.flatnonzero(~again)
    part, row, start, count = (x[kept] for x in (part, row, start, count))
    texts = [texts[k] for k in kept.tolist()]
    for i, j, seen in repeated(texts, count, length):
        n = count[i:j]
        run = np.repeat(np.arange(i, j), n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        first, size = stretches(run, seen)
        own = pd.DataFrame({"run": run[first], "at": at[first], "count": size, "part": part[run[first]], "row": row[run[first]], "start": start[run[first]] + at[first]})
        old = own[seen[first]]
        yield spans(*(old[c].to_numpy() for c in ("part", "row", "start")), (old["start"] + old["count"] + length - 1).to_numpy()), own[~seen[first]].assign(run=lambda x: kept[x["run"]])


def cut_pieces(known: DataFrame, parts: DataFrame, length: int, hot: int) -> DataFrame:
    """Of each part the runs whose anchor is in ``known(part, anchor, n)``: spans that start earlier in the part, and the others with their bytes."""

    def pieces(part: int, texts: Texts, anchor: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        p = runs_of(texts, length)
        order = np.argsort(anchor)
        anchor, n = anchor[order], n[order]
        k = np.searchsorted(anchor, p["anchor"].to_numpy())
        k[k == len(anchor)] = 0
        mine = anchor[k] == p["anchor"].to_numpy()
        p = p[mine].assign(part=part, n=n[k[mine]])
        p = p.iloc[np.lexsort((p["start"], p["row"], p["id"]))].reset_index(drop=True)
        # only an anchor of several runs of this part can have a string twice in it
        _, group, own = np.unique(p["anchor"].to_numpy(), return_inverse=True, return_counts=True)
        several = own[group] > 1
        alone, p = p[~several], p[several]
        whole = lambda q: [texts[r][s : s + c + length - 1].tobytes() for r, s, c in zip(q["row"].tolist(), q["start"].tolist(), q["count"].tolist(), strict=True)]
        new = [alone]
        for old, left in compared(p, whole(p), length):
            yield found_rows(old, length)
            new.append(left.assign(**{c: p[c].to_numpy()[left["run"]] for c in ("anchor", "id", "n")}))
        p = pd.concat(new, ignore_index=True)
        p = p.assign(shard=p["anchor"], salt=0)
        cold = p[p["n"] <= hot]
        for i in range(0, len(cold), 20_000):
            some = cold.iloc[i : i + 20_000]
            yield some.assign(bytes=whole(some))[COLUMNS]
        for _, q in p[p["n"] > hot].groupby("row"):
            yield strings(q, texts)

    def strings(q: pd.DataFrame, texts: Texts) -> pd.DataFrame:
        """Single strings of runs of frequent anchors in one row of a part, dealt out by what they are."""
        count = q["count"].to_numpy(np.int64)
        start = np.repeat(q["start"].to_numpy(np.int64) - (np.cumsum(count) - count), count) + np.arange(count.sum())
        text = texts[int(q["row"].iloc[0])]
        raw = text.tobytes()
        key = mixed(rolling(text, length)).view(np.int64)[start]
        q = q.iloc[np.repeat(np.arange(len(q)), count)]
        salt = np.where(q["n"] > hot * 16, q["part"] % (q["n"] // hot) + 1, 0)
        return q.assign(shard=key, salt=salt, start=start, count=1, bytes=[raw[s : s + length] for s in start.tolist()])[COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for part, own in pd.concat(held).groupby("part", sort=False) if held else ():
            known = own[own["file"].isna()]
            if len(known):
                yield from pieces(part, Texts(own["file"].dropna().iloc[0]), known["anchor"].to_numpy(), known["n"].to_numpy())

    rows = known.select("part", "anchor", "n", F.lit(None).cast("string").alias("file")).unionByName(parts.select("part", F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("n"), "file"))
    return rows.repartition(max(1, parts.count()), "part").mapInPandas(lean(run), PIECE)


def match(batches: Iterator[pd.DataFrame], length: int, keep: bool) -> Iterator[pd.DataFrame]:
    """The spans of a task's pieces that start earlier in one of them; with keep, the first ones too, as pieces for the next meeting."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    p = pd.concat(held).sort_values(["id", "part", "row", "start"])
    texts = p["bytes"].tolist()
    for old, new in compared(p, texts, length):
        yield found_rows(old, length)
        if keep and len(new):
            run, at, n = (new[c].tolist() for c in ("run", "at", "count"))
            cut = [texts[r][a : a + c + length - 1] for r, a, c in zip(run, at, n, strict=True)]
            yield new.assign(salt=0, bytes=cut, **{c: p[c].to_numpy()[run] for c in ("shard", "id")})[COLUMNS]


def removed_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(manifest, spans)``: the part files of ``docs(doc_id, text)`` and the bytes to remove from them, maybe overlapping.

    What is dealt out by a key comes from a table or a map, never from a join on that key:
    Spark leaves out a repartition that such a join makes needless, and may then read the
    join's output in another way than by the key.
    """
    parts = write_texts(docs, "texts")
    n = parts.agg(F.count("*")).first()[0]  # one number
    anchors = anchors_of(parts.repartition(max(1, n), "part"), length)
    known = materialize(anchors.repartition(max(1, n), "anchor").mapInPandas(lean(shared), "part long, anchor long, n long"), "shared-anchors")
    pieces = materialize(cut_pieces(known, parts, length, hot), "pieces", "zstd")
    discard(known)
    meet = lambda rows, keep, *by: rows.repartition(tasks_for(rows), *by).mapInPandas(lean(lambda b: match(b, length, keep)), PIECE)
    done, rows = pieces.where("bytes is null"), pieces.where("bytes is not null")
    salted = rows.where("salt > 0")
    if not salted.isEmpty():
        once = materialize(meet(salted, True, "shard", "salt"), "pieces-once", "zstd")
        done = done.unionByName(once.where("bytes is null"))
        rows = rows.where("salt = 0").unionByName(once.where("bytes is not null"))
    done = done.unionByName(meet(rows, False, "shard"))
    return parts, done.select("part", "row", "start", (F.col("start") + F.col("count") + length - 1).alias("end"))


def tasks_for(rows: DataFrame) -> int:
    """Small rows stand for many suffixes, so the number of tasks is given by those."""
    return max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // TASK_SUFFIXES))


def kept_rows(docs: DataFrame, length: int, make: Callable[[Texts, list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], schema: StructType | str, **limits: int) -> DataFrame:
    """make(part, kept pieces' edges of each row, removed spans of each row) gives the part's rows of the result."""
    parts, cut = removed_spans(docs, length, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(b) if (b := [*batches]) else None
        if held is None or not len(held):
            return
        p = held.to_pandas()
        files = p[p["file"].notna()]
        p = p[p["file"].isna()]
        s = spans(*(p[c].to_numpy(np.int64) for c in ("part", "row", "start", "end")))
        for part, file in zip(files["part"].tolist(), files["file"].tolist(), strict=True):
            texts = Texts(file)
            own = s[s["part"] == part]
            at = np.searchsorted(own["row"].to_numpy(), np.arange(len(texts) + 1))
            cuts = own[["start", "end"]].to_numpy(np.int64)
            edges = [np.concatenate(([0], cuts[a:b].ravel(), [len(texts[k])])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            yield from make(texts, edges, np.diff(at))

    nothing = F.lit(None).cast("int")
    rows = parts.select("part", "file", nothing.alias("row"), nothing.alias("start"), nothing.alias("end")).unionByName(cut.select("part", F.lit(None).cast("string").alias("file"), "row", "start", "end"))
    return rows.repartition(max(1, parts.count()), "part").mapInArrow(lean(run), schema)


def kept_bytes(texts: Texts, row: int, edges: np.ndarray) -> bytes:
    text = texts[row]
    return b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def per_document(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row for each of docs.

    Null and empty texts have zero bytes and lose none.  Repeated rows are rows of the
    corpus like any other: all but the first lose what they share.  Nulls in doc_id come
    last in the corpus order.
    """

    def make(texts: Texts, edges: list[np.ndarray], n_spans: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = [kept_bytes(texts, k, e) for k, e in enumerate(edges)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(texts.doc_ids, pa.int64()),
                "n_bytes": pa.array([int(e[-1]) for e in edges], pa.int64()),
                "n_removed": pa.array([int(e[-1]) - len(b) for e, b in zip(edges, kept, strict=True)], pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": [hashlib.sha256(b).hexdigest() for b in kept],
            }
        )

    return kept_rows(docs.select("doc_id", "text"), length, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **limits)


def without_repeats(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """``docs`` with texts less what ``per_document`` counts as removed; all rows and columns stay.

    What is left of a character that was cut is dropped; n_chars, where there is such a
    column, is counted anew.  Null texts stay null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("gone"))

    def make(texts: Texts, edges: list[np.ndarray], n_spans: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(edges), 256):
            some = texts.table.slice(i, 256).combine_chunks()
            kept = [kept_bytes(texts, i + k, e).decode("utf-8", "ignore") for k, e in enumerate(edges[i : i + 256])]
            columns = [c.combine_chunks() for c in some.columns]
            gone = columns[-1].to_pylist()
            columns[1] = pa.array([None if g else t for g, t in zip(gone, kept, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], some.schema.names[:-1])

    types = own.drop("gone").withColumn("doc_id", F.col("doc_id").cast("long")).schema  # as the parts have it
    out = kept_rows(own, length, make, types, **limits).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without the passages that stand earlier."""
    return without_repeats(docs)
