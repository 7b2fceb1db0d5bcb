"""SimHash near-duplicates by BK-trees.

Fingerprints of 4-word shingles are deduplicated, sharded by exact agreement on three of
``radius + 3`` groups of bits (two fingerprints within ``radius`` bits agree on at least
three), and each shard becomes one or more BK-trees: a node's children are keyed by their
integer Hamming distance to it.  Every tree is sent to all query blocks of its shard, and
a query follows only edges whose key lies within the radius of its own distance.  Each
task returns a spanning forest of the links it found, not all pairs; components are then
joined up by contraction rounds.
"""

from __future__ import annotations

import itertools
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.common import checkpoint, components, discard, fresh_dir, give_back, lean, materialize, quoted, table
from quillbin.llm.files import open_places, remove, write_at
from quillbin.llm.text_parts import Texts, write_texts

SHINGLE_WORDS = 4
SEED = 42
#: Most fingerprints in one BK-tree, and most queries in one block.
BLOCK = 4096
#: Rows of cells that a task holds at a time.
TASK_ROWS = 1 << 17
#: Groups of bits that fingerprints of a shard agree on, 27 bits of seven groups at radius 4.
AGREE = 3
#: 64-bit words of a long fingerprint that decide whether two texts are compared.
PARTS = 2
#: Bits of a band of a long fingerprint.
BAND_BITS = 16
#: Bytes of shingle hashes, and open files, that a task keeps for comparisons.
HELD, OPEN = 64 << 20, 64

#: The bits of each byte, and the same as the bytes of a word.
BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SPREAD = BIT_OF.astype(np.uint8).view(np.uint64).ravel()


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; none for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    joined = b" ".join(w)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[: n - words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Of each column of hashes the bits that are set in over half of them."""
    n, parts = h.shape
    own = np.ascontiguousarray(h).view(np.uint8)
    if n < 1000:
        set_in = np.zeros(64 * parts, np.int64)
        for i in range(0, n, 255):  # eight counters of a byte in each word
            set_in += np.add.reduce(SPREAD.take(own[i : i + 255]), axis=0).view(np.uint8)
    else:  # how often each byte has each value says how often each bit is set
        set_in = np.concatenate([np.bincount(own[:, k], minlength=256) @ BIT_OF for k in range(8 * parts)])
    return np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; 0 for a text without words."""
    return int(majority(shingle_hashes(text, words)[:, None])[0])


def long_fingerprint(text: str | None, words: int, parts: int) -> np.ndarray:
    """So many 64-bit SimHashes of the distinct shingles, from their hashes mixed anew."""
    h = np.unique(shingle_hashes(text, words))
    each = np.empty((len(h), parts), np.uint64)
    for i in range(parts):
        each[:, i] = h
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        h ^= h >> np.uint64(29)
    return majority(each)


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "simhash", words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))
        give_back()

    return docs.withColumn(to, of(F.col(text)))


class BKTrees:
    """BK-trees of many shards at once, as flat arrays: parent of each node and distance to it."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard must be sorted; values are uint64."""
        n = len(value)
        self.value = value
        self.roots, first, count = np.unique(shard, return_index=True, return_counts=True)
        self.root_at = first
        parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        at = np.repeat(first, count)
        wait = np.setdiff1d(np.arange(n), first)
        at = at[wait]
        while len(wait):
            d = np.bitwise_count(value[wait] ^ value[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            wait, at, d, key = wait[order], at[order], d[order], key[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            parent[wait[head]], edge[wait[head]] = at[head], d[head]
            child = wait[head][np.cumsum(head) - 1]
            wait, at = wait[~head], child[~head]
        own = np.flatnonzero(parent >= 0)
        key = parent[own] * 65 + edge[own]
        order = np.argsort(key)
        self.child_key, self.child = key[order], own[order]

    def within(self, shard: np.ndarray, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node index) pairs at most radius apart, level by level."""
        k = np.searchsorted(self.roots, shard)
        k[k == len(self.roots)] = 0
        query = np.flatnonzero(self.roots[k] == shard) if len(self.roots) else np.array([], np.int64)
        node = self.root_at[k[query]] if len(query) else query
        while len(query):
            d = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.child_key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.child_key, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            query = np.repeat(query, n)
            node = self.child[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(query))] if len(query) else query


def forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray) -> np.ndarray:
    """label[i]: least index joined to i after the links (a, b) are added to the classes in label."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def confirmed(a: np.ndarray, b: np.ndarray, label: np.ndarray, same: Callable[[int, int], bool]) -> list[int]:
    """Which of the pairs (a, b) are the same and join two classes of label that no earlier one joined."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    keep = []
    la, lb = label[a], label[b]
    for k in np.flatnonzero(la != lb).tolist():
        x, y = top(int(la[k])), top(int(lb[k]))
        if x != y and same(a[k], b[k]):
            root[x] = y
            keep.append(k)
    return keep


def tree_links(shard: np.ndarray, is_query: np.ndarray, is_node: np.ndarray, value: np.ndarray, node_id: np.ndarray, radius: int, step: int = 1 << 12, more: np.ndarray | None = None, most: int = 0, same: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs (query, tree node) of the same shard within radius.

    If more (a row of further 64-bit words for each value) is given, a pair found also has to
    differ in ``most`` bits of those at most, and to be the ``same`` by its two indices if that is given.
    """
    order = np.lexsort((node_id, shard))
    shard, is_query, is_node, value, node_id = (x[order] for x in (shard, is_query, is_node, value, node_id))
    more = None if more is None else more[order]
    nodes = np.flatnonzero(is_node)
    trees = BKTrees(shard[nodes], value[nodes])
    label = np.arange(len(value))
    queries = np.flatnonzero(is_query)
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        for found, node in trees.within(shard[q], value[q], radius):
            if more is not None:
                near = np.bitwise_count(more[q[found]] ^ more[nodes[node]]).sum(axis=1, dtype=np.int64) <= most
                found, node = found[near], node[near]
            if same is not None:
                keep = confirmed(q[found], nodes[node], label, lambda i, j: same(order[i], order[j]))
                found, node = found[keep], node[keep]
            label = forest(q[found], nodes[node], len(value), label)
    # a tree of small degree over each class, so that no node gets a long list of links
    by_class = np.lexsort((np.arange(len(label)), label))
    lab = label[by_class]
    start = np.flatnonzero(np.concatenate(([True], lab[1:] != lab[:-1])))
    rank = np.arange(len(lab)) - np.repeat(start, np.diff(np.append(start, len(lab))))
    up = np.arange(len(lab)) - rank + (rank - 1) // 8
    keep = rank > 0
    return node_id[by_class[up[keep]]], node_id[by_class[keep]]


def links(points: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``points(simhash long, id long)``, distinct in simhash, to links ``(a, b)`` that join all within radius.

    The bits make ``radius + AGREE`` groups; fingerprints within radius agree on ``AGREE`` of
    them at least, so there is a shard for each choice of so many groups and their bits.
    """
    groups = radius + AGREE
    edges = [round(i * 64 / groups) for i in range(groups + 1)]
    group = [F.shiftrightunsigned("simhash", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    shard = F.array(*[F.xxhash64(F.lit(i), *[group[k] for k in some]) for i, some in enumerate(itertools.combinations(range(groups), AGREE))])
    rows = points.select("simhash", "id", F.explode(shard).alias("shard"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            p = pd.concat(held)
            a, b = tree_links(p["cell"].to_numpy(), p["query"].to_numpy(), p["node"].to_numpy(), p["simhash"].to_numpy().view(np.uint64), p["id"].to_numpy(), radius)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt(rows, points.count() * math.comb(groups, AGREE), block).mapInPandas(lean(run), "a long, b long")


def dealt(rows: DataFrame, n_rows: int, block: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows(..., id, shard)``, ``n_rows`` of them, to cells of at most two blocks of a shard: ``(..., id, cell, node, query)``.

    A block's tree is sent to each block of queries of its shard: block i is dealt to the
    pairs (i, j) and (j, i).  There are as many tasks as ``task_rows`` rows each need.
    """
    own = [c for c in rows.columns if c != "shard"]
    large = checkpoint(rows.groupBy("shard").count().where(F.col("count") > block).withColumn("n", F.ceil(F.col("count") / block).cast("int")))
    more = large.agg(F.sum(F.col("count") * (F.col("n") - 1))).first()[0] or 0
    tasks, blocks = max(1, -(-(n_rows + more) // task_rows)), large.select("shard", "n")
    rows = rows.join(blocks, "shard", "left").withColumn("i", F.coalesce(F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.lit(0)))
    each = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("i", j).alias("tree"), F.greatest("i", j).alias("query")))).otherwise(F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("query"))))
    rows = rows.select(*own, "shard", "i", F.explode(each).alias("p"))
    return rows.select(*own, F.xxhash64("shard", "p.tree", "p.query").alias("cell"), (F.col("i") == F.col("p.tree")).alias("node"), (F.col("i") == F.col("p.query")).alias("query")).repartition(tasks, F.col("cell"))


class Plan(NamedTuple):
    """Bands of ``bits`` bits of a fingerprint of ``parts`` words; pairs may differ in ``radius`` bits of the first word and in ``most`` of the next ones up to PARTS."""

    bits: int
    bands: int
    parts: int
    radius: int
    most: int


def plan(similarity: float, recall: float = 0.98, bits: int = BAND_BITS) -> Plan:
    """For a Jaccard similarity of the shingles, alike for corpora of every size.

    The cosine of two such sets of a size is 2 s / (1 + s), and a bit differs with the angle's
    part of a half turn.  There are as many bands as find ``recall`` of pairs at exactly that
    similarity; the limits lie three deviations above the mean.
    """
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bands = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differs) ** bits))
    parts = max(PARTS, -(-bands // (64 // bits)))
    limit = lambda size: math.floor(size * differs + 3 * math.sqrt(size * differs * (1 - differs)))
    return Plan(bits, bands, parts, limit(64), limit(64 * (PARTS - 1)))


#: A text's place: the number of the task attempt that wrote its file, and its first byte there.
START_BITS = 36


def texts_file(folder: str, attempt: int) -> str:
    return f"{folder}/{attempt:x}.texts"


class Shingles:
    """Distinct shingle hashes of texts by their place in files; the last ones used are held.

    A file has for each text its compressed and whole size, four bytes each, and the compressed text.
    """

    def __init__(self, folder: str, place: np.ndarray, words: int, similarity: float):
        self.folder, self.place, self.words, self.similarity = folder, place, words, similarity
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.files: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.bytes = 0
        self.codec = pa.Codec("zstd")

    def file(self, attempt: int) -> pa.NativeFile:
        if attempt not in self.files:
            if len(self.files) >= OPEN:
                self.files.popitem(last=False)[1].close()
            self.files[attempt] = open_places(texts_file(self.folder, attempt))
        self.files.move_to_end(attempt)
        return self.files[attempt]

    def of(self, i: int) -> np.ndarray:
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        attempt, start = divmod(int(self.place[i]), 1 << START_BITS)
        file = self.file(attempt)
        size, raw = np.frombuffer(file.read_at(8, start), "<u4").tolist()
        text = self.codec.decompress(file.read_at(size, start + 8), raw, asbytes=True) if raw else b""
        h = self.held[i] = np.unique(shingle_hashes(text.decode("utf-8", "surrogatepass"), self.words))
        self.bytes += h.nbytes
        while self.bytes > HELD and len(self.held) > 2:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return h

    def same(self, i: int, j: int) -> bool:
        """Whether the Jaccard similarity of two texts' shingles is high enough."""
        x, y = self.of(i), self.of(j)
        if min(len(x), len(y)) < self.similarity * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.similarity * (len(x) + len(y) - both)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def similar_links(points: DataFrame, own: Plan, folder: str, words: int, similarity: float, block: int = BLOCK // 2) -> DataFrame:
    """``points(prints binary, id, place)``, distinct in prints, to links ``(a, b)`` that join all similar ones.

    Fingerprints only choose the pairs; what links is the Jaccard similarity of the shingles
    of the two texts, which are read from their places in files.
    """
    near = [f"w{k}" for k in range(PARTS)]

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per = 64 // own.bits
        for p in parts:
            prints = np.frombuffer(b"".join(p["prints"]), np.uint64).reshape(-1, own.parts)
            band = np.stack([(prints[:, i // per] >> np.uint64(i % per * own.bits)) & np.uint64((1 << own.bits) - 1) for i in range(own.bands)], axis=1)
            shard = band * np.uint64(1024) + np.arange(own.bands, dtype=np.uint64)
            yield pd.DataFrame({**{c: np.repeat(p[c].to_numpy(), own.bands) for c in ("id", "place")}, **{c: np.repeat(prints[:, k].view(np.int64), own.bands) for k, c in enumerate(near)}, "shard": shard.ravel().view(np.int64)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            p = pd.concat(held)
            prints = np.stack([p[c].to_numpy().view(np.uint64) for c in near], axis=1)
            shingles = Shingles(folder, p["place"].to_numpy(), words, similarity)
            a, b = tree_links(p["cell"].to_numpy(), p["query"].to_numpy(), p["node"].to_numpy(), prints[:, 0].copy(), p["id"].to_numpy(), own.radius, step=512, more=prints[:, 1:], most=own.most, same=shingles.same)
            shingles.close()
            yield pd.DataFrame({"a": a, "b": b})

    rows = points.select("prints", "id", "place").mapInPandas(lean(emit), f"id long, place long, {', '.join(f'{c} long' for c in near)}, shard long")
    return dealt(rows, points.count() * own.bands, block).mapInPandas(lean(run), "a long, b long").distinct()


def similar_rows(parts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of text parts ``(part, file)`` every row as ``(part, row, doc_id, text_hash, component_id)``, linked by such a Jaccard similarity of distinct shingles.

    One 64-bit fingerprint is too short to tell 0.8 from less, so several are taken: the
    first is searched in BK-trees, the next decides which texts are compared.  Texts lie
    one by one in files of the shared folder until links are found.
    """
    own = plan(similarity)
    folder = fresh_dir(parts.sparkSession, "long-simhash-texts")

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, start, codec = None, 0, pa.Codec("zstd", compression_level=1)
        attempt = TaskContext.get().taskAttemptId()
        try:
            for batch in batches:
                for part, file in zip(batch["part"].tolist(), batch["file"].tolist(), strict=True):
                    out = out or write_at(texts_file(folder, attempt))
                    texts, rows = Texts(file), []
                    for row, doc_id in enumerate(texts.doc_ids):
                        raw = texts[row].tobytes()
                        small = codec.compress(raw, asbytes=True) if raw else b""
                        out.write(np.array([len(small), len(raw)], "<u4").tobytes() + small)
                        rows.append((part, row, doc_id, xxhash.xxh64_intdigest(raw) >> 1, long_fingerprint(raw.decode("utf-8", "surrogatepass"), words, own.parts).tobytes(), attempt << START_BITS | start))
                        start += 8 + len(small)
                    yield pd.DataFrame(rows, columns=["part", "row", "doc_id", "text_hash", "prints", "place"]).astype({"doc_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    n = parts.count()
    marked = materialize(parts.select("part", "file").repartition(max(1, n), "part").mapInPandas(lean(prints), "part long, row int, doc_id long, text_hash long, prints binary, place long"), "long-simhash")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "place")))
    points = checkpoint(marked.groupBy("prints").agg(first.alias("p")).where("p is not null").select("prints", "p.*"))
    roots = components(similar_links(points, own, folder, words, similarity))
    remove(folder)  # components has written the links
    named = points.join(roots, points.id == roots.node, "left").select("prints", F.coalesce("root", "id").alias("component_id"))
    rows = materialize(marked.join(named, "prints", "left").select("part", "row", "doc_id", "text_hash", "component_id"), "near-rows")
    discard(marked)
    return rows


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, component_id)`` like ``near_components``, linked by such a Jaccard similarity of their distinct shingles."""
    return similar_rows(write_texts(docs.select("doc_id", "text"), "near-texts"), words, similarity).select("doc_id", "component_id")


def near_components(docs: DataFrame, radius: int = 4, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, simhash, component_id)``, one row for each input row.

    component_id is the least doc_id reachable over links of at most ``radius`` differing
    bits.  Null and wordless texts have fingerprint zero and link like any other.  A row
    with a null doc_id joins the component of its fingerprint but never names one: where
    no row with that fingerprint has an id, its component_id is null.  Repeated rows are
    repeated in the result.
    """
    marked = materialize(with_fingerprint(docs.select("doc_id", "text"), words=words).select("doc_id", "simhash"), "simhash")
    points = checkpoint(marked.groupBy("simhash").agg(F.min("doc_id").alias("id")).where("id is not null"))
    roots = components(links(points, radius))
    named = points.join(roots, points.id == roots.node, "left").select("simhash", F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, "simhash", "left")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays, with all its columns.

    Of rows with the same doc_id the one whose text has the least hash stays (of equal texts
    any); rows with a null doc_id have no place in a component and stay.  Null and wordless
    texts are alike.  An empty table stays empty.  Documents are written to parts, and what
    is sent to those is which of their rows stay, so texts are never shuffled.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("no text"))
    parts = write_texts(own, "near-texts")
    rows = similar_rows(parts)
    kept = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct("text_hash", "part", "row")).alias("one")).select("one.part", "one.row")
    kept = kept.unionByName(rows.where("doc_id is null").select("part", "row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(b) if (b := [*batches]) else None
        if held is None or not len(held):
            return
        for part, p in held.to_pandas().groupby("part", sort=False):
            texts = Texts(p["file"].dropna().iloc[0]).table
            stay = np.sort(p["row"].dropna().to_numpy(np.int64))
            for i in range(0, len(stay), 256):
                some = texts.take(stay[i : i + 256]).combine_chunks()
                columns = [c.combine_chunks() for c in some.columns]
                text = columns[1].cast(pa.large_string()).cast(pa.string())
                columns[1] = pc.if_else(columns[-1], pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays(columns[:-1], some.schema.names[:-1])

    sent = kept.select("part", "row", F.lit(None).cast("string").alias("file")).unionByName(parts.select("part", F.lit(None).cast("int").alias("row"), "file"))
    types = own.drop("no text").withColumn("doc_id", F.col("doc_id").cast("long")).schema
    out = sent.repartition(max(1, parts.count()), "part").mapInArrow(lean(read), types).select("doc_id", "text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
    return out.select(*[F.col(quoted(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
