from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
import pytest

from quillbin.llm import anchors, suffix_dedup
from quillbin.llm.suffix_arrays import Level, SuffixLevels, merge_scan


def slow(rows, length):
    """rows in corpus order: (id, text); repeated rows give repeated results."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(6)]
    rows = [(i * 3, " ".join(rnd.choice(passages) if rnd.random() < 0.25 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(0, 6)))) for i in range(120)]
    return rows + [(2, "a" * 500), (5, "ab" * 300), (7, None), (8, ""), (10, "abc" * 33), (11, "a" * 100), (1000, "xyz " * 200)]


@pytest.mark.parametrize("limits", [{}, {"hot": 10}, {"hot": 1}])
def test_same_as_brute_force(spark, limits):
    rows = corpus(1)
    out = suffix_dedup.per_document(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits)
    assert sorted(map(tuple, out.collect())) == sorted(slow(sorted(rows), 100))


def test_many_parts_and_joins_by_sorting(spark, monkeypatch):
    """Small parts, many shuffle partitions and no broadcast joins: what is dealt out by a key still meets."""
    whole = suffix_dedup.write_texts
    monkeypatch.setattr(suffix_dedup, "write_texts", lambda docs, name: whole(docs, name, 2000))
    monkeypatch.setattr(suffix_dedup, "TASK_SUFFIXES", 1000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = corpus(4)
        out = suffix_dedup.per_document(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=40)
        assert sorted(map(tuple, out.collect())) == sorted(slow(sorted(rows), 100))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_scan_of_two_suffix_arrays():
    rnd = random.Random(3)
    for block in (1, 3, 64):
        own = [sorted({"".join(rnd.choice("ab\0") for _ in range(6)) for _ in range(rnd.randint(0, 40))}) for _ in range(2)]
        a, b = (Level(np.frombuffer("".join(x).encode(), np.uint8), np.arange(len(x)) * 6) for x in own)
        place, same = merge_scan(a, b, 6, block)
        assert same.tolist() == [x in own[0] for x in own[1]]
        assert place.tolist() == [sum(y < x for y in own[0]) for x in own[1]]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted(map(repr, (tuple(r) for r in suffix_dedup.per_document(odd_docs).collect())))
    order = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))
    assert got == sorted(map(repr, slow([r[:2] for r in order], 100)))
    assert suffix_dedup.per_document(no_docs).count() == 0


def test_stage_keeps_rows_and_columns(spark, clashing, odd_rows, no_docs):
    out = suffix_dedup.stage(spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert sum(r["text"] is None for r in rows) == sum(r[1] is None for r in odd_rows)
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert suffix_dedup.stage(spark, no_docs, "").columns == no_docs.columns


@pytest.mark.parametrize("kind", ["int", "short", "string"])
def test_stage_gives_ids_as_they_came(spark, odd_docs, kind):
    docs = odd_docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    out = suffix_dedup.stage(spark, docs, "")
    assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))


def test_equal_strings_share_an_anchor():
    rnd = np.random.default_rng(1)
    a = rnd.integers(97, 101, 3000).astype(np.uint8)
    b = np.concatenate((rnd.integers(97, 101, 57).astype(np.uint8), a[500:900]))
    at = {}
    for data in (a, b):
        r = anchors.runs(data, 100)
        assert r.count.sum() == len(data) - 99
        for h, s, n in zip(r.anchor, r.start, r.count, strict=True):
            for k in range(s, s + n):
                assert at.setdefault(data[k : k + 100].tobytes(), h) == h


def test_levels_grow_geometrically():
    index, rnd = SuffixLevels(10), random.Random(2)
    seen = set()
    for _ in range(40):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(10, 40))).encode() for _ in range(8)]
        counts = np.array([len(t) - 9 for t in texts])
        want = []
        for t in texts:
            for i in range(len(t) - 9):
                want.append(t[i : i + 10] in seen)
                seen.add(t[i : i + 10])
        assert index.add(texts, counts).tolist() == want
        sizes = [len(x.at) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_only_suffixes_whose_bytes_may_be_there_twice_are_compared(monkeypatch):
    from quillbin.llm import suffix_arrays, suffix_dedup

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 5_000, np.uint8).tobytes()
    texts = [base[:900], base[1_000:1_100], base[800:1_000], base[:900], base[1_000:1_100], base[2_000:2_100], base[3_000:4_000]]
    counts = np.array([len(t) - 99 for t in texts], np.int64)
    compared, heads = [], suffix_arrays.heads
    monkeypatch.setattr(suffix_arrays, "heads", lambda text, at, length: compared.append(len(at)) or heads(text, at, length))
    seen = np.concatenate([s for _, _, s in suffix_arrays.repeated(texts, counts, 100)])
    known, want = set(), []
    for t, n in zip(texts, counts.tolist(), strict=True):
        for i in range(n):
            want.append(t[i : i + 100] in known)
            known.add(t[i : i + 100])
    assert seen.tolist() == want and sum(want) > 800
    assert sum(compared) < 2 * 801 + 100 < counts.sum()
    rows = pd.DataFrame({"part": 0, "row": range(len(texts)), "start": 0, "count": counts})
    del compared[:]
    found = [*suffix_dedup.compared(rows, texts, 100)]
    spans = sorted(tuple(r) for old, _ in found for r in old[["row", "start", "end"]].to_numpy().tolist())
    assert spans == [(2, 0, 100), (3, 0, 900), (4, 0, 100)]
    assert sum(len(new) for _, new in found) > 3 and sum(compared) < 10
