from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash

from quillbin.llm import imatch


def test_edited_texts(odd_docs, odd_rows, no_docs):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 605]
    out = {r["doc_id"]: r for r in imatch.compared(odd_docs.where("doc_id is not null and doc_id <> 605")).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for k, r in enumerate(order):
        text, other = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert out[r[0]]["n_chars"] == len(text)
        assert out[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[r[0]]["near_edited"] <= 1 and 0 <= out[r[0]]["near_next"] <= 1
    assert imatch.compared(no_docs).count() == 0


def test_equal_texts_have_equal_fingerprints(odd_docs, odd_rows):
    out = imatch.compared(odd_docs).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for r in out:
        if r["doc_id"] in (600, 601, 605):
            by.setdefault("long" if r["doc_id"] < 605 else "short", set()).add(r["fingerprint"])
    assert {len(x) for x in by.values()} == {1}


def test_one_document_is_its_own_next(spark):
    r = imatch.compared(spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0
    assert r["edited_sha256"] == hashlib.sha256(("one two three four five six"[:14] + "one two three").encode()).hexdigest()


def test_edits_leave_some_likeness(spark, sf):
    out = imatch.op5(spark, sf).toPandas()
    assert (out["near_edited"] > out["near_next"]).mean() > 0.85
    assert out["near_next"].mean() < 0.02


def test_no_python_in_the_plan(odd_docs):
    plan = imatch.compared(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def hashed(start, *packed):
    for x in packed:
        start = xxhash.xxh64_intdigest(x, start)
    return start


def slow_terms(text):
    return {hashed(42, struct.pack("<i", imatch.SEED), w.encode()) for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def slow_fingerprint(own, lexicon):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    own, out = sorted((signed(t) for t in own if t >> 44 in lexicon)), []
    for k in range(imatch.CHAINS):
        for bits in imatch.RATES:
            mask = (1 << bits) - 1
            chosen = [t for t in own if (t % (1 << 64)) >> (k * 33 // imatch.CHAINS) & mask == mask]
            out.append(f"{hashed(42, struct.pack('<i', imatch.SEED), *[struct.pack('<q', t) for t in chosen]):016x}"[12:] if chosen else imatch.NONE)
    return out


def test_same_fingerprints_and_likeness_as_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    cells = Counter(h >> 44 for _, t in rows for h in slow_terms(t))
    lexicon = {c for c, n in cells.items() if max(2, imatch.BAND[0] * len(rows)) <= n <= max(2, imatch.BAND[1] * len(rows))}
    prints = [slow_fingerprint(slow_terms(t), lexicon) for _, t in rows]
    out = {r["doc_id"]: r for r in imatch.op5(spark, sf).collect()}

    def like(a, b):
        both = [x == y for x, y in zip(a, b, strict=True) if x != imatch.NONE or y != imatch.NONE]
        return sum(both) / len(both) if both else 1.0

    assert sum(0 < len({h for h in slow_terms(t) if h >> 44 in lexicon}) < 4 for _, t in rows) > 0  # short texts keep to the band as well
    for k, (i, text) in enumerate(rows):
        other, after = prints[(k + 1) % len(rows)], rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = slow_fingerprint(slow_terms(text[: len(text) - half] + after[:half]), lexicon)
        assert out[i]["fingerprint"] == "".join(prints[k]) and out[i]["edited_fingerprint"] == "".join(edited)
        assert out[i]["near_edited"] == pytest.approx(like(prints[k], edited)) and out[i]["near_next"] == pytest.approx(like(prints[k], other))
