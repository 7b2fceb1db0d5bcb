from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from tables import same_rows

from quillbin.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def of(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, best):
    """Every document scored for every item, in Python integers."""
    counted = [(i, Counter(of(t)), len(of(t))) for i, t in docs]
    n, length = sum(s > 0 for *_, s in counted), sum(s for *_, s in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(of(t))
    out = []
    for item, own in terms.items():
        scored = []
        for i, c, size in counted:
            m = 50 + 50 * size * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=repr)


def test_same_rows_as_sql(spark, sf, duck):
    same_rows(lexical.op12(spark, sf), duck.sql(lexical.OP12_SQL))


def test_terms():
    for text in ("A b-c_d É ÀB\x80x ẞ y z İ 12a", "", None, "\x00a\x7fb\x85c", "日本 語! x"):
        assert [t.decode() for t in lexical.terms(text)] == of(text)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_every_score_by_brute_force(spark, odd_rows, clashing, block, monkeypatch):
    """Nulls, empty and long texts, repeated rows, ties, frequent terms in several blocks, clashing columns; many small partitions."""
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", 3)
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice(of(r[1]) or ["x"]) for r in rnd.sample(odd_rows, 8)).title()) for i in range(12)] + [(3, "minus extra"), (None, "minus"), (50, None), (51, "unknownword"), (52, "!?")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("score", lexical.F.lit(1))
    for k in (1, 5, 500):
        got = lexical.search(lexical.postings(clashing.repartition(9), block_bytes=block), queries, best=k).collect()
        assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == slow([(r[0], r[1]) for r in odd_rows], items, k)


def test_ties_by_id_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([(i % 7, "same words here" if i % 2 else "other") for i in range(40)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "same HERE")], "item_id int, text string")
    got = lexical.search(lexical.postings(docs), queries, best=10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(i % 7 for i in range(40) if i % 2)[:10]
    assert lexical.search(lexical.postings(no_docs), queries).count() == 0
    assert lexical.search(lexical.postings(docs), queries.limit(0)).count() == 0
