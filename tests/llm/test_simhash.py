from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
import pytest
import xxhash

from quillbin.llm import simhash


def slow_fingerprint(text, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    pieces = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    """prints: {id: fingerprint}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_fingerprints(odd_rows):
    for r in odd_rows:
        assert simhash.fingerprint(r[1]) == slow_fingerprint(r[1])
        assert simhash.fingerprint(r[1], 5) == slow_fingerprint(r[1], 5)


def test_components_are_those_of_all_pairs(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = {}
    for i in range(400):
        v = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            v ^= 1 << rnd.randrange(64)
        prints[i] = v
    points = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for v, i in {v: i for i, v in sorted(prints.items(), reverse=True)}.items()], "simhash long, id long")
    own = {i: prints[i] for i in [r["id"] for r in points.collect()]}
    for block in (4096, 16):
        links = simhash.links(points, 4, block)
        roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        assert {i: roots.get(i, i) for i in own} == slow_components(own, 4)


def test_tasks_follow_the_rows(spark):
    """Many small blocks in few shuffle partitions: no task gets more than its rows, and none is lost."""
    points = spark.range(20_000).select(F.xxhash64("id").alias("simhash"), "id")
    rows = points.select("simhash", "id", (F.col("id") % 3).alias("shard"))
    cells = simhash.dealt(rows, 20_000, 500, task_rows=4_000)
    sizes = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert cells.count() == sum(n * -(-n // 500) for n in (6667, 6667, 6666))
    assert cells.rdd.getNumPartitions() == -(-cells.count() // 4_000)
    assert max(sizes) < 4 * 4_000
    one = spark.createDataFrame([(1, 1, 7), (2, 2, 8)], "simhash long, id long, shard long")
    assert simhash.dealt(one, 2, 4).count() == 2


def test_all_rows_come_back(odd_docs, odd_rows):
    out = simhash.near_components(odd_docs).collect()
    assert len(out) == len(odd_rows)
    want = slow_components({r[0]: slow_fingerprint(r[1]) for r in odd_rows if r[0] is not None}, 4)
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, near = [], []
    for i in range(60):
        base = [word() for _ in range(rnd.randint(150, 400))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            copy = base[:]
            for _ in range(rnd.randint(1, len(base) // 60)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((10 * i + k, " ".join(copy)))
            near.append((10 * i, 10 * i + k))
    text = dict(rows)
    own = {r[0]: r[1] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(own) == len(rows)
    assert all(c // 10 == i // 10 for i, c in own.items())
    wanted = [(a, b) for a, b in near if jaccard(text[a], text[b]) >= 0.85]
    assert sum(own[a] == own[b] for a, b in wanted) >= 0.98 * len(wanted)


def test_similar_texts_about_the_limit(spark):
    """Pairs on both sides of 0.8, and families in which some pairs alone are similar enough."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(150):
        base = [word() for _ in range(rnd.randint(200, 500))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 2 + (i % 5 == 0) * 3):
            copy = base[:]
            for at in rnd.sample(range(10, len(base) - 10), round(len(base) * rnd.uniform(0.012, 0.04))):
                copy[at] = word()
            rows.append((10 * i + k, " ".join(copy)))
    text = dict(rows)
    root = {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(a, b, jaccard(text[a], text[b])) for a in text for b in text if a < b and a // 10 == b // 10]
    assert sum(0.8 <= s < 0.85 for *_, s in near) > 20 and sum(0.65 < s < 0.8 for *_, s in near) > 40
    for a, b, s in near:
        if s >= 0.8:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    own = {r[0]: r[1] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(find(own[i]) == find(i) for i in text)  # nothing is joined that no similar pairs join
    wanted = [(a, b) for a, b, s in near if 0.8 <= s < 0.85]
    assert sum(own[a] == own[b] for a, b in wanted) >= 0.93 * len(wanted)


def test_repeated_ids_give_the_same_row_each_time(spark):
    rows = [(1, "a b c d e f", "en", "s0", 0), (1, "g h i j k l", "en", "s1", 1), (2, "m n o p q r", "en", "s2", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = sorted(map(tuple, simhash.dedup(spark, docs, "").collect()))
    assert [r[0] for r in one] == [1, 2] and one[0] in rows
    assert one == sorted(map(tuple, simhash.dedup(spark, docs.orderBy("source", ascending=False).repartition(3), "").collect()))


def test_repeated_lines_do_not_link(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line = text(20)
    rows = [(i, f"{text(200)} {' '.join([line] * rnd.choice((10, 20, 30)))} {text(200)}", "en", "s0", 0) for i in range(24)]
    assert max(jaccard(a[1], b[1]) for a in rows for b in rows if a < b) < 0.1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.dedup(spark, docs, "").collect()) == [r[0] for r in rows]


def test_stage_keeps_one_of_each_group(spark, clashing, odd_rows, no_docs):
    out = simhash.dedup(spark, clashing, "")
    assert out.columns == clashing.columns
    ids = {r[0] for r in odd_rows if r[0] is not None}
    # equal texts, and the texts without words, which count as equal
    gone = {601, 603, 604}
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(ids - gone)
    assert sum(r["doc_id"] is None for r in rows) == sum(r[0] is None for r in odd_rows)
    assert simhash.dedup(spark, no_docs, "").count() == 0


@pytest.mark.parametrize("text", ["", None, " \n"])
def test_no_words(text):
    assert simhash.fingerprint(text) == 0
