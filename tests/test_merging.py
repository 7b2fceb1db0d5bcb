"""Merges of a round against one pass over the leads, pairs of intervals against all pairs, duplicates with frequent genes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillbin.operators import coverage, markers, merging, shared
from quillbin.plans import queries

PAIRS = "a string, b string, ra double, inside boolean, p double, distance double"


def one_pass(rows, farthest=True):
    gone, taken, by_lead = {}, set(), {}
    for r in rows:
        by_lead.setdefault(r["a"], []).append(r)
    for a in sorted(by_lead, key=lambda a: (-by_lead[a][0]["ra"], a)):
        if a in gone:
            continue
        free = [r for r in by_lead[a] if r["b"] not in gone and r["b"] not in taken]
        own = [r for r in free if r["inside"]]
        sign = -1 if farthest else 1
        best = min(own, key=lambda r: (-(r["p"] or 0.0), r["b"]), default=None) or min(free, key=lambda r: (sign * r["distance"], r["b"]), default=None)
        if best is not None:
            gone[best["b"]] = a
            taken.add(a)
    return gone


def test_choices(spark):
    rows = [{"a": "x", "b": "y", "ra": 9.0, "inside": False, "p": 0.9, "distance": 1.0}, {"a": "x", "b": "z", "ra": 9.0, "inside": False, "p": 0.9, "distance": 2.0}, {"a": "y", "b": "z", "ra": 8.0, "inside": True, "p": 0.2, "distance": 1.0}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], PAIRS)
    pairs = lambda out: {r["seed"]: r["to"] for r in out.collect()}
    assert pairs(merging.matched(df)) == one_pass(rows) == {"z": "x"}
    assert pairs(merging.matched(df, farthest=False)) == one_pass(rows, False) == {"y": "x"}
    assert merging.matched(df.limit(0)).count() == 0


@pytest.mark.parametrize("farthest", [True, False])
def test_waves_are_one_pass(spark, farthest):
    """Fifty drawn rounds at once, names of their own; equal means, likenesses and distances."""
    rnd, rows = random.Random(3), []
    for k in range(50):
        n = rnd.randint(2, 14)
        names = [f"{k:02d}/{i:02d}" for i in range(n)]
        rank = sorted(((-rnd.choice([1.0, 2.0, 3.0, rnd.random()]), x) for x in names))
        for i, (m, a) in enumerate(rank):
            for _, b in rank[i + 1 :]:
                if rnd.random() < 0.4:
                    rows.append({"a": a, "b": b, "ra": -m, "inside": rnd.random() < 0.5, "p": rnd.choice([None, 0.5, 0.9, rnd.random()]), "distance": rnd.choice([1.0, 2.0, rnd.random()])})
    out = merging.matched(spark.createDataFrame([tuple(r.values()) for r in rows], PAIRS), farthest).collect()
    assert {r["seed"]: r["to"] for r in out} == one_pass(rows, farthest)
    assert len(out) == len({r["seed"] for r in out}) > 100


@pytest.mark.parametrize("range_pairs", [1, 40, 500])
def test_ranges_are_one_pass(spark, range_pairs):
    """Ranges that wait for each other, and others that share no name; equal means and likenesses."""
    rnd, rows = random.Random(range_pairs), []
    for k in range(6):
        names = [f"{k}/{i:03d}" for i in range(40)]
        mean = {x: rnd.choice([1.0, 2.0, 3.0]) + k for x in names}
        rank = sorted(names, key=lambda x: (-mean[x], x))
        for i, a in enumerate(rank):
            for b in rank[i + 1 : i + 12]:
                if rnd.random() < 0.4:
                    rows.append({"a": a, "b": b, "ra": mean[a], "inside": rnd.random() < 0.5, "p": rnd.choice([None, 0.5, rnd.random()]), "distance": rnd.choice([1.0, rnd.random()])})
    rows = rows[:: 12 if range_pairs == 1 else 1]
    out = merging.matched(spark.createDataFrame([tuple(r.values()) for r in rows], PAIRS), range_pairs=range_pairs).collect()
    assert {r["seed"]: r["to"] for r in out} == one_pass(rows)


def test_lists_that_are_cut_are_one_pass(spark, monkeypatch):
    """Leads that all want the same partners most, so that cut lists run out, among others; passes are fewer than ranges of whole lists."""
    monkeypatch.setattr(merging, "HEAD", 3)
    rnd, rows = random.Random(12), []
    for i in range(150):
        for j in rnd.sample(range(150, 400), 40) if i >= 12 else range(150, 190):
            rows.append({"a": f"{i:03d}", "b": f"{j:03d}", "ra": 900.0 - i // 2, "inside": i < 12 or rnd.random() < 0.6, "p": 1 / j if i < 12 else rnd.random(), "distance": float(j)})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], PAIRS)
    passes = []
    monkeypatch.setattr(merging.coverage, "running", lambda *x, run=coverage.running: passes.append(1) or run(*x))
    out = {r["seed"]: r["to"] for r in merging.matched(df, range_pairs=100).collect()}
    assert out == one_pass(rows) and len(out) == 150
    assert 2 < len(passes) // 2 < 20 < len(rows) // 100


def test_rounds_do_not_grow_with_a_chain(spark):
    """Each of 400 clusters wants the next one most, so each waits for the one before."""
    rows = [{"a": f"{i:03d}", "b": f"{i + k:03d}", "ra": 1_000.0 - i, "inside": True, "p": 1.0 / k, "distance": 0.0} for i in range(400) for k in (1, 2)]
    sc = spark.sparkContext
    df = spark.createDataFrame([tuple(r.values()) for r in rows], PAIRS)
    sc.setJobGroup("chain", "a chain of clusters")
    try:
        out = merging.matched(df).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r["seed"]: r["to"] for r in out} == one_pass(rows)
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 60


def test_correlations_of_pairs_that_meet(spark):
    rnd = random.Random(4)
    vec = {f"s{i:02d}": [0.0] * 3 if i == 7 else [rnd.uniform(-1, 1) for _ in range(3)] for i in range(40)}
    ss = {x: sum(v * v for v in e) for x, e in vec.items()}
    rows = spark.createDataFrame([(x, 1, 30.0 + i // 2, 0.0, 90.0) for i, x in enumerate(vec)], "seed string, sample int, mean double, lo double, hi double")
    vectors = spark.createDataFrame([(x, vec[x], ss[x]) for x in vec], "seed string, vec array<double>, ss double")
    cor = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b], strict=True)) / (ss[a] * ss[b]) ** 0.5 if ss[a] * ss[b] else 0.0
    got = {(r["a"], r["b"]): r["cor"] for r in merging.meeting(rows, vectors, 0.0).collect()}
    mean = {x: i // 2 for i, x in enumerate(vec)}
    assert got == pytest.approx({(a, b): cor(a, b) for a in vec for b in vec if (-mean[a], a) < (-mean[b], b) and cor(a, b) >= 0})


def test_pairs_of_intervals_are_those_of_all_pairs(spark):
    """Low means in some samples or all, means outside their interval, intervals of no width, and one as wide as all."""
    rnd, rows = random.Random(8), {}
    for i in range(70):
        for s in (1, 2, 3):
            m = rnd.choice([rnd.uniform(0, 6), rnd.uniform(3, 60), rnd.uniform(20, 30)]) if i % 9 else rnd.uniform(0, 4.9)
            w = 0 if i % 7 == 0 else rnd.uniform(0, 6)
            rows[f"s{i:02d}", s] = (m, m - w, m + w * rnd.random()) if i != 5 else (m, -10.0, 90.0)
    first, want = {x: rows[x, 1][0] for x, s in rows if s == 1}, set()
    rank = lambda x: (-first[x], x)
    for a in first:
        for b in first:
            if rank(a) < rank(b):
                cells = [(*rows[a, s], *rows[b, s]) for s in (1, 2, 3)]
                inside = [ma < 5 or la <= mb <= ha for ma, la, ha, mb, _, _ in cells]
                if all(x or (lb < ha and hb > la) for x, (_, la, ha, _, lb, hb) in zip(inside, cells, strict=True)):
                    want.add((a, b, all(inside)))
    df = spark.createDataFrame([(x, s, *v) for (x, s), v in rows.items()], "seed string, sample int, mean double, lo double, hi double")
    got = [(r["a"], r["b"], r["inside"]) for r in merging.meeting(df).collect()]
    assert sorted(got) == sorted(want)
    assert 50 < len(want) and merging.meeting(df.limit(0)).count() == 0


def test_round_of_the_tables(spark, sf):
    shared.shared_folder(spark)
    pairs = [r.asDict() for r in queries.merge_candidates(spark, "/root/testdata/sf0.01").collect()]
    got = {r["seed"]: r["to"] for r in queries.merge_round(spark, "/root/testdata/sf0.01").collect()}
    assert got == one_pass(pairs) and len(got) > 3


def test_duplicates_of_frequent_genes(spark):
    """A gene of a third of all ids, and two of a tenth, against counts of all pairs; no row for each pair of the frequent one."""
    rnd, rows = random.Random(2), set()
    for i in range(600):
        rows |= {(f"g{rnd.randrange(150)}", i) for _ in range(rnd.randint(0, 4))}
        if i % 3 == 0:
            rows.add(("hot", i))
        if i % 10 == 0:
            rows |= {("warm", i), ("warmer", i)}
    by_gene = {}
    for g, i in rows:
        by_gene.setdefault(g, []).append(i)
    for least in (1, 2, 3):
        n = Counter((a, b) for own in by_gene.values() for a in own for b in own if a < b)
        want = sorted((a, b, k) for (a, b), k in n.items() if k >= least)
        got = markers.duplicates(spark.createDataFrame(sorted(rows), "gene string, id long"), least)
        assert sorted(map(tuple, got.collect())) == want


def test_clusters_of_one_cell_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_PAIRS", 500)
    monkeypatch.setattr(shared, "TILE", 16)
    df = spark.createDataFrame([(f"s{i:03d}", s, 30.0 + i / 1_000, 20.0, 40.0) for i in range(120) for s in (1, 2)], "seed string, sample int, mean double, lo double, hi double")
    got = [(r["a"], r["b"], r["task"]) for r in merging.meeting(df).select("a", "b", F.spark_partition_id().alias("task")).collect()]
    assert sorted((a, b) for a, b, _ in got) == sorted((f"s{i:03d}", f"s{j:03d}") for i in range(120) for j in range(i))
    assert len({t for _, _, t in got}) > 8
