from __future__ import annotations

import math
import random

import pytest

from quillbin.functions import statistics as st
from quillbin.operators import composition, coverage, evaluation, markers, occupancy, seeds


def test_leaders_are_those_of_one_pass_in_order(spark):
    rnd = random.Random(1)
    for _ in range(3):
        n = 60
        nodes = [(f"n{i}", i) for i in range(n)]
        edges = [(f"n{a}", f"n{b}") for a in range(n) for b in range(n) if a != b and rnd.random() < 0.05]
        has, want = {*edges}, []
        for x, _ in nodes:
            if not any((s, x) in has for s in want):
                want.append(x)
        found = seeds.leaders(spark.createDataFrame(nodes, "id string, rank int"), spark.createDataFrame(edges, "a string, b string"))
        assert sorted(r[0] for r in found.collect()) == sorted(want)


def test_leaders_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert [r[0] for r in seeds.leaders(spark.createDataFrame([("x", 1)], "id string, rank int"), none).collect()] == ["x"]
    assert seeds.leaders(spark.createDataFrame([], "id string, rank int"), none).count() == 0


def test_packs(spark):
    rows = [("s", "a", 6000, -1.0, [10.0], [0.2]), ("s", "b", 5000, -2.0, [10.5], [0.2]), ("s", "c", 7000, -3.0, [90.0], [0.2]), ("s", "d", 5000, -20.0, [10.0], [0.2])]
    found = seeds.packed(spark.createDataFrame(rows, "seed string, id string, length int, score double, means array<double>, sds array<double>"))
    assert [tuple(r) for r in found.collect()] == [("s", "a", ["a", "b"], 11000)]


def test_within_samples_and_wildcards(spark):
    rnd = random.Random(2)
    rows = [(f"x{i}", s, rnd.uniform(0, 40)) for i in range(60) for s in (1, 2)]
    own = [(f"s{i}", s, m, int(m * 0.7), int(m * 1.3) + 1) for i in range(12) for s in (1, 2) for m in [rnd.uniform(0, 40)]]
    x, s = spark.createDataFrame(rows, "id string, sample int, mean double"), spark.createDataFrame(own, "seed string, sample int, mean double, lo long, hi long")
    at = {(i, k): m for i, k, m in rows}
    for wildcard, open_end in ((True, False), (False, False), (True, True)):
        want = set()
        for i in {r[0] for r in rows}:
            for seed in {r[0] for r in own}:
                if all(wildcard and m < 5 or lo <= at[i, k] and (at[i, k] < hi if open_end else at[i, k] <= hi) for name, k, m, lo, hi in own if name == seed):
                    want.add((i, seed))
        assert {tuple(r) for r in coverage.within(x, s, 2, open_end, wildcard).collect()} == want


def test_gaps(spark):
    rows = [("a", 1, 5, 10), ("b", 1, 12, 20), ("c", 1, 12, 30), ("d", 1, 30, 40)]
    out = coverage.gaps_filled(spark.createDataFrame(rows, "seed string, sample int, lo long, hi long"), spark.createDataFrame([(1, 2.7)], "sample int, mean double"))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 2, 12), ("b", 1, 10, 20), ("c", 1, 10, 30), ("d", 1, 30, 40)]


def test_dispersion(spark):
    x = [9.0, 10.0, 11.0, 10.0, 9.5, 10.5, 10.0, 10.0, 9.0, 11.0, 100.0]
    kept = [v for v in x if v < 50]
    df = spark.createDataFrame([(x, 10.0), (x[:9], 10.0), (x, 0.5)], "w array<double>, m double")
    out = [r[0] for r in df.select(st.dispersion(df.w, df.m)).collect()]
    assert out[0] == pytest.approx(math.sqrt(sum((v - 10) ** 2 for v in kept) / (len(kept) - 1)) / 10)
    assert out[1:] == [None, 0.0]


def test_calibrated_probability(spark):
    pairs = spark.createDataFrame([("a", "b", 10, 20, 0.5), ("a", "c", 10, 20, 0.7)], "a string, b string, len1 int, len2 int, cor double")
    table = spark.createDataFrame([(10, 20, 0.5, 0.1, 0.4, 0.3)], "len1 int, len2 int, smean double, ssd double, cutoff double, diff double")
    out = composition.calibrated(pairs, table)
    assert sorted((r["b"], round(r["p"], 4)) for r in out.collect()) == [("b", 0.5), ("c", 0.9772)]
    assert composition.most_alike(out).first()["b"] == "c"


def test_composition_of_two_strands(spark):
    rnd = random.Random(3)
    s = "".join(rnd.choice("ACGT") for _ in range(3000))
    r = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    comp = composition.vectors(spark.createDataFrame([("a", s, 30000), ("b", r, 30000), ("c", "", 0)], "id string, seq string, length long"))
    out = composition.correlated(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), comp)
    cor = {x["b"]: x["cor"] for x in out.collect()}
    assert cor["b"] > 0.95
    assert cor["c"] == 0.0


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "bin string, species string, length long")
    assert evaluation.overall(none).first()[0] is None
    assert evaluation.per_species(none).count() == 0


def test_numbers_and_pivot(spark):
    out = markers.species_number(spark.createDataFrame([("s", f"g{i}", 2) for i in range(8)] + [("t", "g", 3)], "seed string, gene string, copies long"), 7)
    assert sorted(map(tuple, out.collect())) == [("s", 2), ("t", 0)]
    wide = markers.pivot(spark.createDataFrame([("g", "s", 2, "b"), ("g", "s", 1, "a")], "gene string, seed string, place int, cell string"), ["s", "t"])
    assert tuple(wide.first()) == ("g", "a;b", "NA")


def test_duplicates_go_to_different_seeds(spark):
    columns = "id string, seed string, value double, tie double"
    rows = [("x", "s", 3.0, 0.0), ("x", "t", 1.0, 0.0), ("y", "s", 2.0, 0.0), ("y", "t", 1.5, 0.0), ("z", "s", 0.5, 0.0)]
    genes = [(g, i) for i in ("x", "y", "w") for g in ("g1", "g2")] + [("g3", "z")]
    dups = spark.createDataFrame([("x", "y"), ("w", "x"), ("w", "y")], "a string, b string")
    none, own = spark.createDataFrame([], columns), spark.createDataFrame(genes, "gene string, id string")
    out = occupancy.assign_markers(spark.createDataFrame(rows, columns), none, own, dups)
    assert sorted(map(tuple, out.collect())) == [("x", "s"), ("y", "t"), ("z", "s")]
    # w has no other seed and takes it before them; the last one is left with none and goes to its best
    out = occupancy.assign_markers(spark.createDataFrame([*rows, ("w", "s", 0.1, 0.0)], columns), none, own, dups)
    assert sorted(map(tuple, out.collect())) == [("w", "s"), ("x", "t"), ("y", "s"), ("z", "s")]


def test_what_stands_for_a_cluster(spark):
    from quillbin.operators import merging

    assigned = spark.createDataFrame([(f"m{i}", "a") for i in range(10)] + [("a", "a"), ("x", "a"), ("b", "b"), ("m10", "b")], "id string, seed string")
    genes = spark.createDataFrame([("g", f"m{i}") for i in range(11)] + [("h", "m0")], "gene string, id string")
    for size, more in ((900, [("a", "a", True)]), (1000, [])):
        lengths = assigned.select("id").selectExpr("id", f"cast({size} as long) as length")
        out = merging.standing(assigned, genes, lengths).collect()
        assert sorted(map(tuple, out)) == sorted([(f"m{i}", "a", True) for i in range(10)] + more + [("b", "b", False), ("m10", "b", False)])


def test_short_sequences_need_a_gene_of_their_own(spark):
    columns = "id string, seed string, value double, tie double"
    one, two = [("x", "s", 3.0, 0.0)], [("y", "s", 2.0, 0.0), ("y", "t", -90.0, 0.0)]
    genes, twins = spark.createDataFrame([("g", "x"), ("g", "y")], "gene string, id string"), spark.createDataFrame([], "a string, b string")
    none = spark.createDataFrame([], columns)
    for kind, seed in (("long", "s"), ("short", "t")):
        rows = spark.createDataFrame(one + two, columns)
        out = occupancy.assign_markers(*((rows, none) if kind == "long" else (none, rows)), genes, twins)
        assert {r["id"]: r["seed"] for r in out.collect()} == {"x": "s", "y": seed}


def test_small_clusters_merge_by_their_mean_alone(spark):
    from quillbin.operators import merging

    intervals = spark.createDataFrame([("a", 1, 20.0, 15, 25), ("b", 1, 18.0, 16, 20), ("c", 1, 40.0, 30, 50)], "seed string, sample int, mean double, lo long, hi long")
    vec = lambda *v: [float(x) for x in v]
    comp = spark.createDataFrame([(n, v, float(sum(x * x for x in v)), 10) for n, v in (("a", vec(1, -1, 0)), ("b", vec(-1, 1, 0)), ("c", vec(1, -1, 0)))], "id string, vec array<double>, ss double, bucket int")
    table = spark.createDataFrame([(10, 10, 0.5, 0.1, 0.4, 0.3)], "len1 int, len2 int, smean double, ssd double, cutoff double, diff double")
    copied = spark.createDataFrame([("a", "g", 1)], "seed string, gene string, copies long")
    assert merging.candidates(intervals, comp, copied, table, 7).count() == 0
    small = spark.createDataFrame([("b",)], "seed string")
    assert [(r["a"], r["b"]) for r in merging.candidates(intervals, comp, copied, table, 7, small=small).collect()] == [("a", "b")]
