from __future__ import annotations

import random

import numpy as np

from quillbin.functions.sequences import FOURMERS, zscores, zscores_of
from quillbin.operators import composition, splitting
from quillbin.plans import binning


def genome(rnd: random.Random, n: int) -> str:
    """Letters of a random chain of order two, so that genomes differ in composition."""
    weights = {a + b: [rnd.random() ** 2 + 0.02 for _ in range(4)] for a in "ACGT" for b in "ACGT"}
    s = "AC"
    out = [s]
    for _ in range(n):
        c = rnd.choices("ACGT", weights[s])[0]
        out.append(c)
        s = s[1] + c
    return "".join(out)


def test_two_genomes_are_told_apart(spark):
    rnd = random.Random(8)
    rows, depth, genes, truth = [], [], [], {}
    for g, mean in enumerate((40.0, 44.0)):
        whole = genome(rnd, 190_000)
        at = 0
        for k, n in enumerate([60_000, 40_000, 30_000, 20_000, 12_000] + [4_000] * 6):
            name = f"g{g}_{k}"
            rows.append((name, whole[at : at + n], n))
            windows = [mean + rnd.uniform(-3, 3) for _ in range(30)]
            depth.append((name, 1, sum(windows) / 30, windows))
            truth[name] = g
            at += n
        genes += [(f"gene{i}", f"g{g}_{i % 4}") for i in range(12)]
    table = [(a, b, 0.6, 0.13, 0.2, 0.15, 0.5, 0.55) for a in range(0, 220, 10) for b in range(0, 220, 10)]
    own = binning.Inputs(
        spark.createDataFrame(rows, "id string, seq string, length long"),
        spark.createDataFrame(depth, "id string, sample int, mean double, windows array<double>"),
        spark.createDataFrame(genes, "gene string, id string").distinct(),
        spark.createDataFrame(table, "len1 int, len2 int, smean double, ssd double, dmean double, dsd double, diff double, cutoff double"),
    )
    out = binning.bin_sequences(own, binning.Parameters(bin_length=50_000)).collect()
    assert sorted(r["id"] for r in out) == sorted(truth)
    by_bin: dict[str, set[int]] = {}
    for r in out:
        by_bin.setdefault(r["bin"], set()).add(truth[r["id"]])
    assert all(len(v) == 1 for k, v in by_bin.items() if k != "unassigned")
    assert sum(r["bin"] == "unassigned" for r in out) <= 2


def test_counts_of_one_strand_give_the_same_scores():
    rnd = random.Random(9)
    s = "".join(rnd.choice("ACGT") for _ in range(20_000))
    n = {}
    for k in (2, 3, 4):
        for i in range(len(s) - k + 1):
            n[s[i : i + k]] = n.get(s[i : i + k], 0) + 1
    # they differ by the few k-mers where the strands meet
    assert np.abs(zscores_of(n) - zscores(s)).max() < 0.2
    assert len(FOURMERS) == 256


def test_a_cluster_of_two_species_is_split(spark):
    rnd = random.Random(12)
    rows, genes = [], []
    for g in range(2):
        whole = genome(rnd, 110_000)
        for k in range(4):
            rows.append((f"g{g}_{k}", whole[k * 25_000 : (k + 1) * 25_000], 25_000))
        rows.append((f"g{g}_4", whole[100_000:104_000], 4_000))
        genes += [(f"gene{i}", f"g{g}_{i % 3}") for i in range(12)]
    sequences = spark.createDataFrame(rows, "id string, seq string, length long")
    table = [(a, b, 0.6, 0.13, 0.2, 0.15, 0.5, 0.55) for a in range(0, 220, 10) for b in range(0, 220, 10)]
    cutoffs = spark.createDataFrame(table, "len1 int, len2 int, smean double, ssd double, dmean double, dsd double, diff double, cutoff double")
    assigned = spark.createDataFrame([(r[0], "g0_3") for r in rows] + [("alone", "alone")], "id string, seed string")
    own_genes = spark.createDataFrame(genes, "gene string, id string").distinct()
    out = splitting.split_clusters(assigned, own_genes, sequences.select("id", "length"), composition.counted(sequences).checkpoint(), cutoffs)
    seed = {r["id"]: r["seed"] for r in out.collect()}
    assert set(seed) == {r[0] for r in rows} | {"alone"}
    assert seed["alone"] == "alone"
    assert len({seed[f"g0_{k}"] for k in range(5)}) == 1
    assert len({seed[f"g1_{k}"] for k in range(5)}) == 1
    assert seed["g0_0"] != seed["g1_0"]


def test_fallback_is_the_first_seed_of_all(spark):
    """The first line of the named ones, whatever the means; else the long seed with the greatest mean in the first sample."""
    nodes = spark.createDataFrame([("a", -3000), ("b", -4000), ("c", -4000), ("d", -9000)], "id string, rank long")
    found = spark.createDataFrame([("a",), ("c",), ("b",)], "id string")
    sequences = spark.createDataFrame([("p", "A", 1), ("q", "A", 1), ("r", "A", 1)], "id string, seq string, length long")
    own = lambda pinned: binning.Inputs(sequences, None, None, None, pinned)
    no_names = sequences.select(sequences.id.alias("seed"), "id").limit(0)
    assert binning.first_seed(own(None), no_names, nodes, found) == "b"
    assert binning.first_seed(own(None), no_names, nodes, found.limit(0)) == ""
    pinned = spark.createDataFrame([("r;q", "r", 5), ("r;q", "q", 5), ("p", "p", 9), ("lost", "lost", 1)], "seed string, id string, line long")
    mine = own(pinned)
    assert binning.first_seed(mine, binning.named_seeds(mine), nodes, found) == "r;q"


def test_rows_of_a_fallback_that_is_no_seed_are_lost(spark):
    """Two samples; x fits both, y none, and goes to the fallback only if that is a seed."""
    from quillbin.operators import classify

    depth = spark.createDataFrame([("x", 1, 10.0), ("x", 2, 8.0), ("y", 1, 10.0), ("y", 2, 80.0)], "id string, sample int, mean double")
    seeds = spark.createDataFrame([(s, k, 10.0, 5, 15) for s in "st" for k in (1, 2)], "seed string, sample int, mean double, lo long, hi long")
    counts = spark.createDataFrame([(i, "AAAA", 3) for i in "xy"], "id string, kmer string, n long")
    lengths = spark.createDataFrame([("x", 6), ("y", 6)], "id string, length long")
    logs = spark.createDataFrame([("s", "AAAA", -1.0), ("t", "AAAA", -2.0)], "seed string, kmer string, logp double")
    for first, want in (("t", {"x": "s", "y": "t"}), ("gone", {"x": "s"})):
        out = classify.classify_small(depth, seeds, counts, lengths, logs, 2, first).collect()
        assert {r["id"]: r["seed"] for r in out} == want
