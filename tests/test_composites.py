from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F
from test_binning import genome

from quillbin.operators import composites, composition, naive_bayes, seeds
from quillbin.plans.queries import QUERIES, packing_rows


def packs_of(rows, enough, margin=7, low=5.0):
    """One pass over the sequences of a seed, pair by pair."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    out = []
    for i, (lead, length, score, means, sds) in enumerate(rows):
        combo, total = [lead], length
        for other, n, s, m, d in rows[i + 1 :]:
            ends = [(max(a, b), min(a, b), x if a >= b else y) for a, b, x, y in zip(means, m, sds, d, strict=True)]
            if not all(hi < low or int(hi * (1 - e)) <= lo <= int(hi * (1 + e)) + 1 for hi, lo, e in ends):
                continue
            if int(abs(score - s)) > margin:
                break
            combo.append(other)
            total += n
            if total >= enough:
                out.append((lead, combo, total))
                break
    return out


def test_packs_in_chunks_are_those_of_one_pass(spark):
    rnd = random.Random(5)
    rows = [(s, f"{s}{i}", rnd.randrange(500, 4000), round(rnd.uniform(-40, 0), 1), [rnd.uniform(2, 30), rnd.uniform(20, 40)], [0.2, 0.15]) for s, n in (("x", 300), ("y", 40), ("z", 1)) for i in range(n)]
    null = [("x", "none", None, -1.0, [9.0, 9.0], [0.2, 0.15]), ("x", "blank", 900, None, [9.0, 9.0], [0.2, 0.15]), ("x", "dry", 900, -1.0, None, [0.2, 0.15])]
    df = spark.createDataFrame(rows + null, "seed string, id string, length int, score double, means array<double>, sds array<double>")
    want = sorted((s, *p) for s in "xyz" for p in packs_of([r[1:] for r in rows if r[0] == s], 10_000))
    assert len(want) > 100
    for chunk in (7, 64, 5_000):
        assert sorted(tuple(r) for r in seeds.packed(df, chunk=chunk).collect()) == want
    assert seeds.packed(df.limit(0)).count() == 0


def test_leaders_after_seeds_that_stand(spark):
    rnd = random.Random(6)
    rows = [(f"n{i}", i, [rnd.gauss(0, 1) for _ in range(4)], 10) for i in range(120)]
    nodes = spark.createDataFrame(rows, "id string, rank long, vec array<double>, bucket int")
    cor = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    kept = [r for r in rows if r[1] % 40 == 0]
    found = []
    for r in rows:
        if r not in kept and all(cor(r[2], x[2]) < 0.6 for x in kept + found):
            found.append(r)
    own = seeds.leaders_by_vector(nodes.where("rank % 40 <> 0"), seeds.Alike(0.6), batch=16, before=nodes.where("rank % 40 = 0"))
    assert sorted(r["id"] for r in own.collect()) == sorted(r[0] for r in found)


def test_best_of_blocks_of_seeds(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    seqs = spark.createDataFrame([(f"s{i}", text(rnd.randrange(0, 400))) for i in range(60)] + [("null", None)], "id string, seq string")
    logs = naive_bayes.log_probabilities(naive_bayes.kmer_counts(spark.createDataFrame([(f"t{i}", text(900)) for i in range(23)], "seed string, seq string"), "seed"), "seed").cache()
    want = {r["id"]: (r["seed"], round(r["score"], 6)) for r in naive_bayes.best(naive_bayes.scores_of_all(seqs, logs)).collect()}
    for block in (4, 1000):
        assert {r["id"]: (r["seed"], round(r["score"], 6)) for r in naive_bayes.best_of_all(seqs, logs, block).collect()} == want
    assert naive_bayes.best_of_all(seqs, logs.limit(0)).count() == 0


def test_intervals_of_composites(spark):
    rnd = random.Random(8)
    depth = [(f"s{i}", k, m, [rnd.uniform(m * 0.8, m * 1.2) for _ in range(n)]) for i, n in ((1, 9), (2, 7), (3, 1)) for k, m in ((1, 20.0 + i), (2, 2.0))]
    lengths = {"s1": 4000, "s2": 5000, "s3": 3000}
    members = [("s1;s2", "s1", 0), ("s1;s2", "s2", 1), ("s3", "s3", 0)]
    out = composites.intervals(
        spark.createDataFrame(members, "seed string, id string, place int"), spark.createDataFrame(depth, "id string, sample int, mean double, windows array<double>"),
        spark.createDataFrame([*lengths.items()], "id string, length long"), spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1, 0.2)], "sample int, sd1 double, sd2 double"), 2.0,
    )
    got = {(r["seed"], r["sample"]): (r["mean"], r["lo"], r["hi"]) for r in out.collect()}
    mean = int((21.0 * 4000 + 22.0 * 5000) / 9000)
    windows = sorted(x for i, k, _, w in depth if k == 1 and i in ("s1", "s2") for x in w)  # sixteen within the fences
    sd = min(max((sum((x - mean) ** 2 for x in windows) / 15) ** 0.5 / mean, 0.1), 0.2)
    assert statistics.mean(windows) > 15
    assert got[("s1;s2", 1)] == (mean, int(mean * (1 - sd * 2)), int(mean * (1 + sd * 2)) + 1)
    assert got[("s1;s2", 2)] == got[("s3", 2)] == (2.0, 0, 0)
    assert got[("s3", 1)] == (23.0, int(23 * 0.8), int(23 * 1.2) + 1)


def test_short_sequences_of_another_genome_get_a_seed(spark):
    rnd = random.Random(9)
    rows, depth = [], []
    for g, (mean, sizes) in enumerate(((40.0, [40_000, 20_000, 4_000, 3_000, 4_500]), (80.0, [4_000] * 9))):
        whole, at = genome(rnd, sum(sizes)), 0
        for k, n in enumerate(sizes):
            rows.append((f"g{g}_{k}", whole[at : at + n], n))
            depth.append((f"g{g}_{k}", 1, mean, [mean] * 12))
            at += n
    sequences = spark.createDataFrame(rows, "id string, seq string, length long")
    depths = spark.createDataFrame(depth, "id string, sample int, mean double, windows array<double>")
    limits = {(a, b): 0.55 for a in range(0, 220, 10) for b in range(0, 220, 10)}
    own = composites.Corpus(sequences, depths, spark.createDataFrame([(1, 0.1, 0.2)], "sample int, sd1 double, sd2 double"), limits, limits, 2.58, 10_000)
    nodes = composition.vectors(sequences.where("length >= 10000"))
    spans = depths.select(F.col("id").alias("seed"), "sample", "mean", F.lit(30).alias("lo"), F.lit(50).alias("hi"))
    nodes = nodes.join(composites.by_samples(spans), "id").checkpoint()
    found, members = composites.of_short(own, nodes, nodes.where("id = 'g0_0'"))
    ids = {r["seed"] for r in found.collect()}
    assert len(ids) == 1 and all(x.startswith("g1_") for x in next(iter(ids)).split(";"))
    assert {r["id"] for r in members.collect()} == set(next(iter(ids)).split(";"))


def test_packs_of_documents(spark, sf):
    by_source = {}
    for r in packing_rows(spark, sf).collect():
        if r["seed"] is not None and r["score"] is not None:
            by_source.setdefault(r["seed"], []).append(tuple(r)[1:2] + (r["length"], r["score"], r["means"], r["sds"]))
    want = sorted((s, lead, ";".join(m), n) for s, rows in by_source.items() for lead, m, n in packs_of(rows, 10_000))
    assert want
    assert sorted(tuple(r) for r in QUERIES["cluster_pack"](spark, sf).collect()) == want
