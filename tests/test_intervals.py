from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillbin.functions import statistics
from quillbin.operators import coverage, naive_bayes, shared


def drawn(rnd, n_samples, n=120, seeds=14):
    """Means of some samples are missing or null; one sample tells sequences apart, the others hardly do."""
    samples = [f"s{k}" for k in range(n_samples)]
    rows = [(f"i{i}", s, None if rnd.random() < 0.02 else float(rnd.randrange(2_000 if k == n_samples - 1 else 30)) / 2) for i in range(n) for k, s in enumerate(samples) if rnd.random() > 0.03]
    spans = []
    for i in range(seeds):
        for k, s in enumerate(samples):
            mean = float(rnd.randrange(1_000) if k == n_samples - 1 else rnd.randrange(2, 15))
            lo = rnd.randrange(0, 4) if k < n_samples - 1 else int(mean * 0.7)
            spans.append((f"seed{i}", s, 1.0 if i == 0 else mean, lo, rnd.choice([lo - 2, lo, 16]) if k < n_samples - 1 and i % 5 == 1 else 16 if k < n_samples - 1 else int(mean * 1.4)))
    return samples, rows, spans


def by_hand(samples, rows, spans, open_end, wildcard):
    means, out = {}, set()
    for i, s, m in rows:
        means.setdefault(i, {})[s] = m
    for seed in {x[0] for x in spans}:
        own = {x[1]: x[2:] for x in spans if x[0] == seed}

        def fits(m, mean, lo, hi):
            return wildcard and mean < coverage.LOW or m is not None and lo <= m and (m < hi if open_end else m <= hi)

        out |= {(i, seed) for i, own_means in means.items() if all(fits(own_means.get(s), *own[s]) for s in samples)}
    return out


@pytest.mark.parametrize("n_samples", [1, 2, 3, 9])
@pytest.mark.parametrize("open_end,wildcard", [(False, True), (True, True), (False, False)])
def test_intervals_of_several_samples(spark, n_samples, open_end, wildcard):
    samples, rows, spans = drawn(random.Random(n_samples), n_samples)
    x, s = spark.createDataFrame(rows, "id string, sample string, mean double"), spark.createDataFrame(spans, "seed string, sample string, mean double, lo long, hi long")
    got = [tuple(r) for r in coverage.within(x, s, n_samples, open_end, wildcard).collect()]
    want = by_hand(samples, rows, spans, open_end, wildcard)
    assert len(got) == len(set(got)) and set(got) == want
    assert want


def test_seeds_are_joined_in_the_sample_with_the_fewest_sequences(spark):
    placed = spark.createDataFrame([("a", 0)] * 9 + [("b", 1)] * 3 + [("b", 2)] * 2, "sample string, cell long")
    cut = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("y", "a", 5), ("y", "b", 2), ("z", "b", 1), ("z", "b", 2), ("z", "a", 0)], "seed string, sample string, cell long")
    assert {tuple(r) for r in coverage.rarest(placed, cut).collect()} == {("x", "b"), ("y", "a"), ("z", "b")}


def test_no_rows_or_seeds(spark):
    x, s = spark.createDataFrame([("i", "a", 7.0)], "id string, sample string, mean double"), spark.createDataFrame([("k", "a", 7.0, 6, 8)], "seed string, sample string, mean double, lo long, hi long")
    for n in (1, 2):
        assert coverage.within(x.limit(0), s, n).count() == 0 and coverage.within(x, s.limit(0), n).count() == 0


def test_scores_do_not_depend_on_the_block_of_seeds(spark):
    rnd = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(rnd.choices("ACGT", k=80))) for i in range(30)] + [(99, "AC"), (98, None)], "id long, seq string")
    logs = naive_bayes.log_probabilities(naive_bayes.kmer_counts(seqs.where("id < 11").withColumn("seed", F.concat(F.lit("s"), "id")), "seed"), "seed")
    table = {}
    for r in logs.collect():
        table.setdefault(r["seed"], {})[r["kmer"]] = r["logp"]
    texts = {r["id"]: r["seq"] for r in seqs.where("id < 90").collect()}
    want = {(i, seed): round(sum(p[t[k : k + 4]] for k in range(len(t) - 3)) * 500 / len(t), 6) for i, t in texts.items() for seed, p in table.items()}
    for block in (3, 1_000):
        assert {(r["id"], r["seed"]): round(r["score"], 6) for r in naive_bayes.scores_of_all(seqs, logs, block).collect()} == want
    assert naive_bayes.scores_of_all(seqs, logs.limit(0)).count() == 0


def test_equal_means_of_any_size_have_no_dispersion(spark):
    mean = 123_456_789.01
    rows = [("k", "a", mean, 7 + i) for i in range(30)]
    members = spark.createDataFrame(rows, "seed string, sample string, mean double, length long").repartition(5)
    got = coverage.marker_interval(members, spark.createDataFrame([("a", 0.1, 0.2)], "sample string, sd1 double, sd2 double")).first()
    assert (got["mean"], got["lo"], got["hi"]) == (mean, int(mean), int(mean) + 1)


def test_squares_are_summed_about_the_rounded_mean(spark):
    """Ends that come out whole: a dispersion that is off by its last digit moves them by one."""
    rows, want = [], {}
    for a in range(1, 51):
        for b in range(a):
            for tenths in range(10 * b + 1, 10 * a):
                m, x, y = tenths / 10, float(b), float(a)
                own = (((x - m) * (x - m) + (y - m) * (y - m)) / 2) ** 0.5 / m
                low, high = min(b, int(m * (1 - min(max(own, 0.1), 0.2) * 2.58))), max(a, int(m * (1 + min(max(own, 0.1), 0.2) * 2.58)) + 1)
                if m >= 5 and abs(high * (1 + own) - round(high * (1 + own))) < 1e-9 and len(want) < 400:
                    # weights whose mean is exactly m
                    rows += [(f"{b}/{a}/{m}", "s", x, 10 * a - tenths), (f"{b}/{a}/{m}", "s", m, 1), (f"{b}/{a}/{m}", "s", y, tenths - 10 * b)]
                    want[f"{b}/{a}/{m}"] = (m, int(low * (1 - own)), int(high * (1 + own)) + 1)
    assert len(want) > 50
    members = spark.createDataFrame(rows, "seed string, sample string, mean double, length long")
    got = coverage.marker_interval(members, spark.createDataFrame([("s", 0.1, 0.2)], "sample string, sd1 double, sd2 double")).collect()
    assert {r["seed"]: (r["mean"], r["lo"], r["hi"]) for r in got} == want


def test_means_halfway_between_decimals_are_rounded_as_in_sql(spark, duck):
    """Means of two members, all halfway: a double's product by 100 decides, not the digits it is shown with."""
    halves = [(2 * k + 1) / 200 for k in range(5_000)]
    rows = [(i, 1, x, 1.0) for i, h in enumerate(halves) for x in (h, h)]
    members = spark.createDataFrame(rows, "seed long, sample int, mean double, length double").repartition(4)
    want = {i: duck.execute("select round(?::double, 2)", [h]).fetchall()[0][0] for i, h in enumerate(halves)}
    assert any(want[i] != round(h + 0.005, 2) for i, h in enumerate(halves))
    for got in (coverage.marker_interval(members, spark.createDataFrame([(1, 0.1, 0.2)], "sample int, sd1 double, sd2 double")), coverage.member_interval(members)):
        assert {r["seed"]: r["mean"] for r in got.collect()} == want


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(6)
    groups = {i: [rnd.choice([1, -1]) * rnd.uniform(0.5, 2) * 10.0 ** rnd.randrange(0, 7) for _ in range(rnd.randrange(1, 30))] for i in range(300)}
    groups |= {1_000: [0.1] * 10, 1_001: [1e300, 1.0, -1e300], 1_002: [float("inf"), 1.0], 1_003: [2.0**51] * 5_000}
    want = {i: sum(x) if i > 1_000 else math.fsum(x) for i, x in groups.items()}
    for _ in range(2):
        rows = [(i, x) for i, own in groups.items() for x in rnd.sample(own, len(own))]
        got = spark.createDataFrame([*rows, (1_004, None)], "id long, x double").groupBy("id").agg(statistics.exact_sum(F.col("x")).alias("s")).collect()
        assert {r["id"]: r["s"] for r in got if r["id"] not in (1_001, 1_004)} == {i: s for i, s in want.items() if i != 1_001}
        assert [r["s"] for r in got if r["id"] == 1_004] == [None]


@pytest.mark.parametrize("n_samples", [1, 2])
def test_one_crowded_cell_is_dealt_to_many_tasks(spark, monkeypatch, n_samples):
    """All means and intervals in one cell: as many tasks as pairs need, and each pair once."""
    monkeypatch.setattr(shared, "TASK_PAIRS", 500)
    monkeypatch.setattr(shared, "TILE", 16)
    x = spark.createDataFrame([(i, k, 20.0 + i % 3) for i in range(150) for k in range(n_samples)], "id long, sample int, mean double")
    s = spark.createDataFrame([(j, k, 20.0, 0, 21 + j % 2) for j in range(60) for k in range(n_samples)], "seed long, sample int, mean double, lo long, hi long")
    got = coverage.within(x, s, n_samples, width=1_000.0).select("id", "seed", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["id"], r["seed"]) for r in got) == [(i, j) for i in range(150) for j in range(60) if i % 3 < 2 + j % 2]
    assert len({r["task"] for r in got}) > 8
    rest = coverage.within_or_first(x, s.withColumn("hi", F.lit(22).cast("long")).withColumn("seed", F.col("seed").cast("string")), n_samples, "first")
    assert {r["id"] for r in rest.where("seed = 'first'").collect()} == {i for i in range(150) if i % 3 == 2}
    assert rest.count() == 100 * 60 + 50


def test_equal_intervals_are_met_once(spark, monkeypatch):
    """Four kinds of 90 seeds, some with an end or both missing: as many rows meet as there are kinds, and all pairs come out."""
    x = spark.createDataFrame([(i, k, float(i % 7) * 5) for i in range(60) for k in (1, 2)], "id long, sample int, mean double")
    kinds = [((9.0, 4, 16), (9.0, 0, 40)), ((2.0, 0, 1), (9.0, 11, 21)), ((9.0, None, None), (9.0, 0, 40)), ((2.0, None, 3), (2.0, 5, None))]
    s = spark.createDataFrame([(f"s{j}", k, *kinds[j % 4][k - 1]) for j in range(90) for k in (1, 2)], "seed string, sample int, mean double, lo long, hi long")
    fits = lambda m, mean, lo, hi: mean < 5 or lo is not None and lo <= m <= hi
    want = sorted((i, f"s{j}") for i in range(60) for j in range(90) if all(fits(float(i % 7) * 5, *kind) for kind in kinds[j % 4]))
    assert sorted(map(tuple, coverage.within(x, s, 2).collect())) == want and len(want) > 1_000
    own = coverage.meeting_cells(x, s, 2, False, True, 100.0)[1]
    assert own.count() == own.select("seed").distinct().count() == 4
    monkeypatch.setattr(coverage, "ALIKE", 20)
    assert sorted(map(tuple, coverage.within(x, s, 2).collect())) == want
    assert max(len(r["seeds"]) for r in coverage.meeting_cells(x, s, 2, False, True, 100.0)[1].collect()) < 20
