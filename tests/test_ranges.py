from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillbin.operators import coverage


def hot(spark, n=3_000):
    """A group of a third of the rows, a group of one value, and many small ones."""
    rnd = random.Random(n)
    rows = [("hot", float(rnd.randrange(2_000)) / 8) for _ in range(n)] + [("one", 3.0)] * n + [(f"g{i % 300}", float(rnd.randrange(50))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample string, ratio double").repartition(7)


@pytest.mark.parametrize("range_rows", [40, 700, 1_000_000])
def test_running_sums_of_a_hot_group(spark, range_rows):
    rows, df = hot(spark)
    counted = df.groupBy("sample", "ratio").agg(F.count("*").alias("k"))
    got = coverage.running(counted, "sample", "ratio", "k", range_rows)
    want, upto = {}, {}
    for s, x in sorted(rows):
        upto[s] = upto.get(s, 0) + 1
        want[s, x] = upto[s]
    assert {(r["sample"], r["ratio"]): r["to"] for r in got.collect()} == want


@pytest.mark.parametrize("range_rows", [40, 1_000_000])
def test_order_statistics_of_a_hot_group(spark, range_rows):
    rows, df = hot(spark)
    by = {}
    for s, x in rows:
        by.setdefault(s, []).append(x)
    got = {r["sample"]: (r["middle"], r["upper"]) for r in coverage.quarters(df, range_rows).collect()}
    for s, x in by.items():
        x.sort()
        n = len(x)
        assert got[s] == ((x[(n + 1) // 2 - 1] + x[n // 2]) / 2, x[max(3 * n // 4, 1) - 1]), s
    limits, counted = coverage.fences(df, "sample", "ratio", range_rows)
    assert set(counted.columns) == {"sample", "ratio", "k"}
    one, _ = coverage.fences(df.where("sample = 'hot'").coalesce(1), "sample", "ratio")
    assert limits.where("sample = 'hot'").first()["low"] == one.first()["low"]
    assert limits.count() == len(by)


def test_null_groups_have_their_own_sums(spark):
    rows = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 1)], "sample string, ratio double, k long")
    got = coverage.running(rows, "sample", "ratio", "k", 1)
    assert sorted(map(tuple, got.select("ratio", "to").collect())) == [(1.0, 1), (1.0, 2), (2.0, 5)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "sample string, ratio double")
    assert coverage.quarters(none).count() == 0 and coverage.fences(none, "sample", "ratio")[0].count() == 0
