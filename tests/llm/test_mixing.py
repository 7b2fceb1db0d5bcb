from __future__ import annotations

import re
from collections import defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbin.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    out, left, free = {}, float(sum(sizes.values())), {*sizes}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(df, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    targets, taken = slow_targets(sizes), defaultdict(int)
    out = df.collect()
    assert len(out) == len(rows)
    for r in out:
        words = sum(d["end"] - d["start"] for d in r["draws"])
        taken[r["source"]] += words
        assert 0 <= words <= 3 * r["size"]
        assert all(0 <= d["start"] < d["end"] <= r["size"] and 0 <= d["shard"] < 8 for d in r["draws"])
        per_pass = defaultdict(int)
        for d in r["draws"]:
            per_pass[d["pass"]] += d["end"] - d["start"]
        assert all(n <= r["size"] for n in per_pass.values())
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    return out


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = check(mixing.planned(odd_docs, shards=8, block_words=16), odd_rows)
    again = mixing.planned(odd_docs.repartition(5), shards=8, block_words=16).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert mixing.planned(no_docs).count() == 0


def test_one_source_and_no_words(spark):
    rows = [(i, "a b c", "en", "x", 5) for i in range(10)]
    check(mixing.planned(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=8), rows)
    rows = [(i, "", "en", "x", 0) for i in range(3)]
    check(mixing.planned(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=8), rows)


def test_shards_get_equal_numbers_of_blocks(spark):
    quotas = [10, 20, 30, 0, 5000]
    rows = mixing.dealt(spark.createDataFrame([(quotas,)], "quotas array<long>"), 7).collect()
    assert [sum(r["quotas"][i] for r in rows) for i in range(5)] == quotas
    assert {sum(r["quotas"]) for r in rows} <= {722, 723}
    assert all(q >= 0 for r in rows for q in r["quotas"])


def test_hypergeometric_distribution(spark):
    k = spark.range(20_000).select(F.expr(mixing.hypergeometric("rand(7)", "60", "25", "17")).alias("k")).toPandas()["k"]
    want = np.array([comb(25, i) * comb(35, 17 - i) / comb(60, 17) for i in range(18)])
    assert np.abs(np.bincount(k, minlength=18) / 20_000 - want).max() < 0.015


def test_no_python_in_the_plan(spark, odd_docs):
    plan = mixing.planned(odd_docs, shards=4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tasks_of_the_stage_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    docs = spark.range(900).select("id", F.concat(F.repeat(F.lit("word "), 700), F.col("id")).alias("text"), (F.col("id") % 3).cast("string").alias("source")).withColumnRenamed("id", "doc_id")
    out = mixing.stage(spark, docs, "")
    assert out.rdd.getNumPartitions() == 90  # of 4 shuffle partitions
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 100  # of 900 or more


def test_stage_takes_whole_documents(spark, clashing, odd_rows, no_docs):
    out = mixing.stage(spark, clashing, "")
    assert out.columns == clashing.columns
    texts = {r[1] for r in odd_rows}
    seen = defaultdict(int)
    for r in out.collect():
        assert r["text"] in texts
        seen[r["doc_id"], r["text"]] += 1
    copies = defaultdict(int)
    for r in odd_rows:
        copies[r[0], r[1]] += 1
    assert all(n <= 3 * copies[k] for k, n in seen.items())
    assert mixing.stage(spark, no_docs, "").columns == no_docs.columns
