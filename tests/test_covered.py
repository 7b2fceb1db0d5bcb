"""Places covered by spans, in as many tasks as the spans need."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillbin.operators import evaluation


def test_tasks_grow_with_the_spans(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "TASK_SPANS", 50, raising=False)
    rnd = random.Random(1)
    rows = [(f"q{rnd.randrange(90)}", rnd.randrange(60), rnd.randrange(60)) for _ in range(1_500)]
    rows += rows[:300]  # equal spans count once
    out = evaluation.covered(spark.createDataFrame(rows, "qry string, start int, end int"), ["qry"])
    got = out.select("qry", "covered", F.spark_partition_id().alias("task")).collect()
    want = {}
    for q, a, b in rows:
        want.setdefault(q, set()).update(range(min(a, b), max(a, b) + 1))
    assert {r["qry"]: r["covered"] for r in got} == {q: len(x) for q, x in want.items()}
    assert len({r["task"] for r in got}) > 15
    assert evaluation.covered(spark.createDataFrame([], "qry string, start int, end int"), ["qry"]).count() == 0
