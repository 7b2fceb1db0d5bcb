"""Leaders by vector in tiles, and numbering in ranges, against sequential loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbin.operators import coverage, seeds, shared


def sequential(rows, alike, before):
    chosen, out = list(before), []
    for r in sorted(rows, key=lambda r: (r["rank"], r["id"])):
        for s in chosen:
            d = np.sqrt((r["vec"] @ r["vec"]) * (s["vec"] @ s["vec"]))
            cor = r["vec"] @ s["vec"] / d if d else 0.0
            limit = alike.threshold.get((r["bucket"], s["bucket"]), np.inf) if isinstance(alike.threshold, dict) else alike.threshold
            if cor >= limit and (not alike.coverage or all(m < 5 or lo <= x <= hi for x, m, lo, hi in zip(r["means"], s["means"], s["lo"], s["hi"], strict=True))):
                break
        else:
            chosen.append(r)
            out.append(r["id"])
    return sorted(out)


def drawn(n, seed, copies=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, 12))
    rows = []
    for i in range(n):
        mean = float(rng.uniform(2, 40))
        vec = np.round(centre[rng.integers(7)] + rng.normal(size=12) * rng.choice([0.3, 0.9]), 3)
        rows.append({"id": f"n{i % (n // copies):04d}/{i}", "rank": int(rng.integers(n // 2)), "vec": vec, "bucket": int(rng.integers(1, 4) * 10), "means": [mean], "lo": [mean * 0.7], "hi": [mean * 1.2]})
    rows[3]["vec"] = np.zeros(12)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([{**r, "vec": r["vec"].tolist()} for r in rows], "id string, rank long, vec array<double>, bucket int, means array<double>, lo array<double>, hi array<double>").repartition(5)


@pytest.mark.parametrize(("batch", "with_coverage"), [(4096, True), (16, False), (16, True), (50, False)])
def test_same_as_the_sequential_loop(spark, batch, with_coverage):
    """Blocks of all sizes, equal ranks, a seed of no direction, thresholds by buckets, seeds there are before; edges that go one way only."""
    rows, before = drawn(260, 5), drawn(40, 6)[:9]
    alike = seeds.Alike({(a, b): 0.5 + (a + b) / 400 for a in (10, 20, 30) for b in (10, 20)} | {(10, 30): 0.6}, coverage=with_coverage)
    for own in (before, []):
        got = seeds.leaders_by_vector(frame(spark, rows), alike, batch, frame(spark, own) if own else None)
        assert sorted(r["id"] for r in got.collect()) == sequential(rows, alike, own)


def test_no_nodes(spark):
    none = frame(spark, drawn(20, 1)).limit(0)
    assert seeds.leaders_by_vector(none, seeds.Alike(0.5)).count() == 0
    assert seeds.leaders_by_vector(frame(spark, drawn(20, 1)), seeds.Alike(2.0), 8, none).count() == 20


def test_numbers_of_ranges(spark):
    """Many rows of one value, nulls, groups that are null, many small ranges in few shuffle partitions."""
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "a", "b"]), rnd.choice([1.0, 1.0, 1.0, 2.0, None]), i, i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, t long, range int")
    out = coverage.numbered(df, "x", ["g"], ["t"], range_rows=50)
    assert out.columns == ["g", "x", "t", "range", "n"]
    want = {}
    for g in (None, "a", "b"):
        for n, (_, x, t, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[t] = n
    assert {r["t"]: r["n"] for r in out.collect()} == want
    assert sorted(r["n"] for r in coverage.numbered(df, "t").collect()) == [*range(1, 2001)]
    sizes = df.repartitionByRange(40, "x", "t").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200  # a value of more than half the rows is cut by its ties


def test_a_cluster_needs_a_shared_folder():
    """Without one, only a machine that does all the work alone may take a folder of its own."""

    class Context:
        def __init__(self, master):
            self.master, self.at = master, None

        def getCheckpointDir(self):
            return self.at

        def setCheckpointDir(self, at):
            self.at = at

        def getConf(self):
            return {}

    class Session:
        def __init__(self, master, conf):
            self.sparkContext, self.conf = Context(master), conf

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_folder(Session(master, {}))
        own = Session(master, {"spark.checkpoint.dir": "hdfs:///x"})
        shared.shared_folder(own)
        assert own.sparkContext.at == "hdfs:///x"
    own = Session("local[2]", {})
    shared.shared_folder(own)
    assert own.sparkContext.at.startswith("file:///")
