from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from tables import same_rows

from quillbin.llm import centroids


def test_same_rows_as_sql(spark, sf, duck):
    same_rows(centroids.op13(spark, sf), duck.sql(centroids.OP13_SQL))


def test_search_gives_the_nearest_and_the_smaller_number():
    rng = np.random.default_rng(7)
    for most in (1, 3, 1000, centroids.MOST):
        x, c = rng.integers(-most, most + 1, (300, 64)), rng.integers(-most, most + 1, (16, 64))
        c[5], c[9] = c[2], c[7]
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        for order in (np.arange(64), rng.permutation(64)):
            number, distance = centroids.nearest(x, c, order)
            assert number.tolist() == d.argmin(1).tolist()
            assert distance.tolist() == d.min(1).tolist()


def slow(rows, k, rounds, n):
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in own)
    c = [v for _, _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in own]
        groups = [[v for (_, v), j in zip(own, of, strict=True) if j == m] for m in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, c, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in own), key=repr)


def test_odd_vectors(spark):
    """Nulls, other lengths, values that are not finite, repeated rows and ids, equal vectors, a clashing column."""
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.5, -0.01, 0.0, 0.26, 2.0]) for _ in range(8)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, [1.0] * 7), (302, [1.0] * 7 + [None]), (303, [math.nan] * 8), (304, [math.inf] + [0.0] * 7), (305, []), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id int, embedding array<float>, cluster int").repartition(5)
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((4, 3), (1, 1), (500, 2)):
        got = centroids.clustered(centroids.whole_numbers(df, dimensions=8), k, rounds, dimensions=8).assigned.collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == slow(rows, k, rounds, 8)


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.clustered(centroids.whole_numbers(none)).assigned.count() == 0
    none.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op13(spark, str(tmp_path)).collect() == []
