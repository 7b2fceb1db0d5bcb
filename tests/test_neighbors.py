from __future__ import annotations

import numpy as np

from quillbin.plans import queries


def test_all_pairs_above_the_limit(spark):
    """Ids with gaps, alike vectors far apart by id, and blocks smaller than the table."""
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(10, 16))
    vec = {int(i): base[k % 10] + 0.6 * rnd.normal(size=16) for k, i in enumerate(np.cumsum(rnd.integers(1, 5, 60)))}
    vec = {i: v - v.mean() for i, v in vec.items()}
    rows = spark.createDataFrame([(i, v.tolist(), float(v @ v)) for i, v in vec.items()], "vec_id long, e array<double>, ss double")
    want = {(a, b) for a in vec for b in vec if a < b and round(float(vec[a] @ vec[b] / np.sqrt(vec[a] @ vec[a] * (vec[b] @ vec[b]))), 6) >= 0.5}
    assert any(b > a + 1 for a, b in want)
    for block in (7, 2048):
        got = [(r["a"], r["b"]) for r in queries.neighbors(rows, 0.5, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_rows_are_sent_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """By default, more rows make larger blocks, not more of them; a task multiplies a few rows at once."""
    monkeypatch.setattr(queries, "ROWS", 100)
    monkeypatch.setattr(queries, "BLOCKS", 2)
    n = 6_000
    rows = spark.range(n).selectExpr("id as vec_id", f"array(cos(id * 2 * pi() / {n}), sin(id * 2 * pi() / {n})) as e", "1D as ss").cache()
    got = queries.neighbors(rows, 0.99999)
    assert all(-(-k // queries.block_rows(k)) <= 2 for k in (1, 6_000, 200_000))
    near = [(r["a"], r["b"]) for r in got.collect()]
    width = int(np.arccos(0.9999895) * n / 2 / np.pi)  # of what rounds to the limit
    assert len(near) == len(set(near)) == n * width
