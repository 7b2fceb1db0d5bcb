"""Clusters about centroids in whole numbers, by partial-distance search.

Vectors become integers first, so sums, floors and distances are exact and do not depend on
the order of rows.  In each round every task holds the centroids (``k`` times the dimensions,
however many vectors there are), finds the nearest one of each of its vectors, and returns
one sum of vectors for each cluster; a vector never leaves the task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.common import lean, materialize, table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Greatest component in absolute value: 64 squared differences of such fit a long.
MOST = 1 << 27
#: Dimensions after which centroids are given up, and vectors that are compared at once.
STEP, ROWS = 8, 2048


def whole_numbers(rows: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``rows(vec_id, vector array)`` to ``(vec_id long, x array<int>)``, ``x = floor(scale * component)``.

    Rows whose vector is null, has another length or a component that is null or not finite
    are left out; rows with a null vec_id stay, repeated rows stay repeated, further columns
    are not read.  A component beyond ``MOST`` is an error, as no long holds its distances.
    """
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) == dimensions) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.when(F.forall(v, lambda c: F.abs(c * scale) < MOST), v).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}")).cast("array<double>"))
    return rows.where(F.col(vector).isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(fits, lambda c: F.floor(c * scale).cast("int")).alias("x"))


def matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """``(number, squared distance)`` of the nearest centroid of each row; of equally near ones the smaller number.

    The centroid that is nearest in the first ``step`` dimensions of ``order`` gives each
    row's first best distance.  The others are summed up ``step`` dimensions at a time and
    given up once they are strictly above it; those that are left have all dimensions.
    """
    x, c = x[:, order], centroids[:, order]
    part = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    guess = part.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    row, number = np.nonzero(part <= best[:, None])
    total = part[row, number]
    for at in range(step, x.shape[1], step):
        total = total + ((x[row, at : at + step] - c[number, at : at + step]) ** 2).sum(1)
        stay = total <= best[row]
        row, number, total = row[stay], number[stay], total[stay]
    by = np.lexsort((number, total, row))
    first = by[np.flatnonzero(np.concatenate(([True], np.diff(row[by]) > 0)))] if len(by) else by
    return number[first], total[first]


def column_sums(vectors: DataFrame, of: Callable[[pa.ListArray], Iterable[tuple[int, int, np.ndarray]]]) -> list:
    """What ``of(x)`` yields as ``(group, count, sums)``, summed over all vectors: a row for each group and dimension reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for group, n, sums in of(b.column(0)):
                own = total.setdefault(group, [0, 0])
                own[0] += n
                own[1] = own[1] + sums
        yield pa.RecordBatch.from_pydict({"g": pa.array([*total], pa.int32()), "n": pa.array([n for n, _ in total.values()], pa.int64()), "sums": pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))})

    rows = vectors.select("x").mapInArrow(lean(run), "g int, n long, sums array<long>").select("g", "n", F.posexplode("sums").alias("d", "s"))
    return rows.groupBy("g", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("g", "d").collect()


class Clustering(NamedTuple):
    """assigned: ``(vec_id, cluster int, distance long)``, written; centroids: one row each."""

    assigned: DataFrame
    centroids: np.ndarray


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> Clustering:
    """``vectors(vec_id, x)`` of ``whole_numbers``, written once and read once a round.

    The first centroids are the k vectors with the least sha256 of ``seed:vec_id`` (equal
    ones by their components; null ids last), or all where there are fewer.  Each round moves
    every centroid that has vectors to the floor of their mean.
    """
    own = materialize(vectors, "whole-numbers")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = own.select(name.alias("name"), "x").orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dimensions)

    def spread(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray]]:
        x = matrix(column, dimensions)
        yield 0, len(x), x.sum(0)
        yield 1, len(x), np.minimum(x * x, 1 << 20).sum(0)  # tells the order of dimensions, no result

    seen = column_sums(own, spread)
    variance = np.array([sq["s"] / sq["n"] - (s["s"] / s["n"]) ** 2 if s["n"] else 0.0 for s, sq in zip(seen[:dimensions], seen[dimensions:], strict=True)] or [0.0] * dimensions)
    order = np.argsort(-variance, kind="stable")
    for _ in range(rounds):
        at = centroids

        def moved(column: pa.ListArray, at: np.ndarray = at) -> Iterator[tuple[int, int, np.ndarray]]:
            x = matrix(column, dimensions)
            for i in range(0, len(x), ROWS):
                some = x[i : i + ROWS]
                number, _ = nearest(some, at, order)
                for c in np.unique(number):
                    yield int(c), int((number == c).sum()), some[number == c].sum(0)

        centroids = at.copy()
        for r in column_sums(own, moved):
            centroids[r["g"], r["d"]] = r["s"] // r["n"]
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dimensions)
            for i in range(0, len(x), ROWS):
                number, distance = nearest(x[i : i + ROWS], last, order)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column(0).slice(i, ROWS), "cluster": pa.array(number.astype(np.int32)), "distance": pa.array(distance)})

    return Clustering(materialize(own.mapInArrow(lean(assign), "vec_id long, cluster int, distance long"), "clusters"), last)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each kept vector; an empty table has none."""
    found = clustered(whole_numbers(table(spark, sf_dir, "embeddings")))
    sums = {r["cluster"]: r["s"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(found.centroids) if i in sums]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row for each centroid


def round_sql(i: int) -> str:
    return f"""
a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.k = c.k GROUP BY v.r, c.c) GROUP BY r),
m{i} AS (SELECT a.b.c AS c, v.k, sum(v.x) AS s, count(*) AS n FROM v JOIN a{i} a USING (r) GROUP BY a.b.c, v.k),
c{i + 1} AS (SELECT c.c, c.k, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c AND c.k = m.k),"""


OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda t: CAST(floor({SCALE} * CAST(t AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda t: t IS NOT NULL AND isfinite(t))) = {DIMENSIONS}),
v AS (SELECT r, unnest(range(1, {DIMENSIONS + 1})) AS k, unnest(xs) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, xs) - 1 AS c FROM e),
c0 AS (SELECT s.c, v.k, v.x FROM s JOIN v USING (r) WHERE s.c < {CLUSTERS}),{"".join(map(round_sql, range(ROUNDS)))}
z AS (SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{ROUNDS} c ON v.k = c.k GROUP BY v.r, c.c) GROUP BY r),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS sha FROM c{ROUNDS} GROUP BY c)
SELECT e.vec_id, CAST(z.b.c AS INTEGER) AS cluster, CAST(z.b.d AS BIGINT) AS distance, CAST(sum(z.b.d) OVER (PARTITION BY z.b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(z.b.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM z JOIN e USING (r) JOIN h ON h.c = z.b.c
"""
