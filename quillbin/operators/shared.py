"""The folder that all machines share, where lineage is cut, and joins of few keys in as many tasks as their pairs need."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of each side that meet in a tile, pairs that a task compares, and tasks at most.
TILE, TASK_PAIRS, TASKS = 4_096, 50_000_000, 4_000
#: Where rows of the right stand for several: how many times as many meet in a tile, on both sides.
HEAVY = 4


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder named by spark.checkpoint.dir; to a temporary one only where it is unset and one machine does all the work, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster's machines share")
        at = f"file://{tempfile.mkdtemp(prefix='quillbin-')}"
    sc.setCheckpointDir(at)


def tiles(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, tile: int | None = None, weight: Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt out to tiles, and the columns that name one; each side is read twice.

    A value's rows are dealt by their ids to chunks of about ``tile`` rows (``TILE`` by default) on both sides, and each
    chunk meets each of the other side: the rows shuffled are pairs over ``tile``, and no task is
    bound to a value.  ``weight``: how many rows a row of right stands for; a chunk of right is of
    ``HEAVY`` times ``tile`` of them, about, and one of left of as many rows at most, as far as a task has time for.
    """
    tile = tile or TILE
    heavy = F.lit(0) if weight is None else F.ceil(F.sum(weight) / (tile * HEAVY))
    own = [F.greatest(F.ceil(F.count("*") / tile), heavy).alias("n_right"), F.sum(F.lit(1) if weight is None else weight).alias("k_right")]
    sizes = left.groupBy(*on).agg(F.count("*").alias("k_left")).join(right.groupBy(*on).agg(*own), [*on])
    pairs = sizes.agg(F.sum(F.col("k_left").cast("double") * F.col("k_right"))).first()[0] or 0.0  # one number
    tasks = int(min(max(pairs // TASK_PAIRS, left.sparkSession.sparkContext.defaultParallelism if pairs > TASK_PAIRS // 50 else 1), TASKS))
    most = max(TASK_PAIRS, pairs / TASKS)
    chunks = sizes.select(*on, F.greatest(F.ceil(F.col("k_left") / (tile if weight is None else tile * HEAVY)), F.ceil(F.col("k_left") * 1.0 * F.col("k_right") / F.col("n_right") / most)).alias("n_left"), "n_right")
    keys = [*on, "chunk_left", "chunk_right"]

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        chunk = F.pmod(F.xxhash64(key), F.col(f"n_{own}")).alias(f"chunk_{own}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(f"chunk_{other}")
        return rows.join(chunks, [*on]).select(*rows.columns, chunk, every).repartition(tasks, *keys)

    return dealt(left, left_id, "left", "right"), dealt(right, right_id, "right", "left"), keys


def tiled(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, where: Column, how: str = "inner", tile: int | None = None, weight: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` by the columns ``on``, which may have few values, and a condition, in ``tiles``.

    A semi-join may give a row of left once for each chunk of right.
    """
    a, b, keys = tiles(left, right, on, left_id, right_id, tile, weight)
    a, b = a.alias("a"), b.hint("merge").alias("b")
    same = where
    for k in reversed(keys):
        same = (F.col(f"a.{k}") == F.col(f"b.{k}")) & same
    found = a.join(b, same, how)
    return found.select(*[F.col(f"a.{c}") for c in left.columns], *([F.col(f"b.{c}") for c in right.columns if c not in on] if how == "inner" else []))
