"""Shared helpers: the cluster's shared folder, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.files import remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Freed memory to the system: workers wait for later tasks, beside executors that need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back at the end."""

    def run(parts: Iterator) -> Iterator:
        try:
            yield from task(parts)
        finally:
            give_back()

    return run


def quoted(column: str) -> str:
    """A column's name as it stands, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and one machine does all the work, as in tests."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster's machines share")
        at = tempfile.mkdtemp(prefix="quillbin-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    at = fresh_dir(spark, name)
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(table: DataFrame) -> None:
    """Removes a table of ``materialize`` that nothing will read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """For small state: a reliable checkpoint in the shared folder.

    Spark removes it with the last reference to it if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else it stays.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the least node reachable.

    Each round sends every node to its least neighbour (or itself) and contracts the
    graph along that map, so a round at least halves the nodes of every component that
    is left.  Only joins and partial aggregates; nothing is gathered per component.
    Nodes without an edge to another node have no row.
    """
    edges = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = checkpoint(both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")))
        maps.append(step)
        moved = edges.join(step.withColumnsRenamed({"node": "a", "to": "ta"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "tb"}), "b").where("ta <> tb")
        edges = checkpoint(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop().withColumnRenamed("to", "root")
    while maps:
        out = maps.pop().join(out.select(F.col("node").alias("to"), F.col("root").alias("r")), "to", "left").select("node", F.coalesce("r", "to").alias("root"))
    return out
