"""Mixing sources to target weights with DataFrame functions alone.

1. Sources' targets: shares by weight, each at most ``most_repeats`` times the source's
   size, the excess shared again; in closed form from sources sorted by cap over weight.
2. A source's documents stand in the order of a keyed hash on a line of words, cut into
   blocks of ``block_words``.  The mix draws ``target`` words: whole passes over all blocks,
   then blocks in a keyed permutation, the last one in part.
3. A splitting tree deals the numbers of blocks of all sources out among shards: a node's
   quotas go to its two children by a multivariate hypergeometric draw, one source after
   another, until each node is one shard.
4. A shard's draws of a source are consecutive places of the permutation, so shards are
   disjoint; within a shard spans are in the order of a keyed hash.

Offsets come from sums over cells of documents, so no source is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbin.llm.common import materialize, quoted, table, unused

BLOCK_WORDS = 1024
CELL_ROWS = 512
SHARDS = 64
#: Rows of a shard that are written together, about.
RANGE_ROWS = 20_000
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20240229


def uniform(*of: Column) -> Column:
    """A repeatable number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: Sequence[float], most_repeats: float) -> DataFrame:
    """``sizes(source, source_size)``, one row for each source, gets ``target double``.

    Source names are ranked by code point, null last, and take the weights in turn.  One
    row for each source goes to one task.
    """
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    # the words for each unit of weight if this and all later sources stay below their caps
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(W.partitionBy())
    return levels.withColumn("level", first_open["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def log_factorial(x: str) -> str:
    """ln x! by Stirling's series at x + 8 and the product below it; errors under 1e-13 of the value.  SQL, as are the next ones."""
    y = f"({x} + 8D)"
    below = " * ".join(f"({x} + {i}D)" for i in range(1, 9))
    return f"(({y} + 0.5D) * ln({y}) - {y} + 0.9189385332046728D + 1D / (12D * {y}) - 1D / (360D * power({y}, 3D)) + 1D / (1260D * power({y}, 5D)) - ln({below}))"


def log_choose(n: str, k: str) -> str:
    return f"({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')})"


def given(names: dict[str, str], then: str) -> str:
    """``then`` with v.name for each of names, computed once."""
    return f"transform(array(named_struct({', '.join(f"'{k}', {x}" for k, x in names.items())})), v -> {then})[0]"


def hypergeometric(u: str, total: str, marked: str, drawn: str) -> str:
    """Marked ones among ``drawn`` of ``total``: the least k whose distribution function exceeds u, summed over twelve deviations about the mean (all else is below 1e-30)."""
    mean = "v.d * v.m / greatest(v.t, 1D)"
    spread = f"(12D * sqrt(greatest({mean} * (1D - v.m / greatest(v.t, 1D)), 0D)) + 12D)"
    low, high = f"cast(greatest(0D, v.d + v.m - v.t, floor({mean} - {spread})) as bigint)", f"cast(least(v.m, v.d, ceil({mean} + {spread})) as bigint)"
    part = f"exp({log_choose('v.m', 'cast(k as double)')} + {log_choose('(v.t - v.m)', '(v.d - cast(k as double))')} - v.whole)"
    search = f"aggregate(sequence(v.low, v.high), named_struct('sum', 0D, 'at', v.low), (s, k) -> named_struct('sum', s.sum + {part}, 'at', if(s.sum <= v.u, k, s.at)), s -> s.at)"
    names = {"u": "v.u", "t": "v.t", "m": "v.m", "d": "v.d", "low": low, "high": high, "whole": log_choose("v.t", "v.d")}
    return given({"u": u, "t": f"cast({total} as double)", "m": f"cast({marked} as double)", "d": f"cast({drawn} as double)"}, given(names, search))


def split(node: str, quotas: str, left: str) -> str:
    """The left child's quotas: ``left`` blocks of the node's, by a multivariate hypergeometric draw."""
    u = f"shiftrightunsigned(xxhash64({SEED}, {node}, size(s.taken)), 11) / cast(1L << 53 as double)"
    one = given(
        {"s": "s", "q": "q", "k": hypergeometric(u, "s.total", "q", "s.left")},
        "named_struct('total', v.s.total - v.q, 'left', v.s.left - v.k, 'taken', concat(v.s.taken, array(v.k)))",
    )
    start = f"named_struct('total', aggregate({quotas}, 0L, (s, q) -> s + q), 'left', {left}, 'taken', cast(array() as array<bigint>))"
    return f"aggregate({quotas}, {start}, (s, q) -> {one}, s -> s.taken)"


def dealt(quotas: DataFrame, shards: int) -> DataFrame:
    """``quotas(quotas array<long>)``, one row of the blocks of each source, to ``(shard int, quotas array<long>)``; each level of the tree doubles the rows."""
    nodes = quotas.selectExpr("0 as first", f"{shards} as n", "quotas")
    for _ in range((shards - 1).bit_length()):
        # a child with k of n shards gets the blocks of its shards, which differ by one at most
        left = "cast(floor(aggregate(quotas, 0L, (s, q) -> s + q) * half / n) as bigint)"
        drawn = nodes.withColumn("half", F.expr("cast(floor(n / 2) as int)")).withColumn("taken", F.expr(f"if(n > 1, {split('first, n', 'quotas', left)}, quotas)"))
        children = """if(n > 1, array(named_struct('first', first, 'n', half, 'quotas', taken),
                                      named_struct('first', first + half, 'n', n - half, 'quotas', zip_with(quotas, taken, (q, k) -> q - k))),
                         array(named_struct('first', first, 'n', n, 'quotas', quotas)))"""
        nodes = drawn.select(F.explode(F.expr(children)).alias("c")).select("c.*")
    return nodes.selectExpr("first as shard", "quotas")


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def planned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_repeats: float = 3.0, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, key long, size, source, source_size, target, offset, draws)``, one row for each row of docs.

    offset is where the document's words stand on its source's line; draws is an array of
    ``(pass int, shard int, start long, end long)``: which of its words the mix takes, in
    which pass, for which shard.  Null and empty texts have no words and no draws; null
    sources are a source.  Repeated rows stand next to each other on the line.
    """
    sized = materialize(docs.select("doc_id", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"), size().alias("size"), "source"), "sizes")
    n_rows = sized.count()
    cells = max(1, -(-n_rows // CELL_ROWS))
    sized = sized.withColumn("cell", F.pmod("key", F.lit(cells)))
    sums = sized.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    group = F.floor(F.col("cell") / 256)
    groups = sums.groupBy("source", group.alias("group")).agg(F.sum("words").alias("words"))
    earlier = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("group_at", F.coalesce(F.sum("words").over(earlier(["source"], "group")), F.lit(0))).drop("words")
    cell_at = F.coalesce(F.sum("words").over(earlier(["source", "group"], "cell")), F.lit(0))
    starts = sums.withColumn("group", group).withColumn("cell_at", cell_at).alias("a").join(groups.alias("g"), F.expr("a.source <=> g.source and a.group = g.group")).select("a.source", "cell", (F.col("cell_at") + F.col("group_at")).alias("at"))
    # the plan of each source
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats)
    want = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("over", want - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block_words).cast("long"))
    plan = materialize(plan.withColumn("k", F.row_number().over(W.orderBy(F.asc_nulls_last("source")))), "mix-plan")  # one row for each source
    quotas = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda x: x["quota"]).alias("quotas"))
    tree = dealt(quotas, shards)
    ends = tree.select("shard", F.posexplode("quotas").alias("k", "n")).withColumn("end", F.sum("n").over(W.partitionBy("k").orderBy("shard")))
    ends = ends.groupBy((F.col("k") + 1).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    plan = materialize(plan.join(ends, "k"), "mix-shards")
    place = F.coalesce(F.sum("size").over(W.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("place", place).alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.cell = s.cell"))
    placed = placed.select("doc_id", "key", "size", "d.source", (F.col("place") + F.col("at")).alias("offset")).alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
    return placed.select("doc_id", "key", "size", "d.source", "source_size", "target", "offset", draws(block_words).alias("draws"))


def draws(block_words: int) -> Column:
    """What the mix takes of a document of size at offset, by its source's plan."""
    offset, size, blocks = F.col("offset"), F.col("size"), F.col("blocks")
    first, last = F.floor(offset / block_words).cast("long"), F.floor((offset + size - 1) / block_words).cast("long")

    def taken(p: Column, b: Column) -> Column:
        # the last block of a source may be short, so it stays last; the others are turned by a keyed amount and stride
        full = F.greatest(blocks - 1, F.lit(1))
        turn = F.pmod(F.xxhash64(F.lit(SEED), F.col("k"), p), full)
        stride = F.element_at(F.array(*[F.lit(x) for x in STRIDES]), (F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("k"), p), F.lit(len(STRIDES))) + 1).cast("int"))
        place = F.when(b >= blocks - 1, blocks - 1).otherwise(F.pmod(F.pmod(b * F.when(full % stride == 0, F.lit(1)).otherwise(stride), full) + turn, full))
        limit = F.when(p < F.col("passes"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("over") - place * block_words))
        start, end = F.greatest(offset, b * block_words), F.least(offset + size, b * block_words + limit)
        shard = F.size(F.filter("ends", lambda e: e <= p * blocks + place))
        return F.struct(p.cast("int").alias("pass"), shard.alias("shard"), (start - offset).alias("start"), (end - offset).alias("end"))

    each = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.transform(F.sequence(first, last), lambda b: taken(p, b))))
    none = F.array().cast("array<struct<pass:int,shard:int,start:bigint,end:bigint>>")
    return F.when(size > 0, F.filter(each, lambda x: x["end"] > x["start"])).otherwise(none)


#: Primes, so a stride and a number of blocks that it does not divide have no common factor.
STRIDES = (1000003, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return planned(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: whole documents, each as often as the mix takes it, shuffled within their shards.

    A pass takes a document if it takes the word at a keyed place of it, so that a source
    gets its words in the mean whatever its documents' lengths.  Documents without words
    stay as they are.  Repeated rows are drawn each for itself, null sources are a source,
    and an empty table stays empty.  A shard is written as consecutive ranges of its keyed
    order, and there are as many tasks as RANGE_ROWS rows each need, so no task grows with
    the corpus.
    """
    row, draw = unused("mix row", docs.columns), unused("mix draw", docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows", "zstd")
    own = rows.select(F.col(row).alias("doc_id"), "text", "source")
    plan = planned(own)
    word = F.floor(uniform(F.col("key")) * F.col("size")).cast("long")
    copies = F.filter("draws", lambda x: (x["start"] <= word) & (word < x["end"]))
    empty = F.array(F.struct(F.lit(0).alias("pass"), F.lit(0).alias("shard")))
    chosen = plan.select(F.col("doc_id").alias(row), F.explode(F.when(F.col("size") > 0, F.transform(copies, lambda x: F.struct(x["pass"], x["shard"]))).otherwise(empty)).alias("d"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), row, "d.pass"), 1)
    n_rows = rows.count()
    ranges, tasks = max(1, -(-n_rows // (SHARDS * RANGE_ROWS))), max(1, -(-n_rows // RANGE_ROWS))
    chosen = chosen.select(row, F.struct(F.col("d.shard"), F.floor(place / F.lit((1 << 63) / ranges)).alias("range"), place.alias("place")).alias(draw))
    out = rows.join(chosen, row).repartition(tasks, F.col(f"{draw}.shard"), F.col(f"{draw}.range"))
    return out.sortWithinPartitions(f"{draw}.shard", f"{draw}.place", row).select(*[F.col(quoted(c)) for c in docs.columns])
