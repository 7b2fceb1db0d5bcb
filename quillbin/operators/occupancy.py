"""Assignment of marker sequences to seeds under copy-number rules.

A seed should not get two sequences that share marker genes.  Sequences are taken in three
phases over one state: those that have duplicates (long, then short), then the other long
ones, then the other short ones, of which the ambiguous are put off until nothing else is
left.  Within a phase the result is that of taking one sequence after another in the order
of ids, but the work is done in waves: whoever no earlier open sequence can influence, for
want of a common seed with a common gene that the seed does not have yet, is decided at
once with all others like it.  A gene that a seed has keeps no one waiting.

Candidates are ``(id, seed, value, tie)``: of the allowed seeds that with the greatest value
is best, then the one with the greatest tie, then the first by name; no value is the least.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbin.operators.naive_bayes import MARGIN
from quillbin.operators.seeds import leaders
from quillbin.operators.shared import shared_folder

#: A seed that has so many of a sequence's genes is not allowed.
MOST_PRESENT = 2


@dataclass(frozen=True)
class State:
    """taken(id, seed); occupied(gene, seed): genes that seeds have; excluded(id, seed): where a duplicate is.

    genes(gene, id), duplicates(a, b): both ways; all are written in the shared folder.
    """

    genes: DataFrame
    duplicates: DataFrame
    taken: DataFrame
    occupied: DataFrame
    excluded: DataFrame

    @classmethod
    def empty(cls, genes: DataFrame, duplicates: DataFrame, like: DataFrame) -> State:
        both = duplicates.select("a", "b").unionByName(duplicates.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
        none = like.select("id", "seed").limit(0).checkpoint()
        own = genes.select("gene", "id").distinct().checkpoint()
        return cls(own, both, none, none.join(own, "id").select("gene", "seed").checkpoint(), none)

    def with_taken(self, new: DataFrame, occupies: DataFrame | None = None) -> State:
        """After ``new(id, seed)`` were taken; ``occupies``: those of them whose genes the seeds have from now on, all if not given."""
        own = new.select("id", "seed").checkpoint()
        seen = own if occupies is None else occupies.select("id", "seed")
        occupied = self.occupied.unionByName(seen.join(self.genes, "id").select("gene", "seed")).distinct().checkpoint()
        excluded = self.excluded.unionByName(own.join(self.duplicates, own["id"] == self.duplicates["a"]).select(F.col("b").alias("id"), "seed")).distinct().checkpoint()
        return replace(self, taken=self.taken.unionByName(own).checkpoint(), occupied=occupied, excluded=excluded)

    def by_genes(self, rows: DataFrame, short: bool) -> DataFrame:
        """Adds ``free``, whether a seed has few enough of a sequence's genes (of a short one not all, however few), and ``waits``, whether an earlier open sequence may yet give it another one."""
        cells = rows.select("id", "seed", "rank").join(self.genes, "id").join(self.occupied.withColumn("there", F.lit(True)), ["gene", "seed"], "left")
        first = cells.where("there is null").groupBy("gene", "seed").agg(F.min("rank").alias("first"))
        each = cells.join(first, ["gene", "seed"], "left").groupBy("id", "seed").agg(F.count("there").alias("present"), F.count("*").alias("own"), F.max(F.col("there").isNull() & (F.col("first") < F.col("rank"))).alias("waits"))
        few = F.col("present") < MOST_PRESENT
        free = few & (F.col("present") != F.col("own")) if short else few
        return rows.join(each.select("id", "seed", free.alias("free"), "waits"), ["id", "seed"], "left").na.fill({"free": True, "waits": False})

    def by_duplicates(self, rows: DataFrame) -> DataFrame:
        """The same for sequences with duplicates: a seed with a duplicate is not free, and earlier open duplicates with a common seed are waited for."""
        other = rows.select(F.col("id").alias("b"), "seed", F.col("rank").alias("other"))
        waits = rows.select("id", "seed", "rank").join(self.duplicates, F.col("id") == F.col("a")).join(other, ["b", "seed"]).where(F.col("other") < F.col("rank")).select("id", "seed", F.lit(True).alias("waits")).distinct()
        out = rows.join(waits, ["id", "seed"], "left").join(self.excluded.withColumn("free", F.lit(False)), ["id", "seed"], "left")
        return out.na.fill({"free": True, "waits": False})


def ranked(rows: DataFrame, by: Column | None = None) -> DataFrame:
    """Adds the order in which sequences are taken: by a number, then by id."""
    return rows.withColumn("rank", F.struct((F.lit(0.0) if by is None else by).alias("number"), F.col("id").alias("name")))


def choices(rows: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Of ``(id, seed, value, tie, free, waits)`` the sequences that need not wait: ``(id, seed, value, n, close, options)``.

    n: free seeds; seed: the best of these, or of all if there is none; close: whether the
    value of another one of them is less than ``margin`` below it; options: the free seeds.
    """
    best = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("less"), (-F.col("tie")).alias("tie"), "seed", "free", "waits")))  # as many as seeds
    each = rows.groupBy("id").agg(best.alias("all")).withColumn("open", F.filter("all", lambda x: x["free"]))
    own = each.withColumn("of", F.when(F.size("open") > 0, F.col("open")).otherwise(F.col("all"))).where(~F.exists("of", lambda x: x["waits"]))
    top, next_ = F.col("of")[0], F.try_element_at("of", F.lit(2))
    close = F.coalesce(next_["less"] - top["less"] < margin, F.lit(False))
    return own.select("id", top["seed"].alias("seed"), (-top["less"]).alias("value"), F.size("open").alias("n"), close.alias("close"), F.transform("open", lambda x: x["seed"]).alias("options"))


def less(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("id").distinct(), "id", "left_anti").checkpoint()


def joined(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def numbers(rows: DataFrame) -> DataFrame:
    """Adds ``of``, the seeds of a sequence."""
    return rows.join(rows.groupBy("id").agg(F.count("*").alias("of")), "id")


def take_duplicates(state: State, rows: DataFrame, max_rounds: int) -> State:
    """Sequences with duplicates and several seeds, in rounds: those with one seed left, or none, are taken in order; the others are proposed to their best one, which takes them by value unless it has a duplicate by then."""
    left = ranked(rows).checkpoint()
    for _ in range(max_rounds):
        if left.isEmpty():
            return state
        open_rows, proposed = left, []
        while not open_rows.isEmpty():
            now = choices(state.by_duplicates(open_rows)).checkpoint()
            state = state.with_taken(now.where("n < 2"))
            proposed.append(now.where("n > 1").select("id", "seed", "value"))
            open_rows = less(open_rows, now)
        own = joined(proposed).join(state.excluded, ["id", "seed"], "left_anti").checkpoint()
        nodes = ranked(own, -F.col("value"))
        pairs = own.select(F.col("id").alias("a"), "seed").join(state.duplicates, "a").join(own.select(F.col("id").alias("b"), "seed"), ["b", "seed"]).select("a", "b")
        accepted = own.join(leaders(nodes.select("id", "rank"), pairs), "id", "left_semi")
        state = state.with_taken(accepted)
        left = less(left, state.taken)
    raise RuntimeError(f"sequences with duplicates are still open after {max_rounds} rounds")


def take_long(state: State, rows: DataFrame) -> State:
    """Long sequences without duplicates: of several seeds the best free one; only one that is the last free one gets their genes."""
    several = numbers(rows)
    state = state.with_taken(several.where("of = 1"), occupies=state.taken.limit(0))
    left = ranked(several.where("of > 1").drop("of")).checkpoint()
    while not left.isEmpty():
        now = choices(state.by_genes(left, short=False)).checkpoint()
        state = state.with_taken(now, occupies=now.where("n = 1"))
        left = less(left, now)
    return state


def in_waves(state: State, rows: DataFrame) -> tuple[State, DataFrame | None]:
    """Short sequences in order; those with several close free seeds are not taken but returned with these as ``options``."""
    left, close = ranked(rows).checkpoint(), []
    while not left.isEmpty():
        now = choices(state.by_genes(left, short=True)).checkpoint()
        put_off = F.col("close") & (F.col("n") > 1)
        state = state.with_taken(now.where(~put_off))
        close.append(now.where(put_off))
        left = less(left, now)
    return state, joined(close)


def accept(state: State, proposed: DataFrame) -> State:
    """Proposals ``(id, seed, value)``: each seed takes them by value as long as it has few enough of their genes."""
    left = ranked(proposed.withColumn("tie", F.lit(0.0)), -F.col("value")).checkpoint()
    while not left.isEmpty():
        judged = state.by_genes(left, short=True).checkpoint()
        ready = judged.where("not free or not waits")  # a seed that is not free will never be
        state = state.with_taken(ready.where("free"))
        left = less(left, ready)
    return state


def take_short(state: State, rows: DataFrame, max_rounds: int) -> State:
    """Short sequences without duplicates; ambiguous ones are put off, and then proposed to their best seeds, in rounds until all are taken."""
    state, close = in_waves(state, rows)
    if close is None:
        return state
    left = rows.join(close.select("id", F.explode("options").alias("seed")), ["id", "seed"], "left_semi").checkpoint()
    for _ in range(max_rounds):
        if left.isEmpty():
            return state
        state, close = in_waves(state, left)
        state = accept(state, close.select("id", "seed", "value").checkpoint())
        left = less(left, state.taken)
    raise RuntimeError(f"ambiguous sequences are still open after {max_rounds} rounds")


def assign_markers(long: DataFrame, short: DataFrame, genes: DataFrame, duplicates: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(id, seed)``, one row for each id with a candidate.

    long, short: candidates ``(id, seed, value, tie)`` of long and short sequences;
    genes(gene, id), of which every sequence has one at least; duplicates(a, b).
    """
    shared_folder(long.sparkSession)
    least = lambda df: df.select("id", "seed", F.coalesce(F.col("value").cast("double"), F.lit(float("-inf"))).alias("value"), F.coalesce(F.col("tie").cast("double"), F.lit(0.0)).alias("tie"))
    long, short = least(long).checkpoint(), least(short).checkpoint()
    state = State.empty(genes, duplicates, long)
    named = state.duplicates.select(F.col("a").alias("id")).distinct()
    twice = [numbers(df.join(named, "id", "left_semi")).checkpoint() for df in (long, short)]
    # where there is one seed only, the order is all the same
    state = state.with_taken(joined([df.where("of = 1").select("id", "seed") for df in twice]))
    for df in twice:
        state = take_duplicates(state, df.where("of > 1").drop("of"), max_rounds)
    state = take_long(state, long.join(named, "id", "left_anti"))
    return take_short(state, short.join(named, "id", "left_anti"), max_rounds).taken
