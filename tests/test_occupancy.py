"""Waves of marker sequences against one sequential pass in the order of ids."""

from __future__ import annotations

import random

from quillbin.operators import occupancy

CASES = 50


def case(rnd: random.Random):
    n, seeds = rnd.randint(4, 22), [f"s{i}" for i in range(rnd.randint(2, 5))]
    genes = {f"m{i:02d}": sorted(rnd.sample([f"g{k}" for k in range(rnd.choice([4, 9]))], rnd.randint(1, 4))) for i in range(n)}
    dups = {(a, b) for a in genes for b in genes if a < b and len({*genes[a]} & {*genes[b]}) >= 2 and rnd.random() < 0.8}
    value = lambda: rnd.choice([0.2, 0.5, 0.9, 1.0]) if rnd.random() < 0.5 else rnd.random()
    long, short = {}, {}
    for i in genes:
        own = rnd.sample(seeds, rnd.choice([0, 1, 2, len(seeds), len(seeds)]) if len(seeds) > 1 else 1)
        if rnd.random() < 0.5:
            long[i] = {s: (value(), rnd.random()) for s in own}
        else:
            short[i] = {s: (-600.0 + rnd.choice([0, 3, 6, 6, 7, 20]) + rnd.random(), 0.0) for s in own}
    return long, short, genes, dups


def sequential(long, short, genes, dups):
    """The rules one after another, a loop for each phase, ids in order."""
    both = {i: set() for i in genes}
    for a, b in dups:
        both[a].add(b)
        both[b].add(a)
    taken, has, shut = {}, set(), set()

    def take(i, s, genes_too=True):
        taken[i] = s
        if genes_too:
            has.update((g, s) for g in genes[i])
        shut.update((d, s) for d in both[i])

    def best(cand, of):
        return min(of, key=lambda s: (-cand[s][0], -cand[s][1], s))

    def free(i, s, is_short):
        k = sum((g, s) in has for g in genes[i])
        return k < 2 and not (is_short and k == len(genes[i]))

    twice = [{i: c for i, c in kind.items() if both[i] and c} for kind in (long, short)]
    for kind in twice:
        for i, c in sorted(kind.items()):
            if len(c) == 1:
                take(i, *c)
    for kind in twice:
        left = {i: c for i, c in kind.items() if len(c) > 1}
        while left:
            proposed = {}
            for i, c in sorted(left.items()):
                of = [s for s in c if (i, s) not in shut]
                if len(of) < 2:
                    take(i, best(c, of or c))
                else:
                    s = best(c, of)
                    proposed.setdefault(s, []).append((-c[s][0], i))
            for s in proposed:
                for _, i in sorted(proposed[s]):
                    if (i, s) not in shut:
                        take(i, s)
            left = {i: c for i, c in left.items() if i not in taken}
    for i, c in sorted(long.items()):
        if both[i] or not c:
            continue
        of = [s for s in c if free(i, s, False)] or [*c]
        if len(c) == 1:
            take(i, *c, genes_too=False)
        else:
            take(i, best(c, of), genes_too=len(of) == 1)
    off = {}

    def pick(i, c):
        """Takes a sequence unless it is ambiguous; then its free seeds and the best of them."""
        of = [s for s in c if free(i, s, True)]
        s = best(c, of or c)
        if len(of) > 1 and any(c[s][0] - c[o][0] < 7 for o in of if o != s):
            return of, s
        take(i, s)
        return None

    for i, c in sorted(short.items()):
        if not both[i] and c and (got := pick(i, c)):
            off[i] = {s: c[s] for s in got[0]}
    while off:
        proposed = {}
        for i, c in sorted(off.items()):
            if got := pick(i, c):
                proposed.setdefault(got[1], []).append((-c[got[1]][0], i))
        for s in proposed:
            for _, i in sorted(proposed[s]):
                if free(i, s, True):
                    take(i, s)
        off = {i: c for i, c in off.items() if i not in taken}
    return taken


def test_same_as_one_after_another(spark):
    """All cases at once, each with ids and seeds of its own."""
    rnd = random.Random(31)
    long, short, genes, dups, want = [], [], [], [], {}
    for k in range(CASES):
        own = case(rnd)
        mark = lambda x, k=k: f"{k:02d}/{x}"
        for rows, kind in ((long, own[0]), (short, own[1])):
            rows += [(mark(i), mark(s), *v) for i, c in kind.items() for s, v in c.items()]
        genes += [(mark(g), mark(i)) for i, gs in own[2].items() for g in gs]
        dups += [(mark(a), mark(b)) for a, b in own[3]]
        want |= {mark(i): mark(s) for i, s in sequential(*own).items()}
    columns = "id string, seed string, value double, tie double"
    got = occupancy.assign_markers(spark.createDataFrame(long, columns), spark.createDataFrame(short, columns), spark.createDataFrame(genes, "gene string, id string"), spark.createDataFrame(dups, "a string, b string")).collect()
    assert len(got) == len(want)
    assert {r["id"]: r["seed"] for r in got} == want


def test_no_candidates(spark):
    none = spark.createDataFrame([], "id string, seed string, value double, tie double")
    assert occupancy.assign_markers(none, none, spark.createDataFrame([("g", "x")], "gene string, id string"), spark.createDataFrame([], "a string, b string")).count() == 0


def test_the_last_free_seed_of_a_long_one_gets_its_genes(spark):
    """Only then do later ones see them."""
    columns = "id string, seed string, value double, tie double"
    rows = [("a", "s", 0.9, 0.0), ("b", "s", 0.9, 0.0), ("b", "t", 0.1, 0.0), ("c", "s", 0.9, 0.0), ("c", "t", 0.1, 0.0)]
    genes = [(g, i) for i in "abc" for g in ("g", "h")]
    got = occupancy.assign_markers(spark.createDataFrame(rows, columns), spark.createDataFrame([], columns), spark.createDataFrame(genes, "gene string, id string"), spark.createDataFrame([("x", "y")], "a string, b string"))
    assert {r["id"]: r["seed"] for r in got.collect()} == {"a": "s", "b": "s", "c": "s"}
