"""Clusters of several species against a sequential pass over one cluster after another."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_binning import genome
from test_occupancy import sequential

from quillbin.functions.sequences import FOURMERS, zscores_of
from quillbin.operators import composition, markers, splitting

LARGE, SAMPLES = 10_000, (1, 2)
SD1 = {1: 0.1, 2: 0.12}
SMEAN, SSD = 0.6, 0.13


def counts(*texts):
    n = {}
    for s in texts:
        for k in (2, 3, 4):
            for i in range(len(s) - k + 1):
                n[s[i : i + k]] = n.get(s[i : i + k], 0) + 1
    return n


class Slow:
    def __init__(self, seq, depth, genes, scores, intervals, first, fixed, least):
        self.seq, self.depth, self.scores, self.intervals, self.first, self.fixed, self.least = seq, depth, scores, intervals, first, fixed, least
        self.genes = {}
        for g, i in genes:
            self.genes.setdefault(i, set()).add(g)
        own = [i for i in sorted(self.genes) if len(self.genes[i]) > 1]
        self.dups = {(a, b) for a in own for b in own if a < b and len(self.genes[a] & self.genes[b]) > 1}

    def vector(self, ids):
        z = zscores_of(counts(*[self.seq[i] for i in ids]))
        return z - z.mean()

    def cor(self, x, y):
        d = math.sqrt((x @ x) * (y @ y))
        return float(x @ y / d) if d else 0.0

    def p(self, cor):
        return 0.5 * math.erfc(-(cor - SMEAN) / SSD / math.sqrt(2))

    def logs(self, ids):
        n = counts(*[self.seq[i] for i in ids])
        total = sum(n.get(k, 0) for k in FOURMERS)
        return {k: math.log10(n.get(k, 1) / total) for k in FOURMERS}

    def score(self, i, logs):
        n = counts(self.seq[i])
        return sum(n.get(k, 0) * logs[k] for k in FOURMERS) * 500 / len(self.seq[i])

    def packs(self, cl, ids):
        own = sorted((i for i in ids if len(self.seq[i]) < LARGE), key=lambda i: (-self.scores[cl, i], i))
        out = set()
        for k, a in enumerate(own):
            members, total = [a], len(self.seq[a])
            for b in own[k + 1 :]:
                good = True
                for s in SAMPLES:
                    hi, lo = max(self.depth[a, s], self.depth[b, s]), min(self.depth[a, s], self.depth[b, s])
                    good &= hi < 5 or int(hi * (1 - SD1[s])) <= lo <= int(hi * (1 + SD1[s])) + 1
                if good:
                    if int(abs(self.scores[cl, a] - self.scores[cl, b])) > 7:
                        break
                    members.append(b)
                    total += len(self.seq[b])
                    if total >= LARGE:
                        out.add(";".join(members))
                        break
        return out

    def fits(self, i, sub, cl, wildcard=True, open_end=False):
        for s in SAMPLES:
            if wildcard and self.mean[sub, s] < 5:
                continue
            lo, hi = self.intervals[cl, s][1:]
            if not (lo <= self.depth[i, s] and (self.depth[i, s] < hi if open_end else self.depth[i, s] <= hi)):
                return False
        return True

    def split(self, cl, members, result):
        n = {}
        for i in members:
            for g in self.genes.get(i, ()):
                n[g] = n.get(g, 0) + 1
        hist = {}
        for k in n.values():
            hist[k] = hist.get(k, 0) + 1
        species = max((k for k, m in hist.items() if m > self.least), default=0)
        if species < 2:
            result.update({i: cl for i in members})
            return None
        tagged = {i for i in members if any(n[g] > 1 for g in self.genes.get(i, ()))}
        core = {i for i in members if i in self.fixed or (i in self.genes and i not in tagged)}
        inside = [i for i in sorted(members) if i not in core]
        cand = ({i for i in inside if len(self.seq[i]) >= LARGE} | self.packs(cl, inside)) - {cl}
        stand = {c: {*c.split(";")} for c in cand} | {cl: core | {*cl.split(";")}}
        vec = {c: self.vector(sorted(x)) for c, x in stand.items()}
        chosen = [cl]
        while len(chosen) < species and cand:
            best = min(sorted(cand), key=lambda c: (sum(self.p(self.cor(vec[c], vec[k])) for k in chosen), c))
            chosen.append(best)
            cand.discard(best)
        self.mean = {(cl, s): self.intervals[cl, s][0] for s in SAMPLES}
        for c in chosen[1:]:
            own = c.split(";")
            for s in SAMPLES:
                m = sum(self.depth[i, s] * len(self.seq[i]) for i in own) / sum(len(self.seq[i]) for i in own)
                self.mean[c, s] = int(m) if len(own) > 1 else self.depth[own[0], s]
        logs = {c: self.logs(sorted(stand[c])) for c in chosen}
        dup_ids = {i for pair in self.dups for i in pair}
        long, short = {}, {}
        for i in tagged - core:
            wild = len(self.seq[i]) >= LARGE or i not in dup_ids
            of = [c for c in chosen if self.fits(i, c, cl, wildcard=wild)]
            if len(self.seq[i]) >= LARGE:
                cors = {c: self.cor(self.vector([i]), vec[c]) for c in of}
                long[i] = {c: (self.p(x), x) for c, x in cors.items()}
            else:
                short[i] = {c: (self.score(i, logs[c]), 0.0) for c in of}
        genes = {i: sorted(self.genes[i]) for i in tagged - core}
        got = sequential(long, short, genes, {(a, b) for a, b in self.dups if a in genes and b in genes})
        has = {c: {i for i, s in got.items() if s == c} | (core if c == cl else set()) for c in chosen}
        for c in chosen:
            if sum(len(self.seq[i]) for i in has[c]) < LARGE:
                has[c] |= {*c.split(";")}
        vec, logs = {c: self.vector(sorted(has[c])) for c in chosen}, {c: self.logs(sorted(has[c])) for c in chosen}
        result.update({i: cl for i in core} | got)
        for i in inside:
            if i in tagged:
                continue
            if len(self.seq[i]) >= LARGE:
                of = [c for c in chosen if self.fits(i, c, cl)]
                x = self.vector([i])
                key = lambda c, x=x: (-self.p(self.cor(x, vec[c])), -self.cor(x, vec[c]), c)
            else:
                of = [c for c in chosen if self.fits(i, c, cl, open_end=True)] or [c for c in chosen if c == self.first]
                key = lambda c, i=i: (-self.score(i, logs[c]), c)
            if of:
                result[i] = min(of, key=key)
        return chosen


def made_up(rnd):
    """Clusters whose second species has short sequences only, one of a single species, some sequences out of reach, and a fixed one."""
    seq, depth, genes, scores, intervals, assigned, fixed = {}, {}, [], {}, {}, {}, {}
    for c in range(4):
        cl, mean = f"c{c}_0_0", {1: 30.0 + 20 * c, 2: 3.0 if c == 2 else 18.0}
        for g in range(2):
            whole = genome(rnd, 70_000)
            sizes = ([14_000, 12_000, 11_000, 6_000, 4_000, 3_000, 2_500] if g == 0 else [5_200, 4_800, 6_100, 3_000, 2_500, 2_000, 1_500, 900])
            at = 0
            for k, n in enumerate(sizes):
                i = f"c{c}_{g}_{k}"
                seq[i] = whole[at : at + n]
                at += n
                assigned[i] = cl
                for s in SAMPLES:
                    depth[i, s] = round(mean[s] * rnd.uniform(0.93, 1.06), 2)
                if c != 3 or g == 0:
                    genes += [(f"gene{x}", i) for x in range(9) if x % 4 == k - (1 if g == 0 else 0)]
        odd = f"c{c}_0_6"
        depth[odd, 1] = mean[1] * 3  # out of the interval
        genes.append((f"extra{c}", f"c{c}_0_5"))  # once only: core
        for s in SAMPLES:
            intervals[cl, s] = (mean[s], int(mean[s] * 0.7), int(mean[s] * 1.3) + 1)
        fixed[f"c{c}_0_4"] = cl
    own = Slow(seq, depth, genes, {}, intervals, "c1_0_0", fixed, 7)
    for i, cl in assigned.items():
        scores[cl, i] = round(own.score(i, own.logs([cl])), 6)
    own.scores = scores
    return own, assigned, genes


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_one_cluster_after_another(spark, seed):
    own, assigned, genes = made_up(random.Random(seed))
    want, chosen = {}, {}
    for cl in sorted({*assigned.values()}):
        chosen[cl] = own.split(cl, [i for i in assigned if assigned[i] == cl], want)
    assert any(";" in c for x in chosen.values() if x for c in x), "a pack is a seed"
    assert [x for x in chosen.values() if x is None] == [None]
    sequences = spark.createDataFrame([(i, s, len(s)) for i, s in own.seq.items()], "id string, seq string, length long")
    depth = spark.createDataFrame([(i, s, m, [m]) for (i, s), m in own.depth.items()], "id string, sample int, mean double, windows array<double>")
    cover = splitting.Cover(
        depth,
        spark.createDataFrame([(s, x, x * 1.5) for s, x in SD1.items()], "sample int, sd1 double, sd2 double"),
        spark.createDataFrame([(cl, s, *x) for (cl, s), x in own.intervals.items()], "seed string, sample int, mean double, lo long, hi long"),
        spark.createDataFrame([(i, cl, x) for (cl, i), x in own.scores.items() if len(own.seq[i]) < LARGE], "id string, seed string, score double"),
        own.first,
        spark.createDataFrame([*own.fixed.items()], "id string, seed string"),
    )
    table = [(a, b, SMEAN, SSD, 0.2, 0.15, 0.5, 0.55) for a in range(0, 220, 10) for b in range(0, 220, 10)]
    cutoffs = spark.createDataFrame(table, "len1 int, len2 int, smean double, ssd double, dmean double, dsd double, diff double, cutoff double")
    own_genes = spark.createDataFrame(genes, "gene string, id string").distinct()
    assert {(r["a"], r["b"]) for r in markers.duplicates(own_genes).collect()} == own.dups
    out = splitting.split_clusters(spark.createDataFrame([*assigned.items()], "id string, seed string"), own_genes, sequences.select("id", "length"), composition.counted(sequences).checkpoint(), cutoffs, 7, LARGE, cover).collect()
    assert len(out) == len({r["id"] for r in out})
    assert {r["id"]: r["seed"] for r in out} == want
    assert np.mean([i in want for i in assigned]) < 1, "what fits no seed leaves"
