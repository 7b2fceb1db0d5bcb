"""Scan for secrets: fixed patterns, and formats learned from what these find.

Every text is read once.  What the patterns find is a labelled credential of its kind; other
long runs of letters that a credential may have are candidates.  A bounded sample of each
kind becomes an automaton (see ``grammars``), and so do the sampled candidates that are not
typical of a kind, as those may be secrets that no pattern knows.  A candidate is a secret if
the automaton of a kind explains it far better than that of the candidates.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillbin.llm.common import lean, materialize, table
from quillbin.llm.grammars import SYMBOL, Automaton, inferred

# The kinds in their order, with pattern, the group whose length counts, and the least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The kind of added spans, after the others.
FORMAT = "format"
NAMES = (*KINDS, FORMAT)
#: Letters of a candidate at least; its ends are cut where they are marks of a sentence.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST, MARKS = 16, ".-_/"
#: Most strings of a kind that an automaton is learned from, those with the least hashes, and most letters of such a string.
SAMPLE, LETTERS = 2_000, 256
#: How much likelier a candidate is as a credential than as another candidate, as a logarithm.
MARGIN = math.log(100)
#: Deviations from a kind's mean rate within which a string is typical of it.
TYPICAL = 2.5
#: Part of a kind's strings that may lack a class which the kind needs.
FEW = 0.01

FOUND = "kinds array<int>, starts array<long>, ends array<long>, values array<string>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the fixed patterns, by start and kind."""
    out = []
    for k, (pattern, group, least) in enumerate(KINDS.values()):
        out += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs that no span of ``base`` touches, in the same form, with the kind after the last."""
    out, k = [], len(KINDS)
    for m in CANDIDATE.finditer(text):
        value = m[0].strip(MARKS)
        if len(value) >= LEAST:
            start = m.start() + m[0].index(value)
            if not any(a < start + len(value) and b > start for a, _, b, _ in base):
                out.append((start, k, start + len(value), value))
    return out


def found(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, FOUND)``, a row for each row: base spans, then candidates; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                each = []
                for t in some.column(1):
                    text = t.as_py() or ""
                    base = base_spans(text)
                    each.append(base + candidates(text, base))
                lists = [pa.array([[s[k] for s in own] for own in each], pa.list_(kind)) for k, kind in ((1, pa.int32()), (0, pa.int64()), (2, pa.int64()), (3, pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column(0), *lists], ["doc_id", "kinds", "starts", "ends", "values"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, {FOUND}")


class Format(NamedTuple):
    """The automaton of a kind, the mean and the deviation, for one letter, of its strings' rates, and the classes of letters that all but a few of them have."""

    automaton: Automaton
    mean: float
    spread: float
    needed: frozenset[str]

    @classmethod
    def of(cls, strings: list[str]) -> Format:
        own = inferred(strings)
        rate, n = np.array([own.rate(s) for s in strings]), np.array([len(s) for s in strings])
        mean = float(np.average(rate, weights=n))
        has = Counter(c for s in strings for c in {*s.translate(SYMBOL)})
        return cls(own, mean, max(math.sqrt(float((n * (rate - mean) ** 2).mean())), 1e-3), frozenset(c for c, k in has.items() if k >= (1 - FEW) * len(strings)))

    def whole(self, value: str) -> bool:
        return self.needed <= {*value.translate(SYMBOL)}

    def typical(self, value: str) -> bool:
        """Whether no needed class is missing, and classes follow each other as in the kind's strings, neither too unlikely nor too likely."""
        return self.whole(value) and abs(self.automaton.rate(value) - self.mean) * math.sqrt(len(value)) <= TYPICAL * self.spread


class Formats(NamedTuple):
    """The formats of the kinds that were seen, and the automaton of other candidates."""

    kinds: list[Format]
    other: Automaton | None

    def gain(self, value: str) -> float:
        """How much likelier a string is by the best kind than by the candidates, as a logarithm; without both nothing is likely.

        Kinds that need a class which the string lacks do not count: a number is no hexadecimal key.
        """
        own = [f.automaton.likelihood(value) for f in self.kinds if f.whole(value)]
        return max(own) - self.other.likelihood(value) if own and self.other is not None else -math.inf


def learned(spans: DataFrame, sample: int = SAMPLE, letters: int = LETTERS) -> Formats:
    """From ``(FOUND)``: of each kind at most ``sample`` distinct strings, of at most ``letters`` letters each, reach the driver."""
    each = spans.select(F.explode(F.arrays_zip("kinds", "values")).alias("s")).select(F.col("s.kinds").alias("kind"), F.col("s.values").alias("value"))
    distinct = each.where(F.length("value") <= letters).distinct()
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    own: dict[int, list[str]] = {k: [] for k in range(len(KINDS) + 1)}
    for r in distinct.withColumn("n", place).where(F.col("n") <= sample).select("kind", "value").collect():
        own[r["kind"]].append(r["value"])
    kinds = [Format.of(own[k]) for k in range(len(KINDS)) if own[k]]
    return Formats(kinds, inferred(v for v in own[len(KINDS)] if not any(f.typical(v) for f in kinds)))


def scanned(spans: DataFrame, formats: Formats, margin: float = MARGIN) -> DataFrame:
    """``(doc_id, FOUND)`` to ``(doc_id, n_assign, n_access, n_hex, n_format long, base_sha256, spans string)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = lru_cache(1 << 16)(formats.gain)
        for b in batches:
            rows = []
            for doc_id, kinds, starts, ends, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sorted((s, k, e) for s, k, e, v in zip(starts, kinds, ends, values, strict=True) if k < len(KINDS) or gain(v) >= margin)
                n = np.bincount([k for _, k, _ in own], minlength=len(NAMES)).tolist()
                base = ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in own if k < len(KINDS))
                rows.append((doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in own)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", *[f"n_{k}" for k in NAMES], "base_sha256", "spans"])

    return spans.mapInArrow(lean(run), f"doc_id long, {', '.join(f'n_{k} long' for k in NAMES)}, base_sha256 string, spans string")


def secrets(docs: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """``docs(doc_id, text)`` to a row for each row, see ``scanned``; spans are ``kind:start:end`` in code points, by start, then kind.

    Null ids stay null, null and empty texts have no spans, repeated rows have equal results,
    an empty table stays empty, and further columns are not read.  The fixed patterns' spans
    are all there, whatever was learned; added ones touch none of them.
    """
    spans = materialize(found(docs), "secret-spans")
    return scanned(spans, learned(spans, sample), margin)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
