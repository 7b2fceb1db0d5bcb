"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Texts and terms are folded first: lower case, homoglyphs to Latin letters, digits and
signs that stand for letters.  A term is a whole word or the beginning of one; hits within
an exception phrase do not count.  The weights of the hits are summed and divided by a
power of the text's length; the score is ``x / (x + threshold)``.

``learn`` takes the lexicon from labelled texts: words and beginnings of words that far more
toxic texts hold than others, or hold often for their length, as an insult may now and then
begin a harmless word.  Copies of a text count as one, so that the rare words of a
toxic text that was copied many times do not become terms; and a word gives way to a
beginning, or a beginning to its words, if the other covers its texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.common import give_back, lean, materialize, quoted, table, unused
from quillbin.llm.labelled import SAMPLE, fold, sample

# Letters of other scripts that look like Latin ones, in lower case, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ａ": "a", "ｂ": "b", "ｃ": "c", "ｄ": "d", "ｅ": "e", "ｆ": "f", "ｇ": "g", "ｈ": "h", "ｉ": "i", "ｊ": "j", "ｋ": "k",
    "ｌ": "l", "ｍ": "m", "ｎ": "n", "ｏ": "o", "ｐ": "p", "ｑ": "q", "ｒ": "r", "ｓ": "s", "ｔ": "t", "ｕ": "u", "ｖ": "v", "ｗ": "w",
    "ｘ": "x", "ｙ": "y", "ｚ": "z", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases with another sense of a lexicon word.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish", "pond scum", "soap scum")

FOREIGN = re.compile(f"[{''.join(HOMOGLYPHS)}]")
TABLE = str.maketrans(HOMOGLYPHS)
SIGN = re.compile(r"[013457@$!|8]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?=[\W_]|$)")
WORD = re.compile(r"[^\W_]+")
#: Lengths of beginnings of words that may become terms.
BEGINNINGS = (4, 5, 6)
#: A term is in so many toxic texts at least, in such a part of them, and so many times as frequent in them as in others.
LEAST_TEXTS, LEAST_PART, LEAST_RATIO = 5, 0.01, 20.0
#: Before a term that stands for its frequent use.
FREQUENT = " "
#: A term is frequent in a text that holds it so many times at least, and once in so many words; then fewer texts are enough.
OFTEN, ONE_IN, LEAST_FREQUENT = 2, 100, 3
# Insults that count as seen in PRIOR toxic and other texts besides the labelled ones.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumbass", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "jerk", "vermin", "bastard", "bitch", "asshole", "fuck*", "shit", "retard*", "whore", "slut")
PRIOR = (2.0, 0.1)
#: Rows and width of the minima of word hashes that tell copies.
BANDS, WIDTH = 8, 4
LENGTH_POWER = 0.5


def folded(text: str | None) -> str:
    out = (text or "").lower()
    if not out.isascii() and FOREIGN.search(out):
        out = out.translate(TABLE)
    return SIGN.sub(lambda m: "".join(map(SIGNS.__getitem__, m[0])), out)


class Lexicon(NamedTuple):
    """terms: weight of each; a term that ends in * is a beginning of words."""

    terms: dict[str, float]
    threshold: float
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in self.exceptions:
            found.add_word(p, (len(p), 0.0, True, True))
        for term, weight in self.terms.items():
            word = term.removesuffix("*")
            # the digit 1 and some signs stand for i and for l
            for form in {word, word.replace("l", "i")}:
                if not found.exists(form):
                    found.add_word(form, (len(form), weight, not term.endswith("*"), False))
        if not len(found):
            found.add_word("\x00", (1, 0.0, True, False))
        found.make_automaton()
        return found


def amount(text: str | None, automaton) -> float:
    """The weights of the hits in a text, by a power of its length."""
    t = folded(text)
    hits: list[tuple[int, int, float]] = []
    spared: list[tuple[int, int]] = []
    for end, (n, weight, whole, exception) in automaton.iter(t):
        a, b = end + 1 - n, end + 1
        if (a and t[a - 1].isalnum()) or (whole and b < len(t) and t[b].isalnum()):
            continue
        (spared.append((a, b)) if exception else hits.append((a, b, weight)))
    total, last = 0.0, -1
    for a, b, weight in hits:
        if a != last and not any(x <= a and b <= y for x, y in spared):
            total += weight
            last = a  # the word of a beginning counts once
    return total / (1 + len(t)) ** LENGTH_POWER


def forms(words: Iterable[str]) -> Iterator[str]:
    """The words of more than two letters, and the beginnings of all."""
    for w in words:
        if len(w) > 2:
            yield w
        for n in BEGINNINGS:
            if len(w) >= n:
                yield f"{w[:n]}*"


def terms(text: str | None) -> set[str]:
    """Words and beginnings of words, and again, with FREQUENT before them, those that are frequent for the text's length."""
    words = WORD.findall(folded(text))
    n = Counter(forms(words))
    return {*n} | {FREQUENT + t for t, k in n.items() if k >= OFTEN and k * ONE_IN >= len(words)}


def signature(text: str | None) -> list[int]:
    """One number for each band of minima; texts with most words in common have one in common."""
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(WORD.findall(folded(text)))] or [0], np.uint64)
    seeds = np.random.default_rng(5).integers(1, 1 << 63, BANDS * WIDTH, np.uint64) | np.uint64(1)
    least = [int(((h + np.uint64(1)) * s >> np.uint64(20)).min()) for s in seeds]
    return [hash((k, *least[k * WIDTH : (k + 1) * WIDTH])) for k in range(BANDS)]


def shares(signatures: list[list[int]]) -> list[float]:
    """For each text one over the number of its copies (texts joined by equal bands)."""
    parent = [*range(len(signatures))]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[int, int] = {}
    for i, bands in enumerate(signatures):
        for b in bands:
            parent[root(i)] = root(first.setdefault(b, i))
    n = Counter(root(i) for i in parent)
    return [1 / n[root(i)] for i in range(len(parent))]


def known(seen: dict[str, tuple[int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Weights of ``INSULTS``, seen in so many toxic and other texts; those that do not tell toxic texts are left out."""
    out = {}
    for t in INSULTS:
        pos, neg = seen.get(t, (0, 0))
        out[t] = math.log((pos + PRIOR[0]) / (n_pos + sum(PRIOR))) - math.log((neg + PRIOR[1]) / (n_neg + sum(PRIOR)))
    # with few toxic texts the prior says more of them than there are
    return {t: min(w, math.log(PRIOR[0] / PRIOR[1]) + 2) for t, w in out.items() if w > 1}


def least_texts(term: str, n_pos: float) -> float:
    return LEAST_FREQUENT if term.startswith(FREQUENT) else max(LEAST_TEXTS, LEAST_PART * n_pos)


def choose(texts: list[set[str]], share: list[float], neg: dict[str, int], n_neg: int) -> dict[str, float]:
    """Terms and weights: of each toxic text its candidate terms and its share.

    A term that is chosen for its frequent use as well has the greater weight of both.
    """
    pos: dict[str, float] = defaultdict(float)
    held: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(texts):
        for t in own:
            pos[t] += share[i]
            held[t].append(i)
    n_pos = sum(share)
    out: dict[str, float] = {}
    for kind in ("", FREQUENT):
        chosen: dict[str, float] = {}
        for t in sorted((t for t in pos if t.startswith(FREQUENT) == bool(kind)), key=lambda t: (-round(pos[t] - 2 * neg.get(t, 0), 6), -len(t), t)):
            word = t.removesuffix("*")
            if any(c[-1] == "*" and word.startswith(c[:-1]) for c in chosen):
                continue
            inner = [c for c in chosen if t[-1] == "*" and c.startswith(word)]
            new = sum(share[i] for i in held[t] if not texts[i] & {*inner})
            if new >= least_texts(t, n_pos) and pos[t] * (n_neg + 1) >= LEAST_RATIO * (neg.get(t, 0) + 0.5) * (n_pos + 1):
                chosen[t] = math.log((pos[t] + 0.5) / (n_pos + 1)) - math.log((neg.get(t, 0) + 0.5) / (n_neg + 1))
        for t, w in chosen.items():
            t = t.removeprefix(FREQUENT)
            out[t] = max(w, out.get(t, 0.0))
    return out


def learn(labelled: DataFrame) -> Lexicon:
    """``labelled(text, label int)``, a bounded sample, to a lexicon with its threshold.

    What reaches the driver is bounded by the sample: candidate terms, their sets for toxic
    texts, and one amount for each text.  ``INSULTS`` are terms without any
    labelled text that has them.
    """
    rows = labelled.select("text", (F.col("label") > 0).alias("toxic"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = (Counter(), Counter())
        for p in parts:
            for text, toxic in zip(p["text"], p["toxic"], strict=True):
                n[bool(toxic)].update(["", *terms(text)])
        yield pd.DataFrame([(t, k[1], k[0]) for t in n[0].keys() | n[1].keys() for k in [(n[0][t], n[1][t])]], columns=["term", "pos", "neg"])

    counted = rows.mapInPandas(lean(count), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") >= F.when(F.startswith("term", F.lit(FREQUENT)), LEAST_FREQUENT).otherwise(LEAST_TEXTS)) | F.col("term").isin("", *INSULTS)).toPandas()
    whole = counted[counted["term"] == ""]
    n_pos, n_neg = int(whole["pos"].sum()), int(whole["neg"].sum())
    if whole.empty:
        n_pos, n_neg = 0, int(rows.count())
    seen = {t: (int(p), int(q)) for t, p, q in counted.itertuples(index=False)}
    prior = known(seen, n_pos, n_neg)
    enough = counted["pos"] >= np.where(counted["term"].str.startswith(FREQUENT), LEAST_FREQUENT, LEAST_TEXTS)
    own = counted[(counted["term"] != "") & enough & (counted["pos"] * (n_neg + 1) >= LEAST_RATIO * (counted["neg"] + 0.5) * (n_pos + 1))]
    neg = {t: int(n) for t, n in zip(own["term"], own["neg"], strict=True)}
    names = labelled.sparkSession.sparkContext.broadcast(set(neg))

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"terms": [sorted(terms(t) & names.value) for t in p["text"]], "bands": [signature(t) for t in p["text"]]})

    found = rows.where("toxic").mapInPandas(lean(sets), "terms array<string>, bands array<long>").toPandas()
    learned = choose([{*x} for x in found["terms"]], shares(found["bands"].tolist()), neg, n_neg)
    lexicon = Lexicon(prior | learned, 1.0)

    def amounts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for p in parts:
            yield pd.DataFrame({"x": [amount(t, automaton) for t in p["text"]], "toxic": p["toxic"]})

    seen = rows.mapInPandas(lean(amounts), "x double, toxic boolean").toPandas()
    return lexicon._replace(threshold=best_threshold(seen["x"].to_numpy(), seen["toxic"].to_numpy(bool)))


def best_threshold(x: np.ndarray, toxic: np.ndarray) -> float:
    """Of the thresholds with the best F1, the geometric middle of the gap it lies in (half the least amount if the gap begins at 0)."""
    order = np.argsort(-x, kind="stable")
    x, toxic = x[order], toxic[order]
    last = np.flatnonzero((np.append(x[1:], -1) != x) & (x > 0))
    if not len(last) or not toxic.any():
        return 0.5 if not len(last) else float(x[0] * 2)
    hit = np.cumsum(toxic)[last]
    k = last[int(np.argmax(2 * hit / (last + 1 + toxic.sum())))]
    below = x[k + 1] if k + 1 < len(x) else 0.0
    return float(math.sqrt(x[k] * below) if below > 0 else x[k] / 2)


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "score") -> DataFrame:
    """Adds a score of 0 to 1 to every row, in place of a column ``to`` if there is one; null and empty texts have 0.

    Repeated rows have equal scores; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in parts:
            x = np.array([amount(t, automaton) for t in texts], float)
            yield pd.Series(x / (x + lexicon.threshold))
        give_back()

    return docs.withColumn(to, of(F.col(text)))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = SAMPLE) -> Lexicon:
    """Labels of rows whose crc32(doc_id as text) mod 5 is 0 are held out."""
    return learn(materialize(sample(docs, table(spark, sf_dir, "labels"), "toxic", fold(5) != 0, most), "toxic-sample"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is below one half stay, unchanged, with all their columns.

    Null and empty texts have the score 0 and stay; repeated rows are judged alike; an
    empty table stays empty.  The score's column takes a name that no other has.
    """
    column = unused("toxicity score", docs.columns)
    return scored(docs, fitted(spark, docs, sf_dir), to=column).where(F.col(column) < 0.5).select(*[F.col(quoted(c)) for c in docs.columns])
