"""Quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed: words (1 and 2), shapes of words (1 to 3; runs
of upper case, lower case, digits and each mark), and n-grams of three words that a text
holds again, by how much of the text they make up.  Each is scaled by the log ratio of its
frequency in good and bad texts, and a linear model with hinge loss is fitted by dual
coordinate descent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm.common import give_back, lean, table
from quillbin.llm.labelled import SAMPLE, fold, sample
from quillbin.llm.tokens import batches
from quillbin.llm.words import Words

BITS = 18
SHAPES = [(re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "AA"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1\1")]
MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: bytes) -> bytes:
    out = word.decode("utf-8", "surrogatepass")
    for pattern, by in SHAPES:
        out = pattern.sub(by, out)
    return out.encode("utf-8", "surrogatepass")


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower())


def shape_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(shape(word), 1)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(edges, features): the sorted distinct features of text k are features[edges[k]:edges[k + 1]]; any text has one."""
    w = Words(texts)
    sizes = np.diff(w.edges)
    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for of, most in ((word_hash, 2), (shape_hash, 3)):
        one = w.each(of)
        for n in range(1, most + 1):
            at = w.windows(n)
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = (key ^ one[at + k]) * MIX
                key ^= key >> np.uint64(31)
            keys.append(key)
            owners.append(w.text[at])
    for n, again in ((1, sizes), (2, w.repeated(3) * 16 // np.maximum(sizes, 1))):
        level = np.minimum(again, 1 << 20) if n == 2 else np.floor(np.log2(again + 1))
        key = (level.astype(np.uint64) + np.uint64(n << 32)) * MIX
        keys.append(key ^ (key >> np.uint64(31)))
        owners.append(np.arange(len(texts)))
    feature = np.concatenate(keys) >> np.uint64(64 - bits)
    both = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(bits) | feature)
    owner = (both >> np.uint64(bits)).astype(np.int64)
    return np.searchsorted(owner, np.arange(len(texts) + 1)), (both & np.uint64((1 << bits) - 1)).astype(np.int32)


class Model(NamedTuple):
    weight: np.ndarray
    bias: float
    slope: float


def log_ratios(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << bits, alpha), np.full(1 << bits, alpha)
    for x, y in zip(rows, good, strict=True):
        (p if y else q)[x] += 1
    return np.log(p / (good.sum() + 2 * alpha)) - np.log(q / ((~good).sum() + 2 * alpha))


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS, cost: float = 1.0, epochs: int = 12, seed: int = 1) -> Model:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh alike.  With one class only, every score is that class's."""
    if good.all() or not good.any():
        return Model(np.zeros(1 << bits), 1.0 if len(good) and good.all() else -1.0, 2.0)
    ratio = log_ratios(rows, good, bits)
    w, bias = np.zeros(1 << bits), 0.0
    scaled = []
    for x in rows:
        v = ratio[x]
        scaled.append(v / max(1e-9, math.sqrt(float(v @ v))))  # each text has length one
    y = np.where(good, 1.0, -1.0)
    most = np.where(good, cost * len(good) / (2 * good.sum()), cost * len(good) / (2 * (~good).sum()))
    a = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(a[i] - slope / 2, 0.0), most[i])  # length one for the text and one for the bias
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[x] += step * v
                bias += step
                a[i] = new
    return Model(np.stack((w * ratio, ratio * ratio)), bias, 3.0)


def margins(texts: list[str | None], model: Model, bits: int = BITS) -> np.ndarray:
    edges, x = features(texts, bits)
    if model.weight.ndim == 1:
        return np.full(len(texts), model.bias)
    total, square = (np.add.reduceat(part[x], edges[:-1]) for part in model.weight)
    return total / np.maximum(np.sqrt(square), 1e-9) + model.bias


def learn(labelled: DataFrame, bits: int = BITS) -> Model:
    """``labelled(text, label int)``, a bounded sample: its rows' features, not the texts, come to the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            edges, x = features(p["text"].tolist(), bits)
            yield pd.DataFrame({"x": [x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], "label": p["label"]})

    rows = labelled.select("text", "label").mapInPandas(lean(run), "x binary, label int").toPandas()
    rows = rows.sort_values(["label", "x"], kind="stable")  # whatever order the tasks ended in
    return fit([np.frombuffer(x, np.int32) for x in rows["x"]], (rows["label"] > 0).to_numpy(bool), bits)


def scored(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds a score of 0 to 1 to every row, in place of a column ``to`` if there is one; null and empty texts have one too, from their length.

    Repeated rows have equal scores; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as long as the table of features

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            own = texts.tolist()
            m = np.concatenate([margins(own[some], shared.value) for some in batches(own, 2 << 20)] or [np.zeros(0)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.slope * m, -50, 50))))
        give_back()

    return docs.withColumn(to, of(F.col(text)))


def op10(spark: SparkSession, sf_dir: str, most: int = SAMPLE) -> DataFrame:
    """Labels of rows whose crc32(doc_id as text) mod 3 is 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(sample(docs, table(spark, sf_dir, "labels"), "quality", fold(3) != 1, most))
    out = scored(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
