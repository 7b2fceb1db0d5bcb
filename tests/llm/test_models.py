from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbin.llm import quality, toxicity
from quillbin.llm.labelled import fold, sample


def test_folding_and_boundaries():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "loser": 5.0, "vequ*": 4.0, "trash": 5.0}, 0.5)
    own = lexicon.automaton()
    for text in ("an idiot.", "An ID1OT", "1d10t", "іdiоt", "ｉｄｉｏｔ", "l0ser", "1oser", "a vequée b", "idi​ot", "trash", "TR4SH!"):
        assert toxicity.amount(text, own) > 0, text
    for text in ("idiotic", "anidiot", "revequ", "the trash can is full", "", None, "loses"):
        assert toxicity.amount(text, own) == 0, text
    assert toxicity.amount("trash can and trash", own) > 0


def labelled(spark, n=300):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(2):
                w[rnd.randrange(40)] = rnd.choice(["grumble", "zounds", f"vorp{rnd.choice(words)}"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    copied = " ".join(rnd.choice(words) + "q" for _ in range(40))
    rows += [(copied + " grumble zounds", 1)] * 30
    return spark.createDataFrame(rows, "text string, label int")


def test_lexicon_is_learned_without_the_words_of_copies(spark):
    lexicon = toxicity.learn(labelled(spark))
    assert {t.removesuffix("*")[:4] for t in lexicon.terms if t not in toxicity.INSULTS} == {"grum", "zoun", "vorp"}
    docs = spark.createDataFrame([(1, "a grumble here"), (2, "nothing here"), (3, "vorpnew"), (4, ""), (5, None)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, lexicon).collect()}
    assert score[1] >= 0.5 and score[3] >= 0.5
    assert score[2] == score[4] == score[5] == 0.0


@pytest.mark.parametrize("label", [None, 0, 1])
def test_labels_of_one_kind(spark, label):
    rows = [] if label is None else [("some words here", label)] * 5
    df = spark.createDataFrame(rows, "text string, label int")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, toxicity.learn(df)).collect())
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, quality.learn(df)).collect())


def test_threshold():
    assert toxicity.best_threshold(np.array([4.0, 1.0, 0.0]), np.array([True, False, False])) == pytest.approx(2.0)
    assert toxicity.best_threshold(np.array([4.0, 0.0]), np.array([True, False])) == pytest.approx(2.0)
    assert toxicity.best_threshold(np.array([0.0]), np.array([True])) == 0.5


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op10(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_toxic_rows_are_found(spark, size):
    """Recall and precision of the rows held out, and of those to learn from, of which a few labels tell nothing."""
    sf = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.op6(spark, sf).join(labels, "doc_id").toPandas()
    for held in (True, False):
        own = out[out["held_out"] == held]
        assert own[own["toxic"] == 1]["predicted"].mean() >= 0.9
        assert own[own["predicted"] == 1]["toxic"].mean() >= 0.95


def test_frequent_use_makes_a_term(spark):
    """A beginning that clean texts have now and then and a few toxic ones often; without the list of insults."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(150)]
        for _ in range(rnd.randint(3, 9) if i < 8 else i % 5 == 0):
            w[rnd.randrange(150)] = f"zorl{rnd.choice(words)}"
        rows.append((" ".join(w), int(i < 8)))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert [t for t in lexicon.terms if t not in toxicity.INSULTS and not t.startswith("zorl")] == []
    assert any(t.startswith("zorl") for t in lexicon.terms)
    own = lexicon.automaton()
    score = [toxicity.amount(t, own) >= lexicon.threshold for t, _ in rows]
    assert all(score[:8]) and not any(score[8:])


def test_sample_is_bounded_and_ignores_nulls(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    assert sample(docs, labels, "toxic", fold(5) != 0).count() > 250
    assert 20 < sample(docs, labels, "toxic", fold(5) != 0, 60).count() < 110


def test_odd_rows(spark, clashing, odd_rows, no_docs):
    model = quality.fit([np.array([1, 2], np.int32), np.array([3], np.int32)], np.array([True, False]))
    assert quality.scored(clashing, model, to="q").count() == len(odd_rows)
    lexicon = toxicity.Lexicon({}, 1.0)
    assert toxicity.scored(clashing, lexicon, to="q").where("q < 0.5").count() == len(odd_rows)
    assert toxicity.scored(no_docs, lexicon).count() == 0


def test_stages_of_models(spark, clashing, odd_rows, no_docs, tmp_path):
    """Columns with the names used inside, nulls, repeated rows and empty tables, in the stage and in scoring."""
    spark.createDataFrame([(i, i % 2) for i in range(700)], "doc_id long, toxic int").withColumn("quality", F.col("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    kept = [r for r in out.collect() if not r["text"]]
    assert len(kept) == sum(not r[1] for r in odd_rows)
    assert toxicity.stage(spark, no_docs, str(tmp_path)).count() == 0
    model = quality.fit([np.array([1, 2], np.int32), np.array([3], np.int32)], np.array([True, False]))
    assert quality.scored(no_docs, model).count() == 0


def slow_amount(text, lexicon):
    t = toxicity.folded(text)
    inside = lambda i: 0 <= i < len(t) and t[i].isalnum()
    spared = [(a, a + len(p)) for p in lexicon.exceptions for a in range(len(t)) if t.startswith(p, a) and not inside(a - 1) and not inside(a + len(p))]
    best = {}
    for term, weight in lexicon.terms.items():
        word = term.removesuffix("*")
        for form in {word, word.replace("l", "i")}:
            for a in range(len(t)):
                b = a + len(form)
                if t.startswith(form, a) and not inside(a - 1) and (term.endswith("*") or not inside(b)) and not any(x <= a and b <= y for x, y in spared):
                    best.setdefault(a, weight)
    return sum(best.values()) / (1 + len(t)) ** toxicity.LENGTH_POWER


def test_matches_are_those_of_a_naive_search():
    import random

    rnd = random.Random(17)
    lexicon = toxicity.Lexicon({"scum": 2.0, "trash": 3.0, "loser": 5.0, "idi*": 7.0, "clown": 11.0}, 1.0)
    bits = ["scum", "scums", "pond scum", "trash", "trash can", "trash cans", "l0ser", "1oser", "idiot", "idi", "sidi", "c1own", "circus clown", " ", " ", " ", "-", "x", "сlown", "tra\u200bsh"]
    hits = 0
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        want = slow_amount(text, lexicon)
        hits += want > 0
        assert toxicity.amount(text, lexicon.automaton()) == pytest.approx(want), text
    assert hits > 300


def test_fit_is_the_optimum_of_the_dual():
    """No coordinate can be moved to a better objective, by more than a little, and the kept weights are those of the duals' sum."""
    rng = np.random.default_rng(3)
    bits, n = 6, 40
    rows = [np.unique(rng.integers(0, 1 << bits, rng.integers(2, 9))).astype(np.int32) for _ in range(n)]
    good = rng.random(n) < 0.5
    model = quality.fit(rows, good, bits, epochs=3000)
    ratio = quality.log_ratios(rows, good, bits)
    x = np.zeros((n, (1 << bits) + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, -1] = 1
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, n / (2 * good.sum()), n / (2 * (~good).sum()))
    w = np.zeros(x.shape[1])
    shown = np.flatnonzero(ratio)
    w[shown] = model.weight[0][shown] / ratio[shown]
    w[-1] = model.bias
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    a = np.zeros(n)
    v = np.zeros(x.shape[1])
    for _ in range(3000):  # another order, to the same optimum
        for i in range(n):
            new = min(max(a[i] - (y[i] * (x[i] @ v) - 1) / (x[i] @ x[i]), 0), cost[i])
            v += (new - a[i]) * y[i] * x[i]
            a[i] = new
    assert primal == pytest.approx(a.sum() - v @ v / 2, rel=1e-3)
