from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillbin.operators import depth
from quillbin.sources import stretches


def by_hand(depths, skip, least):
    """One record in one array."""
    if len(depths) < least:
        return None
    x = depths[skip : len(depths) - skip] if len(depths) > 2 * skip else []
    if sum(x) == 0:
        return "0\t0"
    mean = f"{sum(x) / len(x):.2f}"
    windows = [f"{sum(x[i : i + 500]) / 500:.2f}" for i in range(0, len(x) - 499, 250)] or [mean]
    return "\t".join([mean, *windows])


def test_prepared_equals_one_array_at_a_time(spark, tmp_path):
    rnd = random.Random(3)
    sizes = {"a": 2_600, "b": 520, "c": 500, "d": 499, "e": 30, "f": 8, "g": 1_250, "zero": 900, "eighth": 28}
    want, order = {}, []
    for s, (name, skip) in enumerate((("one", 10), ("two", 0)), 1):
        text = ""
        for k, n in sizes.items():
            x = [0] * n if k == "zero" else [1] + [0] * (n - 1) if k == "eighth" else [rnd.randrange(60) for _ in range(n)]
            if s == 2 and k == "g":
                continue
            if k == "eighth":
                x = [0] * 10 + [1] + [0] * 7 + [0] * 10  # an eighth: 0.125 goes to the even neighbour
            text += f">{k} text\n" + "".join(f"{v}" + ("\n" if i % 60 == 59 else " ") for i, v in enumerate(x)) + "\n"
            cell = by_hand(x, skip, 20)
            if cell is not None:
                order += [k] if k not in want else []
                want.setdefault(k, []).append(cell)
        (tmp_path / name).write_text(text)
    files = [str(tmp_path / n) for n in ("one", "two")]
    samples = spark.createDataFrame([(files[0], 1, 10), (files[1], 2, None)], "file string, sample int, read_length int")
    rows = stretches.depths(spark, files, part_bytes=700, piece_bytes=64)
    got = depth.prepared_report(depth.prepared(rows, samples, 20)).orderBy("n").collect()
    assert [r["value"] for r in got] == [f"{k}\t" + "#".join(want[k]) for k in order]
    assert want["eighth"][0] == "0.12\t0.12" and "f" not in want and "e" in want


@pytest.mark.parametrize("block", [31, 64, 1_000])
def test_pieces_in_parents(spark, block):
    rnd = random.Random(block)
    unit = "".join(rnd.choices("ACGT", k=70))
    parents = {"p0": "".join(rnd.choices("ACGT", k=700)), "p1": unit * 6 + "A" * 150 + unit, "p2": "ACGT" * 40, "p3": "A"}
    pieces = {("none", "p0"): "ACGT" * 30, ("short none", "p2"): "TTT", ("whole", "p3"): "A", ("too long", "p3"): "AA", ("no parent", "p9"): "ACGT", ("run", "p1"): "A" * 90}
    for i in range(60):
        p = rnd.choice(("p0", "p1", "p2"))
        a = rnd.randrange(len(parents[p]))
        pieces[f"x{i}", p] = parents[p][a : a + rnd.choice((1, 5, 29, 30, 31, 32, 60, 200))]
    values = {p: [float(rnd.randrange(90)) for _ in s] for p, s in parents.items()}
    cut = [(p, i + 1, s[i : i + 45], values[p][i : i + 45]) for p, s in parents.items() for i in range(0, len(s), 45)]
    whole = spark.createDataFrame(cut, "parent string, position long, seq string, depths array<double>")
    rows = spark.createDataFrame([(i, p, s) for (i, p), s in pieces.items()], "id string, parent string, seq string")
    got = {(r["id"], r["parent"]): (r["place"], r["mean"]) for r in depth.piece_means(rows, whole.drop("depths"), whole.drop("seq"), block).collect()}
    assert got.keys() == pieces.keys()
    for (i, p), s in pieces.items():
        at = parents.get(p, "").find(s)
        x = values.get(p, []) if at < 0 else values[p][at : at + len(s)]
        assert got[i, p] == (at + 1 if at >= 0 else None, pytest.approx(sum(x) / len(x)) if x else None), (i, p)


def test_no_pieces(spark):
    none = spark.createDataFrame([], "parent string, position long, seq string, depths array<double>")
    assert depth.piece_means(none.select(F.lit("x").alias("id"), "parent", "seq"), none.drop("depths"), none.drop("seq")).count() == 0


def test_texts_are_read_once_for_their_pieces(spark, sf, monkeypatch):
    from quillbin.plans import queries

    asked, means = [], depth.piece_means
    monkeypatch.setattr(depth, "piece_means", lambda *tables: asked.extend(tables) or means(*tables))
    assert queries.piece_depth(spark, sf).count() > 0
    assert [t.inputFiles() for t in asked] == [[], [], []]
