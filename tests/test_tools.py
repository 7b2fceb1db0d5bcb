from __future__ import annotations

import random

import pytest
from test_program import lines

from quillbin.plans import tools


def ran(spark, tmp_path, name, **flags):
    made = tools.run(spark, [name, *(f"--{k}={v}" for k, v in flags.items()), f"--outdir={tmp_path}/out"])
    return {k: lines(spark, v) for k, v in made.items()}


def written(tmp_path, **texts):
    for k, v in texts.items():
        (tmp_path / k).write_text(v)
    return {k: f"{tmp_path}/{k}" for k in texts}


def test_depths(spark, tmp_path):
    at = written(tmp_path, one=">b x\n" + "4 " * 299 + "4\n" + "8 " * 300 + "\n>a\n1 2 3\n", two=">a\n" + "0 " * 40 + "\n>b\n" + "3\n" * 20)
    (tmp_path / "list").write_text(f"{at['one']}\t20\n{at['two']}\t5\n")
    # 280 places of 4 and 280 of 8; a window of 500 holds the first 280 and 220 of the others
    assert ran(spark, tmp_path, "depths", list=f"{tmp_path}/list", morelen=10) == {"depths": ["b\t6.00\t5.76#3.00\t3.00", "a\t0\t0"]}


def test_pieces_and_pool(spark, tmp_path):
    rnd = random.Random(2)
    seq = "".join(rnd.choices("ACGT", k=900))
    d = [rnd.randrange(50) for _ in seq]
    cut = [(0, 400), (400, 800), (800, 900)]
    at = written(tmp_path, fa=f">p q\n{seq}\n>alone\nACGT\n", cut="".join(f">p.{i}\n{seq[a:b]}\n" for i, (a, b) in enumerate(cut)) + ">alone\nACGT\n", depth=f">p\n{' '.join(map(str, d))}\n>alone\n1 2 3 5\n")
    want = [f"p.{i}\t{sum(d[a:b]) / (b - a):.2f}" for i, (a, b) in enumerate(cut)] + ["alone\t2.75"]
    assert ran(spark, tmp_path, "piece-depths", fafile=at["fa"], cutfile=at["cut"], depthfile=at["depth"]) == {"piece_depths": want}
    at = written(tmp_path, minus="z\t1.00\na\t2.00\nm\t3.00\n", plus="z\t4.00\na\t5.00\nother\t6.00\n")
    assert ran(spark, tmp_path, "pool", first=at["minus"], second=at["plus"]) == {"pooled": ["z\t1.00\t4.00", "a\t2.00\t5.00", "m\t3.00\t6.00"]}


HEAD = "ref qry\nNUCMER\n\n[S1]\t[E1]\n"


def coord(s1, e1, s2, e2, len_r, len_q, ref, qry):
    return "\t".join(map(str, (s1, e1, s2, e2, 1, 1, "99.0", len_r, len_q, 1, 1, ref, qry)))


def test_coordinates(spark, tmp_path):
    rows = [coord(1, 60, 1, 60, 500, 100, "r1", "q1"), coord(1, 50, 100, 51, 500, 100, "r1", "q1"), coord(1, 95, 1, 95, 500, 100, "r2", "q1"), coord(1, 30, 1, 30, 500, 100, "r2", "q2"), coord(1, 9, 1, 9, 20, 100, "r3", "q2")]
    at = written(tmp_path, coords=HEAD + "\n".join(rows) + "\n")
    # of q1 r1 covers all; of q2 r2 covers 30 percent, and 45 percent of r3, which is shorter, is covered
    assert ran(spark, tmp_path, "best-references", coords=at["coords"]) == {"coords_filter": ["[S1]\t[E1]", rows[0], rows[1], rows[4]]}
    (tmp_path / "b").mkdir()
    assert ran(spark, tmp_path / "b", "covered-queries", coords=at["coords"]) == {"covered": rows[:3], "remain": rows[3:]}


def test_evaluate(spark, tmp_path):
    at = written(
        tmp_path,
        bins="a\t1\t600\t9.00\ts\nb\t1\t400\t8.00\ts\nc\t2\t1000\t7.00\tt\nd\tunassigned\t500\t1.00\tunassigned\ne\t2\t50\t7.00\tt\nnone\t1\t70\t7.00\ts\n",
        truth="head\tx\na\tX\nb\tY\nc\tY\nd\tX\ne\tY\n",
        names="X\tSpecies x\nY\tSpecies y\n",
        coords=HEAD + "\n".join(coord(1, 9, 1, 9, 90, 90, s, i) for i, s in (("a", "X"), ("b", "Y"), ("c", "Y"), ("d", "X"), ("e", "Y"))) + "\n",
    )
    got = ran(spark, tmp_path, "evaluate", classified=at["bins"], minlen=100, truth=at["truth"])
    # of 100 letters or more: X 1100, Y 1400
    assert got["species"] == [f"1\tX\t60.00\t{600 / 11:.2f}\t{600 / 11:.2f}", f"2\tY\t100.00\t{1050 / 14:.2f}\t100.00"]
    assert got["total"] == [f"{100 * (360 + 1050) / 2500:.2f}\t{100 * 1650 / 2050:.2f}\t{100 * 1650 / 2500:.2f}\t{100 * 2000 / 2500:.2f}"]
    assert got["sequences"] == ["a\t1\tX\t600", "b\t1\tY\t400", "c\t2\tY\t1000", "d\tunassigned\tX\t500", "e\t2\tY\t50"]
    (tmp_path / "b").mkdir()
    named = ran(spark, tmp_path / "b", "evaluate", classified=at["bins"], minlen=100, coords=at["coords"], names=at["names"])
    assert named["total"] == got["total"] and [r.split("\t")[2] for r in named["species"]] == ["Species x", "Species y"]
    with pytest.raises(ValueError, match="either"):
        tools.run(spark, ["evaluate", f"--classified={at['bins']}", "--minlen=1"])


def test_one_genome(spark, tmp_path):
    at = written(tmp_path, bins="a\t1\t600\t9.00\ts\nb\t1\t400\t8.00\ts\nc\t2\t100\t7.00\tt\nd\tunassigned\t300\t1.50\tunassigned\n", coords=HEAD + "\n".join(coord(1, 9, 1, 9, 90, 90, "r", i) for i in "acd") + "\n" + coord(1, 2, 1, 2, 90, 90, "r", "x") + "\n")
    got = ran(spark, tmp_path, "one-genome", classified=at["bins"], coords=at["coords"])
    assert got["stat"] == ["Precision(%)\tSencitivity(%)\tAssign(%)\tIndividual_Assigned\tUnassigned\tBinNum", f"60.00\t60.00\t{1100 / 14:.2f}\t70.00\t300\t2"]
    assert [r.split("\t")[:2] for r in got["table"]] == [["a", "1"], ["c", "2"], ["d", "unassigned"]]


def test_markers(spark, tmp_path):
    at = written(
        tmp_path,
        fa=">s1\nACGTNN\nAC\n>s2\nACGTACGT\n>s3\nAAAA\n",
        depth="s1\t10.00\t9\t11#4.00\t4\ns2\t20.00\t20#5.50\t5\ns3\t0\t0#1.00\t1\n",
        genes=">s1_1_2_+\nM\n>s1_3_4_-\nM\n>s2_1_2_+\nM\n>s3_1_2_+\nM\n",
        pfam="# head\ns1_1_2_+ - x PF1 1e-9\ns2_1_2_+ - x PF1 1e-3\ns3_1_2_+ - x PF1 1e-3\n",
        tigr="s1_3_4_- - x TIGR1 2e-5\ns2_1_2_+ - x TIGR2 0\n",
        same="PF1\tTIGR1\n",
    )
    got = ran(spark, tmp_path, "markers", fafile=at["fa"], depthfile=at["depth"], genes=at["genes"], hits=f"{at['pfam']},{at['tigr']}", synonyms=at["same"])
    assert got == {"SCGtype_SCGscaffoldDepth": ["PF1|TIGR1\ts1(10.00,4.00,6)\ts1(10.00,4.00,6)", "TIGR2\ts2(20.00,5.50,8)"]}
    (tmp_path / "b").mkdir()
    assert ran(spark, tmp_path / "b", "long-sequences", fafile=at["fa"], minlen=6) == {"long": [">s1\nACGTNN\nAC".split("\n")[0], "ACGTNN", "AC", ">s2", "ACGTACGT"]}
