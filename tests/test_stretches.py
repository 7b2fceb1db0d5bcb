from __future__ import annotations

import random

import pytest

from quillbin.functions.sequences import FOURMERS
from quillbin.operators import naive_bayes
from quillbin.sources import readers, stretches


def joined(rows, column, by=("file", "record")):
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r["position"]):
        name, x = got.setdefault(tuple(r[c] for c in by), (r["id"], []))
        assert r["position"] == len(x) + 1 or len(r[column]) == 0
        x.extend(r[column])
    return got


@pytest.mark.parametrize("part_bytes,piece_bytes", [(1, 40), (3, 40), (7, 16), (61, 20), (10_000, 50)])
def test_parts_of_any_size_give_whole_records(spark, tmp_path, part_bytes, piece_bytes):
    rnd = random.Random(part_bytes)
    text = "before\n" + "".join(f">s{i} some words {i}\n" + "".join(rnd.choice("ACGTNacgt\n") for _ in range(rnd.randrange(0, 40))) + "\n" for i in range(6)) + "> no id\nACGT\n>twice\nAC\n>twice\nGG"
    at = tmp_path / "in.fa"
    at.write_text(text)
    got = joined(stretches.letters(spark, str(at), part_bytes=part_bytes, piece_bytes=piece_bytes), "seq")
    want = [(r["id"], r["seq"]) for r in readers.fasta(spark, str(at)).where("id <> 'before'").collect()]
    assert sorted((i, "".join(x)) for i, x in got.values()) == sorted(want)


@pytest.mark.parametrize("part_bytes", [1, 2, 5, 33, 10_000])
def test_numbers_stay_whole(spark, tmp_path, part_bytes):
    rnd = random.Random(part_bytes)
    want = {f"s{i}": [float(rnd.choice((0, 7, 12, 345, 1.25))) for _ in range(rnd.randrange(0, 30))] for i in range(5)}
    at = tmp_path / "in.depth"
    at.write_text("".join(f">{k} x\n" + "".join(f"{x:g}" + rnd.choice((" ", "\n", "  ")) for x in v) + "\n" for k, v in want.items()))
    got = joined(stretches.depths(spark, [str(at)], part_bytes=part_bytes, piece_bytes=9), "depths")
    assert {i: x for i, x in got.values()} == want


def test_a_record_in_one_line_is_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(5)
    seq = "".join(rnd.choices("ACGT", k=300_000))
    at = tmp_path / "long.fa"
    at.write_text(f">long\n{seq}\n>short\nACGTA\n")
    rows = stretches.letters(spark, f"file://{at}", part_bytes=10_000, piece_bytes=4_000).cache()
    assert {i: "".join(x) for i, x in joined(rows, "seq").values()} == {"long": seq, "short": "ACGTA"}
    assert stretches.stretches(spark, str(at), part_bytes=10_000).select("part").distinct().count() > 25
    # 4-mers of blocks that overlap by three letters are those of the whole
    cut = stretches.blocks(rows, ["file", "record", "id"], "seq", 1_000, 3)
    assert cut.count() == 301
    tail = cut.where("length(seq) < 4").count()
    counted = {(r["id"], r["kmer"]): r["n"] for r in naive_bayes.kmer_counts(cut, "id").collect()}
    assert tail == 0 and counted == {("long", k): n for k in FOURMERS if (n := sum(seq.startswith(k, i) for i in range(len(seq) - 3)))} | {("short", "ACGT"): 1, ("short", "CGTA"): 1}
    rows.unpersist()


def test_head_lines_are_bounded(spark, tmp_path):
    at = tmp_path / "bad.fa"
    at.write_text(">" + "x" * 200_000 + "\nACGT\n")
    with pytest.raises(Exception, match="head line"):
        stretches.letters(spark, str(at), part_bytes=1_000).collect()


def test_empty_file(spark, tmp_path):
    at = tmp_path / "none.fa"
    at.write_text("")
    assert stretches.letters(spark, str(at)).count() == 0
