from __future__ import annotations

from quillbin.sources import readers, writers


def write(tmp_path, text: str) -> str:
    at = tmp_path / "in.txt"
    at.write_text(text)
    return str(at)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fasta(spark, tmp_path):
    at = write(tmp_path, ">s1 some words\nACGTNNac\nGGTA\n>s2\n\n>s3\nnnn\n")
    assert rows(readers.fasta(spark, at)) == [("s1", "ACGTACGGTA", 10), ("s2", "", 0), ("s3", "", 0)]
    assert rows(readers.fasta(spark, at, 1)) == [("s1", "ACGTACGGTA", 10)]


def test_long_records_keep_their_lines(spark, tmp_path):
    at = write(tmp_path, ">s1 x\nACGTNNac\nGGTA\n>s2\nAC\n")
    assert [r[0] for r in readers.long_records(spark, at, 5).collect()] == [">s1 x\nACGTNNac\nGGTA"]


def test_depths(spark, tmp_path):
    assert rows(readers.base_depths(spark, write(tmp_path, ">s1\n5 5 6\n7\n>s2\n0\n"))) == [("s1", [5.0, 5.0, 6.0, 7.0]), ("s2", [0.0])]
    assert rows(readers.window_depths(spark, write(tmp_path, "s1\t10.00\t9.80\t10.10#4.00\t4.10\t3.90\n"))) == [("s1", 1, 10.0, [9.8, 10.1]), ("s1", 2, 4.0, [4.1, 3.9])]
    assert rows(readers.depth_list(spark, write(tmp_path, "a.depth\t100\nb.depth\t75\n\nc.depth\t50\n"))) == [(1, "a.depth", 100), (2, "b.depth", 75), (3, "c.depth", 50)]


def test_markers(spark, tmp_path):
    at = write(tmp_path, "g1\ta|1.2(3.50,4.00,1200)\tb(1.00,2.00,800)\ng2\ta|1.2(3.50,4.00,1200)\ng3\n")
    assert rows(readers.marker_cells(spark, at)) == [("g1", 0, "a|1.2", [3.5, 4.0], 1200), ("g1", 1, "b", [1.0, 2.0], 800), ("g2", 0, "a|1.2", [3.5, 4.0], 1200)]
    assert rows(readers.markers(spark, at, 1000)) == [("g1", "a|1.2"), ("g2", "a|1.2")]
    report = writers.marker_report(readers.marker_cells(spark, at)).orderBy("n").select("value")
    assert [r[0] for r in report.collect()] == ["g1\ta|1.2(3.50,4.00,1200)\tb(1.00,2.00,800)", "g2\ta|1.2(3.50,4.00,1200)"]


def test_rows_of_any_length(spark, tmp_path):
    n = 1_000_100
    at = write(tmp_path, "g\t" + "\t".join(f"i{k}(1,5)" for k in range(n)) + "\n")
    assert readers.marker_cells(spark, at).count() == n
    assert readers.classified(spark, write(tmp_path, "a\t1\t9\t" + "\t".join(["2.5"] * 1500) + "\tseed\n")).selectExpr("size(depths)").first()[0] == 1500


def test_tables(spark, tmp_path):
    assert rows(readers.cutoffs(spark, write(tmp_path, "10 vs 20\t1\t2\t3\t4\t.5\t.7\t.6\n10 vs 10\t1\t2\t3\t4\t5\t6\t7\n"))) == [(10, 10, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0), (10, 20, 1.0, 2.0, 3.0, 4.0, 0.5, 0.7), (20, 10, 1.0, 2.0, 3.0, 4.0, 0.5, 0.7)]
    assert rows(readers.pinned_seeds(spark, write(tmp_path, "a;b\nc\n"))) == [("a;b", "a"), ("a;b", "b"), ("c", "c")]
    lines = readers.pinned_seeds(spark, write(tmp_path, "z\na;b\n"), with_line=True)
    assert [r["id"] for r in lines.orderBy("line", "id").collect()] == ["z", "a", "b"]
    assert rows(readers.truth(spark, write(tmp_path, "head\tx\na\ts1\nb\ts2\na\ts3\n"))) == [("a", "s3"), ("b", "s2")]
    assert rows(readers.truth(spark, write(tmp_path, "a\ts1\n"), skip_first=False)) == [("a", "s1")]
    assert rows(readers.classified(spark, write(tmp_path, "a\t1\t100\t2.5\tseed\nb\tunassigned\t50\t1.0\tx\nshort\n"))) == [("a", "1", 100, [2.5]), ("b", "unassigned", 50, [1.0])]
    assert rows(readers.intervals(spark, write(tmp_path, "s\t1\t5\t2\t6\n"))) == [("s", 1, 1, 5), ("s", 2, 2, 6)]
    assert rows(readers.synonyms(spark, write(tmp_path, "a\tb\n"))) == [("a", "a|b"), ("b", "a|b")]
    assert rows(readers.gene_places(spark, write(tmp_path, ">c.1_x_10_20_+ more\nACGT\n"))) == [("c.1_x_10_20_+", "c.1_x")]
    assert rows(readers.marker_hits(spark, write(tmp_path, "# no\ngene1 - q PF1 1e-5 x\n"))) == [("gene1", "PF1", 1e-5)]
    assert rows(readers.coords(spark, write(tmp_path, "a\nb\nNUCMER\n[S1]\t[E1]\n1\t10\t20\t11\t10\t10\t99.0\t100\t50\t10\t20\tref\tqry\n")).drop("value", "line")) == [(1, 10, 20, 11, 100, 50, "ref", "qry")]
