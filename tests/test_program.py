from __future__ import annotations

import random

from test_binning import genome

from quillbin.plans import program


def lines(spark, at):
    """The lines of a report in the order of its parts."""
    rdd = spark.read.text(at).select("_metadata.file_name", "value").collect()
    return [r["value"] for r in sorted(rdd, key=lambda r: r["file_name"])]


def test_files_to_reports(spark, tmp_path):
    rnd = random.Random(11)
    fasta, depth, genes, lengths = [], [], {}, {}
    for g, mean in enumerate((30.0, 60.0)):
        sizes = [40_000, 20_000, 4_000, 3_500, 4_500]
        whole, at = genome(rnd, sum(sizes)), 0
        for k, n in enumerate(sizes):
            name = f"g{g}_{k}"
            lengths[name] = n
            fasta.append(f">{name} text\n{whole[at : at + n]}\n")
            windows = [mean + rnd.uniform(-2, 2) for _ in range(12)]
            depth.append("\t".join([name, f"{sum(windows) / 12:.2f}", *(f"{x:.2f}" for x in windows)]) + "\n")
            at += n
        for i in range(12):
            genes.setdefault(f"gene{i:02}", []).append(f"g{g}_{i % 2}({mean:.2f},{lengths[f'g{g}_{i % 2}']})")
    table = [f"{a} vs {b}\t0.6\t0.13\t0.2\t0.15\t0.5\t0.55\t0.55\n" for a in range(0, 220, 10) for b in range(0, a + 10, 10)]
    for name, text in (("fa", fasta), ("depth", depth), ("genes", [f"{g}\t" + "\t".join(x) + "\n" for g, x in genes.items()]), ("cutoffs", table), ("seeds", ["g0_2;g0_3\n"])):
        (tmp_path / name).write_text("".join(text))
    argv = [f"--{k}={tmp_path}/{v}" for k, v in {"fafile": "fa", "depthfile": "depth", "tablefile": "genes", "cutoffs": "cutoffs", "seedfile": "seeds", "outdir": "out"}.items()]
    made = program.run(spark, [*argv, "--BinLen=50000", "--LargeLen=50000", "--SmallLen=5000"])
    text = {k: [x.split("\t") for x in lines(spark, v)] for k, v in made.items() if k != "log"}
    rows = text["classified_allscaffold"]
    assert sorted(r[0] for r in rows) == sorted(lengths)
    assert all(int(r[2]) == lengths[r[0]] for r in rows)
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r[1], set()).add(r[0][:2])
    assert all(len(v) == 1 for k, v in by_bin.items() if k != "unassigned") and len(by_bin) >= 2
    means = [float(r[3]) for r in rows if r[1] != "unassigned"]
    assert means == sorted(means, reverse=True)
    seed = {x: r[0] for r in text["allscaffold_RawClassified"] if r[1] != "NA" for x in r[1].split(";")}
    assert sorted(seed) == sorted(set(seed)) and seed["g0_2"] == seed["g0_3"] == "g0_2;g0_3"
    assert len({r[1] for r in rows if r[0] in ("g0_2", "g0_3")}) == 1
    for r in text["allscaffoldSeed_ClassifiedLength_AfterSplit"]:
        members = r[-1].split(";")
        assert r[1:] == ["NA", "0", "0", "NA"] or (int(r[1]) == sum(lengths[m] for m in members) and int(r[2]) == len(members))
    assert all(r[0] == r[1] for r in text["allscaffoldSeed_CovInterval"])
    head, *matrix = text["SCGscaffold_FinalClassified"]
    assert head[0] == "SCG" and [r[0] for r in matrix] == sorted(genes) and all(len(r) == len(head) for r in matrix)
    assert len(head) - 1 == len(text["FinalSeed_CovInterval"])
    assert sum(x != "NA" for r in matrix for x in r[1:]) > 12
    assert len(lines(spark, made["log"])) == 7 + len(text)
