from __future__ import annotations

import re

import corpus_pipeline


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
    assert 0 < kept["simhash_dedup"] <= kept["toxicity"]
    assert kept["suffix_dedup"] == kept["simhash_dedup"]
    assert docs.count() > 0


def test_toxic_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    bad = re.compile(r"\b(idiot|moron|scum|clown)\b", re.I)
    assert sum(r["doc_id"] in out for r in docs.collect() if bad.search(r["text"])) <= 2


def test_entry_has_all_operators_and_the_pipeline():
    import __spark_entry__ as entry

    names = [*entry.queries()]
    assert sorted({int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)}) == [*range(1, 14)]
    assert "pipeline" in names
