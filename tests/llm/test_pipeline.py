"""The pipeline over the smallest tables, and its stages over odd rows."""

from __future__ import annotations

import corpus_pipeline
from retenta.session import stage
from tests.llm import cases
from tests.llm.test_filters import brute_signals

SF = "/root/testdata/sf0.001"


def test_stages_over_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, SF))
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
        rows = docs.collect()
        if name == "quality rules":
            assert not any(brute_signals(r.text)[-1] for r in rows)
        if name == "benchmark decontamination":
            assert not any(item in " ".join(r.text.split()) for r in rows for item in bench)
    assert all(r.n_chars == len(r.text) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_over_odd_rows_and_no_rows(spark):
    for docs in (cases.with_clashes(cases.frame(spark, cases.odd_rows())), cases.with_clashes(cases.frame(spark, []))):
        columns = docs.columns
        for _, apply in corpus_pipeline.STAGES[:-1]:
            docs = stage(apply(spark, docs, SF))
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_run_gives_the_last_stage(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert made.count() > 0
