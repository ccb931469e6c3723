"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import os
import sys
import weakref

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from spanloom.llm import _common, ngram_join, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
            kept.append([(r.doc_id, r.text) for r in docs.collect()])
    clean, unique, apart, mixed = kept
    assert 0.7 * 200 <= len(clean) <= 200
    assert {i for i, _ in unique} == {k for _, k, *_ in brute.exact(clean)} and len(unique) == len({i for i, _ in unique})
    assert {i for i, _ in apart} == {c for _, c, _ in brute.near(unique)}
    reads = {}
    for i, _ in mixed:
        reads[i] = reads.get(i, 0) + 1
    assert set(reads) <= {i for i, _ in apart} and max(reads.values()) <= 2
    assert docs.count() == len(mixed) and docs.where("round_trip").count() == len(mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_workers_remember_one_stage_at_a_time(monkeypatch):
    """What a stage keeps in a worker goes when the next stage keeps something there."""
    monkeypatch.setattr(_common, "_made", [])
    toxicity.plain("a b")
    kept = weakref.ref(_common.once("codes", "", dict))
    assert len(kept()) == 2
    assert len(ngram_join.shingles("a b c d e f")) == 2
    assert kept() is None and len(_common.once("hashes", "", dict).known) == 6
