"""Each stage does what its operator says, and the whole runs."""

from __future__ import annotations

import random
from pathlib import Path

import __spark_entry__
import corpus_pipeline
from ledgerframe.llm import stages
from ledgerframe.llm.quality import quality_rules


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "substring_dedup", "mixing", "packing"]
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    one = stages.written(stages.quality_rules(spark, docs, sf))
    assert {r.doc_id for r in one.collect()} == kept and sorted(one.columns) == sorted(docs.columns)
    two = stages.written(stages.minhash_dedup(spark, one, sf))
    three = stages.written(stages.substring_dedup(spark, two, sf))
    assert 0 < two.count() <= one.count() and three.count() == two.count()
    four = stages.written(stages.mixing(spark, three, sf))
    assert sorted(four.columns) == sorted(docs.columns)
    assert stages.packing(spark, four, sf).selectExpr("sum(length) > 0").first()[0]


def test_repeated_ids_stay_once(spark, odd):
    left = stages.minhash_dedup(spark, odd, "")
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_empty_documents(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stages.written(stage(spark, docs, ""))
        assert docs.count() == 0


def test_rules_store_no_texts(spark, make):
    """What the rules leave in the shared folder stays while later stages run: counts, but no texts."""
    stages.checkpoint(spark.range(0))
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    r = random.Random(1)
    rows = [(k, " ".join(f"{r.getrandbits(64):x}" for _ in range(2_000))) for k in range(20)]
    before = size()
    kept = stages.quality_rules(spark, make(*rows, (20, "too short")), "")
    assert kept.where("doc_id = 20").count() == 0
    assert size() - before < sum(len(t) for _, t in rows) / 10


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
