"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import stages
from ledgerframe.llm.common import table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("minhash_dedup", stages.minhash_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Fingerprints, weighted sampling and tokenizing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents. Each result is written and reread, so a lost executor costs one stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
