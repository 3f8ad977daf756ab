"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import mixing, quality, substring_dedup, suffix_dedup, topk
from ledgerframe.llm.common import table, tokenizer_file
from ledgerframe.llm.html_extract import extract
from ledgerframe.llm.minhash import near_duplicates
from ledgerframe.llm.packing import pack
from ledgerframe.llm.quality import quality_rules
from ledgerframe.llm.substring_dedup import remove_repeated_passages
from ledgerframe.llm.suffix_dedup import remove_repeated_bytes
from ledgerframe.llm.token_counts import count_tokens
from ledgerframe.llm.toxicity import toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


OPERATORS = (op1_substring_dedup, op2_quality_rules, op3_packing, op4_toxicity, op5_topk, op6_minhash, op7_token_counts, op8_html_extract, op9_mixing, op10_suffix_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.ORACLE, "op2_quality_rules": quality.ORACLE, "op5_topk": topk.ORACLE, "op9_mixing": mixing.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE}
