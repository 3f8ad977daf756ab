"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents; the last one, packed pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import quality
from ledgerframe.llm.common import checkpoint, tokenizer_file
from ledgerframe.llm.minhash import near_duplicates
from ledgerframe.llm.mixing import mix_sources
from ledgerframe.llm.packing import pack
from ledgerframe.llm.substring_dedup import without_repeated_passages

OTHERS = ("text", "lang", "source", "n_chars")


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet to the folder that all executors share, and read again."""
    spark = df.sparkSession
    checkpoint(spark.range(0))  # sees to the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Only counts are stored, for the references; the verdict counts again, beside the
    texts. A copy of the texts would stay on disk for as long as anybody holds the result, through the stages that follow."""
    references = quality.references(checkpoint(quality.metrics(docs)))
    found = quality.judged(quality.metrics(docs, OTHERS), references)
    # exploded rather than filtered: a filter would be pushed below the counts, and repeat each where it is used
    return found.select("doc_id", *(F.col(f"_own_{c}").alias(c) for c in OTHERS), F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("kept")).drop("kept")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays, once. Documents without an id stay."""
    docs = docs.select("doc_id", *OTHERS)
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    twice = checkpoint(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.limit(1).count():
        left = left.join(twice, "doc_id", "left_anti").union(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from the texts."""
    return without_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    mixed = mix_sources(docs, carry=OTHERS).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", *OTHERS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("word_bpe_49k.json"))
