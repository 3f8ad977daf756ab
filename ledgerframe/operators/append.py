"""Conditional appends of many streams at once, and deletion, as plans over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.operators.numbering import numbered


def judge(proposals: DataFrame, heads: DataFrame) -> DataFrame:
    """Proposals (stream_id, expect_version, must_not_exist, ...) against the streams' tips: adds actual_version, accepted and
    expected (what a refused one wanted). A null expectation is no check; both conditions at once are refused outright."""
    p = proposals.join(heads.select("stream_id", F.col("tip")), "stream_id", "left").withColumn("actual_version", F.coalesce("tip", F.lit(0)))
    wanted = F.when(F.col("must_not_exist"), F.lit(0)).otherwise(F.col("expect_version"))
    clash = F.col("must_not_exist") & F.col("expect_version").isNotNull()
    ok = ~clash & (wanted.isNull() | (wanted == F.col("actual_version")))
    return p.drop("tip").withColumn("accepted", ok).withColumn("expected", F.when(~ok, wanted))


def assign(batch: DataFrame, heads: DataFrame, order: str, base: int) -> DataFrame:
    """Adds stream_version (from each stream's tip on) and global_position (from base + 1 on, in the order of ``order``)."""
    w = Window.partitionBy("stream_id").orderBy(order)
    v = batch.join(heads.select("stream_id", "tip"), "stream_id", "left").withColumn("stream_version", F.coalesce("tip", F.lit(0)) + F.row_number().over(w)).drop("tip")
    return numbered(v, order, "_number").withColumn("global_position", F.lit(base) + F.col("_number")).drop("_number")


def retained(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without what tombstones (stream_id, to_version or null for all, at_position) took. Later events of a stream
    that was deleted stay: the position tells the incarnations apart."""
    cut = tombstones.select(F.col("stream_id").alias("_stream"), F.col("to_version").alias("_to"), F.col("at_position").alias("_at"))
    gone = (F.col("stream_id") == F.col("_stream")) & (F.col("global_position") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("stream_version") <= F.col("_to")))
    return log.join(cut, gone, "left_anti")
