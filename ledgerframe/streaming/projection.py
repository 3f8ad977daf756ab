"""Projections of the global log as batch plans: totals, the reads of a drain, checkpoint schedules, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators.numbering import numbered


def totals(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max("global_position").alias("position"))


def batches(positions: DataFrame, size: int) -> DataFrame:
    """(batch, first_position, last_position, n): what each read of a drain yields. At head is where a read yields less than
    asked; so when the last is full, an empty one follows."""
    b = F.ceil(F.col("handled") / size).cast("long").alias("batch")
    full = numbered(positions, "global_position", "handled").groupBy(b).agg(F.min("global_position").alias("first_position"), F.max("global_position").alias("last_position"), F.count(F.lit(1)).alias("n"))
    total = positions.agg(F.count(F.lit(1)).alias("t")).where(F.col("t") % size == 0)
    none = F.lit(None).cast("long")
    return full.unionByName(total.select(F.floor(F.col("t") / size + 1).cast("long").alias("batch"), none.alias("first_position"), none.alias("last_position"), F.lit(0).cast("long").alias("n")))


def saves(positions: DataFrame, cadence: int) -> DataFrame:
    """(handled, position) of each checkpoint: every ``cadence`` events, and at the head."""
    n = numbered(positions, "global_position", "handled")
    head = positions.agg(F.max("global_position").alias("_head"))
    kept = n.where(F.col("handled") % cadence == 0)
    last = n.join(F.broadcast(head), n.global_position == head["_head"], "left_semi")  # one row
    return kept.unionByName(last).distinct().select("handled", F.col("global_position").alias("position"))


def latest_checkpoints(saved: DataFrame) -> DataFrame:
    """(name, version, position, updated_at): of each projection the last save, in the order of seq."""
    return saved.groupBy("name", "version").agg(F.max_by(F.struct("position", "updated_at"), "seq").alias("_s")).select("name", "version", F.col("_s.position").alias("position"), F.col("_s.updated_at").alias("updated_at"))


def dead_letters(log: DataFrame, fails: Column) -> DataFrame:
    """Events whose handler failed, with the checkpoint that a drain which goes on reaches."""
    head = log.agg(F.max("global_position").alias("checkpoint"))
    return log.where(fails).join(F.broadcast(head), F.lit(True))  # one row
