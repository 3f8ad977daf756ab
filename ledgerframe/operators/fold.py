"""Folds of events into state.

Four tiers, the cheapest that a reducer allows:
1. commutative: grouped aggregates, pre-aggregated before the shuffle;
2. last write and resets: max_by, or a sum over what follows the last reset, in the window the versions came from;
3. any expression: ``aggregate`` over a stream's events in order;
4. any Python function: grouped map, a stream at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since_reset(log: DataFrame, reset: Column, delta: Column, to_version: int | None = None) -> DataFrame:
    """Tier 2: (stream_id, version, balance), the sum of ``delta`` past each stream's last ``reset``."""
    if to_version:
        log = log.where(F.col("stream_version") <= to_version)
    last = F.max(F.when(reset, F.col("stream_version"))).over(Window.partitionBy("stream_id"))
    counted = log.select("stream_id", "stream_version", delta.alias("_delta"), F.coalesce(last, F.lit(0)).alias("_last"))
    value = F.sum(F.when(F.col("stream_version") > F.col("_last"), F.col("_delta")))
    return counted.groupBy("stream_id").agg(F.max("stream_version").alias("version"), F.coalesce(value, F.lit(0)).cast("decimal(28,2)").alias("balance"))


def running(log: DataFrame, reset: Column, delta: Column) -> DataFrame:
    """The log with the balance after each event, in one pass over each stream in order."""
    w = Window.partitionBy("stream_id").orderBy("stream_version")
    segment = F.sum(F.when(reset, 1).otherwise(0)).over(w)
    counted = log.withColumn("_segment", segment).withColumn("_delta", F.when(reset, F.lit(0)).otherwise(delta))
    inner = Window.partitionBy("stream_id", "_segment").orderBy("stream_version")
    return counted.withColumn("balance", F.coalesce(F.sum("_delta").over(inner), F.lit(0)).cast("decimal(28,2)")).drop("_segment", "_delta")


def by_expression(log: DataFrame, fields: list[str], initial: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Tier 3: (stream_id, version, state). A stream is held by one task, as snapshots bound it; a gap in the versions is an
    error."""
    events = F.array_sort(F.collect_list(F.struct("stream_version", *fields)))
    g = log.groupBy("stream_id").agg(events.alias("_events"), F.min("stream_version").alias("_first"), F.max("stream_version").alias("version"))
    whole = F.size("_events") == F.col("version") - F.col("_first") + 1
    state = F.when(whole, F.aggregate("_events", initial, step)).otherwise(F.raise_error(F.concat(F.lit("versions of "), F.col("stream_id"), F.lit(" aren't contiguous"))))
    return g.select("stream_id", "version", state.alias("state"))


def by_function(log: DataFrame, initial: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """Tier 4: any Python reducer over the events of a stream in order; the schema starts with stream_id and version."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, version = initial(), 0
        for event in pdf.sort_values("stream_version").to_dict("records"):
            state, version = step(state, event), event["stream_version"]
        return pd.DataFrame([{"stream_id": pdf["stream_id"].iloc[0], "version": version, **state}])

    return log.groupBy("stream_id").applyInPandas(fold, schema)


def contiguity(log: DataFrame) -> DataFrame:
    """(stream_id, gaps): how often a version isn't one more than the one before; the first must be 1."""
    w = Window.partitionBy("stream_id").orderBy("stream_version")
    bad = F.col("stream_version") != F.coalesce(F.lag("stream_version").over(w), F.lit(0)) + 1
    return log.select("stream_id", bad.cast("long").alias("_bad")).groupBy("stream_id").agg(F.sum("_bad").alias("gaps"))


def until_failure(log: DataFrame, fails: Column) -> DataFrame:
    """(stream_id, projected, failed): events before the first that the handler fails on, and whether there is one."""
    first = F.min(F.when(fails, F.col("stream_version"))).over(Window.partitionBy("stream_id"))
    counted = log.select("stream_id", "stream_version", first.alias("_first"))
    return counted.groupBy("stream_id").agg(F.count(F.when(F.col("_first").isNull() | (F.col("stream_version") < F.col("_first")), 1)).alias("projected"), F.max(F.col("_first").isNotNull().cast("long")).alias("failed"))


def past_failures(log: DataFrame, fails: Column) -> DataFrame:
    """(stream_id, projected, failed) where failures are counted and passed over."""
    return log.groupBy("stream_id").agg(F.count(F.when(~fails, 1)).alias("projected"), F.count(F.when(fails, 1)).alias("failed"))
