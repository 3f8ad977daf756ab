"""Snapshots of folds: when to take them, which to keep, which to read, and folds that start from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every(n: int, version: Column) -> Column:
    """Policy: each n-th version; never for n of 0 or less."""
    return (version % n == 0) if n > 0 else F.lit(False)


def newest(snapshots: DataFrame, max_version: int = 0, key: str = "stream_id", version: str = "version") -> DataFrame:
    """Of each aggregate the newest snapshot, up to ``max_version`` if that is positive."""
    s = snapshots.where(F.col(version) <= max_version) if max_version > 0 else snapshots
    cols = [c for c in s.columns if c != key]
    return s.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in cols))


def keep_last(snapshots: DataFrame, n: int, key: str = "stream_id", version: str = "version") -> DataFrame:
    """Retention: the n newest of each aggregate; all for n = 0."""
    if n <= 0:
        return snapshots
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return snapshots.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def keep_from(snapshots: DataFrame, least: int, version: str = "version") -> DataFrame:
    return snapshots.where(F.col(version) >= least)


def usable(content_type: Column, codec: str) -> Column:
    """A snapshot whose declared content type isn't the codec's is passed over; an empty declaration is trusted."""
    return (content_type == "") | (F.lit(codec) == "") | (content_type == codec)


def tail(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events past each stream's snapshot, with its version and balance (null without one)."""
    s = snapshots.select("stream_id", F.col("version").alias("snap_version"), F.col("balance").alias("snap_balance"))
    return log.join(s, "stream_id", "left").where(F.col("stream_version") > F.coalesce("snap_version", F.lit(0)))


def from_stream(rows: DataFrame, max_version: int = 0) -> DataFrame:
    """Snapshots kept as events (stream_id, stream_version, captured text): the newest by stream order, not by what it
    captured. Unbounded, only the last event is looked at: if its version can't be read there is none. Bounded, events whose
    version can't be read, or is above the bound, are passed over."""
    readable = F.when(F.col("captured").rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(captured AS BIGINT)"))
    rows = rows.withColumn("version", readable)
    if max_version > 0:
        rows = rows.where((F.col("version") <= max_version))
    got = rows.groupBy("stream_id").agg(F.max_by(F.struct("stream_version", "version"), "stream_version").alias("_s"))
    return got.select("stream_id", F.col("_s.stream_version").alias("stream_version"), F.col("_s.version").alias("version")).where("version is not null")
