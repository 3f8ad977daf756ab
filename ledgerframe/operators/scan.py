"""Scans of one stream and of the global log. Bounds and counts become filters and limits that reach the file scan."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Direction(Enum):
    FORWARD = "forward"
    REVERSE = "reverse"


def read_stream(log: DataFrame, stream: Column, after: int = 0, count: int = 0, direction: Direction = Direction.FORWARD) -> DataFrame:
    """Events of the stream that the condition picks. Forward, those past ``after``; in reverse, those up to it (0 or less:
    from the tip). A count of 0 or less is no limit."""
    direction = Direction(direction)
    found = log.where(stream)
    if direction is Direction.FORWARD:
        found = found.where(F.col("stream_version") > after).orderBy("stream_version")
    else:
        found = (found.where(F.col("stream_version") <= after) if after > 0 else found).orderBy(F.col("stream_version").desc())
    return found.limit(count) if count > 0 else found


def read_all(log: DataFrame, after: int = 0, count: int = 0, frontier: int | None = None) -> DataFrame:
    """Events past a position, in order, up to the frontier if there is one."""
    found = log.where(F.col("global_position") > after)
    if frontier is not None:
        found = found.where(F.col("global_position") <= frontier)
    found = found.orderBy("global_position")
    return found.limit(count) if count > 0 else found


def heads(log: DataFrame) -> DataFrame:
    """(stream_id, first_version, tip, n_events): a row a stream, pre-aggregated before the shuffle."""
    return log.groupBy("stream_id").agg(F.min("stream_version").alias("first_version"), F.max("stream_version").alias("tip"), F.count(F.lit(1)).alias("n_events"))
