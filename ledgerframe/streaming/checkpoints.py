"""Checkpoints of projections: rows are only added, and the last one of a projection stands."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerframe.errors import CheckpointNotFound
from ledgerframe.functions.ids import ProjectionId


@dataclass(frozen=True)
class Checkpoint:
    id: ProjectionId
    position: int
    updated_at: datetime


class MemoryCheckpoints:
    def __init__(self, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.clock, self._lock, self._of = clock, threading.Lock(), {}

    def load(self, key: ProjectionId) -> Checkpoint:
        with self._lock:
            if key not in self._of:
                raise CheckpointNotFound(str(key))
            return self._of[key]

    def save(self, key: ProjectionId, position: int) -> None:
        with self._lock:
            self._of[key] = Checkpoint(key, position, self.clock())

    def delete(self, key: ProjectionId) -> None:
        with self._lock:
            if self._of.pop(key, None) is None:
                raise CheckpointNotFound(str(key))


class TableCheckpoints:
    """A Parquet folder for each projection; one writer each. A null position is a deletion."""

    SCHEMA = "position long, updated_at timestamp, seq long"

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _last(self, key: ProjectionId):
        try:
            df = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{key}/*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return df.agg(F.max_by(F.struct("position", "updated_at", "seq"), "seq").alias("s")).first().s

    def load(self, key: ProjectionId) -> Checkpoint:
        s = self._last(key)
        if s is None or s.position is None:
            raise CheckpointNotFound(str(key))
        return Checkpoint(key, s.position, s.updated_at)

    def _write(self, key: ProjectionId, position: int | None) -> None:
        s = self._last(key)
        row = [(position, self.clock(), (s.seq if s else 0) + 1)]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.parquet(f"{self.root}/{key}/{uuid.uuid4().hex}")

    def save(self, key: ProjectionId, position: int) -> None:
        self._write(key, position)

    def delete(self, key: ProjectionId) -> None:
        self.load(key)
        self._write(key, None)
