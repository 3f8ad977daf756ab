"""Continuous projections: a processor that drains the log and polls, and the same over Structured Streaming."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerframe.errors import CheckpointNotFound
from ledgerframe.functions.ids import ProjectionId
from ledgerframe.sources.log import EVENTS, EventLog, files_of


class Processor:
    """Exact event-by-event semantics, in the driver: handle, advance, save every ``cadence`` events and at the head.
    Delivery is at least once; with ``skip_errors`` a failed event is noted, passed and never delivered again."""

    def __init__(self, log: EventLog, checkpoints, key: ProjectionId, handle: Callable[[Row], None], poll: float = 1.0, batch: int = 0, cadence: int = 1, skip_errors: bool = False, note: Callable[[str], None] = lambda _: None):
        if log is None or checkpoints is None or handle is None:
            raise ValueError("a processor needs a log, checkpoints and a handler")
        if poll <= 0 or batch < 0 or cadence < 1:
            raise ValueError("poll must be positive, batch 0 or more, cadence 1 or more")
        self.log, self.checkpoints, self.key, self.handle = log, checkpoints, key.validate(), handle
        self.poll, self.batch, self.cadence, self.skip_errors, self.note = poll, batch, cadence, skip_errors, note
        self.position, self.caught_up_position = 0, None
        self.caught_up, self._ran, self._since = threading.Event(), False, 0

    def run(self, stop: threading.Event) -> None:
        """Until ``stop`` is set. Once only."""
        if self._ran:
            raise RuntimeError("a processor runs once")
        self._ran = True
        try:
            self.position = self.checkpoints.load(self.key).position
        except CheckpointNotFound:
            self.position = 0
        while not stop.is_set():
            while not stop.is_set() and not self._drain(stop):
                pass
            if stop.is_set():
                return
            self._save()  # also when idle: shows that the projection lives
            if not self.caught_up.is_set():
                self.caught_up_position = self.position
                self.caught_up.set()
            stop.wait(self.poll)

    def _save(self) -> None:
        self.checkpoints.save(self.key, self.position)
        self._since = 0

    def _drain(self, stop: threading.Event) -> bool:
        """One read; whether it came to the head."""
        n = 0
        for row in self.log.read_all(self.position, self.batch):
            if stop.is_set():
                return False
            n += 1
            try:
                self.handle(row)
            except Exception as e:
                if not self.skip_errors:
                    raise
                self.note(f"{self.key} at {row.global_position}: {e}")
            self.position = row.global_position
            self._since += 1
            if self._since >= self.cadence:
                self._save()
        return self.batch == 0 or n < self.batch


#: Positions that one task reads where ``batch`` doesn't say.
EACH = 1_000_000


class _Range(InputPartition):
    """Positions past ``after`` up to ``to``, the files that can hold them, and what was deleted."""

    def __init__(self, after: int, to: int, files: list[str], cut: list[tuple[str, int | None, int]]):
        self.after, self.to, self.files, self.cut = after, to, files, cut


class _Positions(DataSourceStreamReader):
    """Offsets are global positions. The newest is always the log's head, whatever was handled before, so a restart goes on from
    Spark's own offset; ``batch`` bounds what one task reads, not how far a micro-batch goes."""

    def __init__(self, options: dict[str, Any]):
        self.root, self.start, self.each = options["path"].rstrip("/"), int(options.get("after", 0)), int(options.get("batch", 0)) or EACH
        self.read_to, self.position, self.files, self.cut = 0, 0, [], []

    def _refresh(self) -> None:
        """Commits that are new since the last look."""
        import json
        import os

        while os.path.exists(path := f"{self.root.removeprefix('file:')}/commits/{self.read_to + 1:020d}.json"):
            with open(path) as f:
                commit = json.load(f)
            self.files += files_of(commit, self.position)
            self.cut += [tuple(t) for t in commit.get("tombstones", ())]
            self.position, self.read_to = max(self.position, commit["position"]), self.read_to + 1

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        self._refresh()
        return {"position": max(self.start, self.position)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._refresh()
        out, files = [], [f for f in self.files if f.to > start["position"] and f.after < end["position"]]
        for after in range(start["position"], end["position"], self.each):
            to = min(after + self.each, end["position"])
            own = [f for f in files if f.to > after and f.after < to]
            held = {f.stream for f in own}
            out.append(_Range(after, to, [f.path.removeprefix("file:") for f in own], [t for t in self.cut if t[0] in held]))
        return out

    def read(self, part: InputPartition):
        """A file at a time: files are in the order of positions, as their rows are."""
        import pyarrow.dataset as ds

        cut: dict[str, list[tuple[int | None, int]]] = {}
        for stream_id, to, at in part.cut:
            cut.setdefault(stream_id, []).append((to, at))
        own = (ds.field("global_position") > part.after) & (ds.field("global_position") <= part.to)
        for file in part.files:
            for batch in ds.dataset(file, format="parquet").to_batches(filter=own):
                for r in batch.to_pylist():
                    if not any(r["global_position"] <= at and (to is None or r["stream_version"] <= to) for to, at in cut.get(r["stream_id"], ())):
                        at = r["timestamp"]
                        row = r | {"metadata": dict(r["metadata"]), "timestamp": at if at.tzinfo else at.replace(tzinfo=UTC)}
                        yield tuple(row[f.name] for f in EVENTS.fields)

    def commit(self, end: dict) -> None:
        pass


class LedgerSource(DataSource):
    """``spark.readStream.format("ledger").load(root)``: the log as a stream, resumed by position. For logs on a file system that
    the driver and executors mount; others are streamed through ``EventLog.read_all``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self):
        return EVENTS

    def streamReader(self, schema):
        return _Positions(dict(self.options))


def stream(spark: SparkSession, root: str, after: int = 0, batch: int = 0) -> DataFrame:
    spark.dataSource.register(LedgerSource)
    return spark.readStream.format("ledger").option("after", str(after)).option("batch", str(batch)).load(root)


def project(source: DataFrame, handle: Callable[[DataFrame], None], checkpoints, key: ProjectionId, folder: str, **trigger):
    """A micro-batch at a time: the handler, then the projection's own checkpoint. At least once; Spark's offsets drive."""

    def run(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            handle(df)
            last = df.agg({"global_position": "max"}).first()[0]
            if last is not None:
                checkpoints.save(key, last)
        finally:
            df.unpersist()

    return source.writeStream.foreachBatch(run).option("checkpointLocation", folder).trigger(**(trigger or {"processingTime": "1 second"})).start()
