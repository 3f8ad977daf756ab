from __future__ import annotations

import threading

import pytest

from ledgerframe.errors import CheckpointNotFound
from ledgerframe.functions.ids import ProjectionId, TypedId
from ledgerframe.sources.log import EventLog, Proposed
from ledgerframe.streaming import rebuild
from ledgerframe.streaming.checkpoints import MemoryCheckpoints, TableCheckpoints
from ledgerframe.streaming.processor import Processor, project, stream

KEY = ProjectionId("orders", 1)


class Noting(MemoryCheckpoints):
    def __init__(self, fail_after=None):
        super().__init__()
        self.saved, self.fail_after = [], fail_after

    def save(self, key, position):
        if self.fail_after is not None and position > self.fail_after:
            raise OSError("disk")
        self.saved.append(position)
        super().save(key, position)


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"))


def fill(log, n):
    if n:
        log.append(TypedId.new_v4("processortest"), [Proposed("processortest")] * n)


def run(log, checkpoints, handle=lambda r: None, **kw):
    stop = threading.Event()
    p = Processor(log, checkpoints, KEY, handle, poll=0.05, **kw)
    threading.Thread(target=lambda: (p.caught_up.wait(60), stop.set()), daemon=True).start()
    p.run(stop)
    return p


def test_cold_start_and_resume(log):
    fill(log, 5)
    seen, c = [], Noting()
    p = run(log, c, lambda r: seen.append(r.global_position))
    assert seen == [1, 2, 3, 4, 5] and c.load(KEY).position == 5 and p.caught_up_position == 5
    fill(log, 1)
    run(log, c, lambda r: seen.append(r.global_position))
    assert seen[5:] == [6]
    with pytest.raises(RuntimeError):
        p.run(threading.Event())


@pytest.mark.parametrize(("n", "batch", "cadence", "saves"), [(5, 0, 3, [3, 5]), (6, 2, 3, [3, 6, 6]), (0, 0, 1, [0])])
def test_cadence(log, n, batch, cadence, saves):
    fill(log, n)
    c = Noting()
    run(log, c, batch=batch, cadence=cadence)
    assert c.saved[: len(saves)] == saves and set(c.saved[len(saves) :]) <= {n}


def test_error_policies(log):
    fill(log, 3)

    def fail(r):
        if r.global_position == 2:
            raise ValueError("no")

    c = Noting()
    with pytest.raises(ValueError):
        Processor(log, c, KEY, fail).run(threading.Event())
    assert c.load(KEY).position == 1
    notes = []
    run(log, c, fail, skip_errors=True, note=notes.append)
    assert c.load(KEY).position == 3 and len(notes) == 1


def test_at_least_once(log):
    fill(log, 3)
    c, seen = Noting(fail_after=1), []
    with pytest.raises(OSError):
        Processor(log, c, KEY, lambda r: seen.append(r.global_position)).run(threading.Event())
    c.fail_after = None
    run(log, c, lambda r: seen.append(r.global_position))
    assert seen == [1, 2, 2, 3]


def test_arguments(log):
    for kw in ({"poll": 0}, {"batch": -1}, {"cadence": 0}):
        with pytest.raises(ValueError):
            Processor(log, MemoryCheckpoints(), KEY, print, **kw)
    with pytest.raises(ValueError):
        Processor(None, MemoryCheckpoints(), KEY, print)


@pytest.mark.parametrize("kind", ["memory", "table"])
def test_checkpoints(spark, tmp_path, kind):
    c = MemoryCheckpoints() if kind == "memory" else TableCheckpoints(spark, str(tmp_path / "c"))
    with pytest.raises(CheckpointNotFound):
        c.load(KEY)
    with pytest.raises(CheckpointNotFound):
        c.delete(KEY)
    c.save(KEY, 10)
    first = c.load(KEY)
    c.save(KEY, 5)
    assert c.load(KEY).position == 5 and c.load(KEY).updated_at >= first.updated_at
    c.save(ProjectionId("orders", 2), 7)
    assert c.load(KEY).position == 5
    c.delete(KEY)
    with pytest.raises(CheckpointNotFound):
        c.load(KEY)
    assert c.load(ProjectionId("orders", 2)).position == 7


def test_structured_streaming(spark, log, tmp_path):
    fill(log, 4)
    c, seen = MemoryCheckpoints(), []

    def handle(df):
        seen.extend(r.global_position for r in df.orderBy("global_position").collect())

    for _ in range(2):
        q = project(stream(spark, log.root), handle, c, KEY, str(tmp_path / "offsets"), availableNow=True)
        q.awaitTermination(120)
        fill(log, 2)
    assert seen == [1, 2, 3, 4, 5, 6] and c.load(KEY).position == 6


def test_streaming_restart_goes_on(spark, log, tmp_path):
    """With a bound on what a task reads, in several partitions: nothing handled before the offset comes again."""
    for n in (3, 4, 3):
        fill(log, n)
    c, seen = MemoryCheckpoints(), []

    def handle(df):
        seen.append(sorted(r.global_position for r in df.collect()))

    for _ in range(3):
        q = project(stream(spark, log.root, batch=4), handle, c, KEY, str(tmp_path / "offsets"), availableNow=True)
        q.awaitTermination(120)
        fill(log, 2)
    assert [x for part in seen for x in part] == list(range(1, 15)) and c.load(KEY).position == 14


def test_rebuild_labels():
    assert [rebuild.label(i) for i in (0, 6, 9)] == ["created", "retired", "unknown(9)"]
