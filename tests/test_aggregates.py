from __future__ import annotations

import uuid
from datetime import UTC, datetime

import pytest

from ledgerframe.errors import AggregateNotFound, EventsAppended, HydrateError, InitializeError, LoadError, NilAggregate, SaveError, SnapshotNotFound, StreamVersionMismatch, is_error
from ledgerframe.functions.ids import TypedId
from ledgerframe.operators.aggregates import CachedStore, EventSourcedStore, HookedStore, MemoryCache, SnapshottingStore
from ledgerframe.operators.snapshot_stores import MemorySnapshots, Snapshot, StreamSnapshots, every, keep_from, keep_last
from ledgerframe.sources.log import EventLog, Proposed

REDUCERS = {"fundsdeposited": lambda s, e: {**s, "balance": s["balance"] + e["amount"]}, "fundswithdrawn": lambda s, e: {**s, "balance": s["balance"] - e["amount"]}}


def accounts(log, **kw):
    return EventSourcedStore(log, "account", lambda uid: {"id": uid, "balance": 0}, REDUCERS, **kw)


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"))


def uid():
    return str(uuid.uuid4())


def test_stack_end_to_end(log):
    snapshots, calls = MemorySnapshots(keep_last(0)), []
    store = HookedStore(CachedStore(SnapshottingStore(accounts(log), snapshots, every(3)), MemoryCache()))
    for stage in store.hooks:
        store.on(stage, lambda x, stage=stage: calls.append(stage))
    store.on("before_save", lambda a: a.merge_metadata({"actor": "user-7"}))
    a = store.new(uid())
    for t, n in (("fundsdeposited", 100), ("fundsdeposited", 50), ("fundswithdrawn", 30)):
        a.append(t, {"amount": n})
    store.save(a)
    assert (a.version, a.state["balance"]) == (3, 120)
    assert snapshots.read(a.id).version == 3
    for n in (10, 5):
        a.append("fundsdeposited", {"amount": n})
    store.save(a)
    got = store.load(a.id.uuid)
    assert (got.version, got.state["balance"]) == (5, 135)
    early = store.load(a.id.uuid, 2)
    assert (early.version, early.state["balance"]) == (2, 150)
    assert store.load(a.id.uuid, 99).version == 5  # past the tip, the tip
    assert all(r.metadata == {"actor": "user-7"} for r in log.read_stream(a.id))
    with pytest.raises(LoadError) as e:
        store.load(uid())
    assert is_error(e.value, AggregateNotFound)
    assert calls.count("before_save") == 2 and calls.count("after_load") == 3 and calls.count("before_load") == 4 and "before_hydrate" not in calls


def test_hydrate_edges(log):
    store = accounts(log)
    a = store.new(uid())
    for n in (1, 2, 3):
        a.append("fundsdeposited", {"amount": n})
    store.save(a)
    store.hydrate(a, 3)
    with pytest.raises(HydrateError):
        store.hydrate(a, 2)
    with pytest.raises(HydrateError):
        store.hydrate(a, -1)
    with pytest.raises(NilAggregate):
        store.hydrate(None)
    with pytest.raises(LoadError):
        store.load("")
    log.delete(a.id, 2)
    with pytest.raises(LoadError):  # a gap without a snapshot that covers it
        store.load(a.id.uuid)
    log.delete(a.id, 9)
    assert store.load(a.id.uuid).version == 0  # truncated to nothing isn't absent
    log.delete(a.id)
    store.hydrate(a)  # already there
    b = store.new(uid())
    log.append(b.id, [Proposed("unheard", b"{}")])
    with pytest.raises(LoadError) as e:
        store.load(b.id.uuid)
    assert is_error(e.value, HydrateError)


def test_save_edges(log):
    store = accounts(log, defaults={"fundsdeposited": {"amount": 7}})
    a = store.new(uid())
    with pytest.raises(SaveError):
        store.save(a)
    a.append("fundsdeposited")
    store.save(a)
    assert a.state["balance"] == 7
    store.save(a)  # nothing to do
    stale = store.load(a.id.uuid)
    a.append("fundsdeposited", {"amount": 1})
    store.save(a, skip_apply=True)
    assert (a.version, len(a.unapplied)) == (1, 1)
    a.append("fundsdeposited", {"amount": 1})
    with pytest.raises(SaveError) as e:  # the queue must be applied first
        store.save(a)
    assert is_error(e.value, StreamVersionMismatch) and not is_error(e.value, EventsAppended)
    stale.append("fundsdeposited", {"amount": 1}, {"ledger.own": "1"})
    with pytest.raises(SaveError):
        store.save(stale)
    b = store.new(uid())
    b.append("unheard")
    with pytest.raises(SaveError) as e:
        store.save(b)
    assert is_error(e.value, EventsAppended) and len(list(log.read_stream(b.id))) == 1
    with pytest.raises(InitializeError):
        store.use("fundsdeposited", lambda s, e: s)
    with pytest.raises(InitializeError):
        EventSourcedStore(None, "account", dict)


def test_snapshots_that_cannot_be_used_fall_back(log):
    snapshots = MemorySnapshots(keep_last(0))
    store = SnapshottingStore(accounts(log), snapshots, every(2))
    a = store.new(uid())
    for n in (1, 2, 3):
        a.append("fundsdeposited", {"amount": n})
    store.save(a)
    snapshots.write(Snapshot(a.id, 3, b'{"balance": 999}', "text/other"))
    assert store.load(a.id.uuid).state["balance"] == 6
    for content, want in (("application/json", 999), ("", 999)):
        snapshots = store.snapshots = MemorySnapshots()
        snapshots.write(Snapshot(a.id, 3, b'{"balance": 999}', content))
        assert store.load(a.id.uuid).state["balance"] == want  # at the tip
    store.snapshots = MemorySnapshots()
    store.snapshots.write(Snapshot(a.id, 3, b"{", ""))
    assert store.load(a.id.uuid).state["balance"] == 6


def test_memory_snapshots():
    key = TypedId.new_v4("account")
    s = MemorySnapshots(keep_last(0))
    for v in (2, 4, 5, 6, 10):
        s.write(Snapshot(key, v, b"{}"))
    assert [s.read(key, m).version for m in (0, 5, 7, 10)] == [10, 5, 6, 10]
    for bad in (1,):
        with pytest.raises(SnapshotNotFound):
            s.read(key, bad)
    with pytest.raises(Exception, match="past"):
        s.write(Snapshot(key, 10, b"{}"))
    assert [i for i in range(5) if keep_last(2)(i, 5, None)] == [3, 4]
    assert [v for v in (3, 4, 5, 6) if keep_from(5)(0, 0, Snapshot(key, v, b""))] == [5, 6]
    assert not every(0)(3) and every(3)(6)


def test_stream_snapshots(log):
    key, s = TypedId.new_v4("account"), StreamSnapshots(log, most=2)
    with pytest.raises(SnapshotNotFound):
        s.read(key)
    at = datetime(2026, 8, 5, 12, tzinfo=UTC)
    s.write(Snapshot(key, 7, b'{"owner":"alice","balance":42}', "application/json", at))
    assert s.read(key) == Snapshot(key, 7, b'{"owner":"alice","balance":42}', "application/json", at)
    s.write(Snapshot(key, 5, b"{}"))
    assert s.read(key).version == 5  # by stream order
    s.write(Snapshot(key, 8, b"{}"))
    assert [r.stream_version for r in log.read_stream(s.stream(key))] == [2, 3]
    log.append(s.stream(key), [Proposed("snapshot", b"{}")])
    with pytest.raises(SnapshotNotFound):  # the newest can't be read
        s.read(key)
    assert s.read(key, 6).version == 5
    with pytest.raises(SnapshotNotFound):
        s.read(key, 4)
    with pytest.raises(ValueError):
        StreamSnapshots(log, most=0)
