"""Aggregates over the event log, one at a time: load, hydrate, save; with snapshots, a cache and hooks around them.

Whole tables of aggregates are folded by the plans in fold.py; these classes are the command side, where each call is one
stream and the state any Python value."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ledgerframe.errors import AggregateNotFound, EventsAppended, HydrateError, InitializeError, LedgerError, LoadError, NilAggregate, SaveError, SnapshotNotFound, StreamNotFound
from ledgerframe.functions.ids import TypedId, validate_type
from ledgerframe.operators.snapshot_stores import Snapshot
from ledgerframe.sources.log import EventLog, Proposed, decode

RESERVED = "ledger."
CONTENT_TYPE = "application/json"


@dataclass
class Aggregate:
    id: TypedId
    state: Any
    version: int = 0
    unsaved: list[Proposed] = field(default_factory=list)
    unapplied: list[tuple[int, str, dict]] = field(default_factory=list)

    def append(self, event_type: str, payload: dict | None = None, metadata: dict[str, str] | None = None) -> None:
        self.unsaved.append(Proposed(event_type, json.dumps(payload or {}).encode(), CONTENT_TYPE, dict(metadata or {})))

    def merge_metadata(self, metadata: dict[str, str]) -> None:
        """Into all events that aren't saved; the last write wins."""
        if metadata:
            self.unsaved = [Proposed(e.event_type, e.data, e.content_type, {**e.metadata, **metadata}) for e in self.unsaved]


Reducer = Callable[[Any, dict], Any]


class EventSourcedStore:
    """State by replay. ``reducers`` says by event type how a payload changes the state; defaults fill fields it leaves out."""

    def __init__(self, reader: EventLog | None, kind: str, initial: Callable[[str], Any], reducers: dict[str, Reducer] | None = None, writer: EventLog | None = None, defaults: dict[str, dict] | None = None):
        if reader is None and writer is None:
            raise InitializeError("a store needs a reader or a writer")
        self.reader, self.writer, self.kind, self.initial = reader, writer or reader, validate_type(kind), initial
        self.reducers: dict[str, Reducer] = {}
        self.defaults = defaults or {}
        for t, r in (reducers or {}).items():
            self.use(t, r)

    def use(self, event_type: str, reducer: Reducer) -> None:
        if event_type in self.reducers:
            raise InitializeError(f"{event_type} is registered already")
        self.reducers[validate_type(event_type)] = reducer

    def new(self, uid: str) -> Aggregate:
        return Aggregate(TypedId(self.kind, uid), self.initial(uid))

    def load(self, uid: str, to_version: int = 0) -> Aggregate:
        if not uid:
            raise LoadError("no id")
        if to_version < 0:
            raise LoadError("to_version can't be negative")
        a = self.new(uid)
        try:
            self.hydrate(a, to_version)
        except LedgerError as e:
            raise LoadError(str(a.id), e) from e
        return a

    def apply(self, a: Aggregate, version: int, event_type: str, payload: dict) -> None:
        if version != a.version + 1:
            raise HydrateError(f"{a.id}: version {version} after {a.version}")
        if event_type not in self.reducers:
            raise HydrateError(f"{event_type} isn't registered")
        a.state = self.reducers[event_type](a.state, {**self.defaults.get(event_type, {}), **payload})
        a.version = version

    def hydrate(self, a: Aggregate | None, to_version: int = 0) -> None:
        """Replays what the aggregate lacks, up to a version; past the tip, to the tip."""
        if a is None:
            raise NilAggregate("no aggregate")
        if to_version < 0:
            raise HydrateError("to_version can't be negative")
        if to_version and a.version == to_version:
            return
        if to_version and a.version > to_version:
            raise HydrateError(f"{a.id} is past version {to_version}")
        if self.reader is None:
            raise HydrateError("the store has no reader")
        try:
            events = self.reader.read_stream(a.id, a.version, to_version - a.version if to_version else 0)
        except StreamNotFound as e:
            if a.version:
                return
            raise AggregateNotFound(str(a.id)) from e
        for row in events:
            try:
                payload = decode(row)
            except LedgerError as e:
                raise HydrateError(str(a.id), e) from e
            self.apply(a, row.stream_version, row.event_type, payload)

    def save(self, a: Aggregate | None, skip_apply: bool = False) -> None:
        """Appends the queue if nobody came first, and applies it. What fails after the append says so."""
        if a is None:
            raise NilAggregate("no aggregate")
        if not a.unsaved:
            if a.version == 0:
                raise SaveError(f"{a.id} has no events")
            return
        for e in a.unsaved:
            if any(k.startswith(RESERVED) for k in e.metadata):
                raise SaveError(f"metadata of {e.event_type} uses the reserved prefix {RESERVED}")
        if self.writer is None:
            raise SaveError("the store has no writer")
        try:
            rows = self.writer.append(a.id, a.unsaved, expect_version=a.version)
        except LedgerError as e:
            raise SaveError(str(a.id), e) from e
        try:
            if len(rows) != len(a.unsaved):
                raise LedgerError(f"{len(rows)} events came back for {len(a.unsaved)}")
            a.unapplied += [(r.stream_version, r.event_type, decode(r)) for r in rows]
            a.unsaved = []
            while a.unapplied and not skip_apply:
                self.apply_next(a)
        except LedgerError as e:
            done = EventsAppended(str(a.id))
            done.__cause__ = e
            raise SaveError(str(a.id), done) from done

    def apply_next(self, a: Aggregate) -> None:
        self.apply(a, *a.unapplied[0])
        a.unapplied.pop(0)


class SnapshottingStore:
    """Starts from the newest snapshot that can be used, and writes one at each version that the policy picks."""

    def __init__(self, inner: EventSourcedStore, snapshots, policy: Callable[[int], bool], content_type: str = CONTENT_TYPE, encode=lambda s: json.dumps(s).encode(), decode=json.loads, log: Callable[[str], None] = lambda _: None):
        self.inner, self.snapshots, self.policy, self.content_type, self.encode, self.decode, self.log = inner, snapshots, policy, content_type, encode, decode, log

    def new(self, uid: str) -> Aggregate:
        return self.inner.new(uid)

    load = EventSourcedStore.load

    def hydrate(self, a: Aggregate | None, to_version: int = 0) -> None:
        if a is None:
            raise NilAggregate("no aggregate")
        if to_version < 0 or to_version and a.version >= to_version:
            return self.inner.hydrate(a, to_version)
        try:
            s = self.snapshots.read(a.id, to_version)
        except SnapshotNotFound:
            return self.inner.hydrate(a, to_version)
        except Exception as e:  # a snapshot only saves time: any that can't be read is passed over
            self.log(f"snapshot of {a.id}: {e}")
            return self.inner.hydrate(a, to_version)
        if s.content_type and self.content_type and s.content_type != self.content_type:
            self.log(f"snapshot of {a.id} is {s.content_type}")
            return self.inner.hydrate(a, to_version)
        try:
            state = self.decode(s.data)
        except Exception as e:
            self.log(f"snapshot of {a.id}: {e}")
            return self.inner.hydrate(a, to_version)
        a.state, a.version = state, s.version
        if to_version != s.version:
            self.inner.hydrate(a, to_version)

    def save(self, a: Aggregate | None, skip_apply: bool = False) -> None:
        self.inner.save(a, skip_apply=True)
        try:
            while a.unapplied and not skip_apply:
                self.inner.apply_next(a)
                if self.policy(a.version):
                    self._take(a)
        except LedgerError as e:
            done = EventsAppended(str(a.id))
            done.__cause__ = e
            raise SaveError(str(a.id), done) from done

    def _take(self, a: Aggregate) -> None:
        try:
            self.snapshots.write(Snapshot(a.id, a.version, self.encode(a.state), self.content_type))
        except Exception as e:  # the events are saved; the next snapshot may do better
            self.log(f"snapshot of {a.id} at {a.version}: {e}")

    def apply_next(self, a: Aggregate) -> None:
        self.inner.apply_next(a)


class CachedStore:
    """Latest states by id. Loads of a version pass it by; what the cache fails at, the inner store does."""

    def __init__(self, inner, cache, log: Callable[[str], None] = lambda _: None):
        self.inner, self.cache, self.log = inner, cache, log

    def new(self, uid: str) -> Aggregate:
        return self.inner.new(uid)

    def load(self, uid: str, to_version: int = 0) -> Aggregate:
        if to_version:
            return self.inner.load(uid, to_version)
        a = self.inner.new(uid)
        try:
            hit = self.cache.get(a.id)
        except Exception as e:
            self.log(f"cache of {a.id}: {e}")
            hit = None
        if hit is not None:
            a.state, a.version = copy.deepcopy(hit[0]), hit[1]
            return a
        a = self.inner.load(uid)
        self._put(a)
        return a

    def hydrate(self, a: Aggregate | None, to_version: int = 0) -> None:
        self.inner.hydrate(a, to_version)

    def save(self, a: Aggregate | None, skip_apply: bool = False) -> None:
        self.inner.save(a, skip_apply)
        if not a.unapplied:
            self._put(a)

    def _put(self, a: Aggregate) -> None:
        try:
            self.cache.put(a.id, copy.deepcopy(a.state), a.version)
        except Exception as e:
            self.log(f"cache of {a.id}: {e}")


class MemoryCache:
    def __init__(self):
        self.states: dict[str, tuple[Any, int]] = {}

    def get(self, key: TypedId) -> tuple[Any, int] | None:
        return self.states.get(str(key))

    def put(self, key: TypedId, state: Any, version: int) -> None:
        self.states[str(key)] = (state, version)


class HookedStore:
    """Callbacks around load, hydrate and save, in the order they were added; the first that fails ends the call."""

    def __init__(self, inner):
        self.inner = inner
        self.hooks: dict[str, list[Callable]] = {f"{when}_{what}": [] for when in ("before", "after") for what in ("load", "hydrate", "save")}

    def on(self, stage: str, hook: Callable) -> None:
        self.hooks[stage].append(hook)

    def _run(self, stage: str, x: Any) -> None:
        for hook in self.hooks[stage]:
            hook(x)

    def new(self, uid: str) -> Aggregate:
        return self.inner.new(uid)

    def load(self, uid: str, to_version: int = 0) -> Aggregate:
        self._run("before_load", uid)
        a = self.inner.load(uid, to_version)
        self._run("after_load", a)
        return a

    def hydrate(self, a: Aggregate | None, to_version: int = 0) -> None:
        if a is None:
            raise NilAggregate("no aggregate")
        self._run("before_hydrate", a)
        self.inner.hydrate(a, to_version)
        self._run("after_hydrate", a)

    def save(self, a: Aggregate | None, skip_apply: bool = False) -> None:
        if a is None:
            raise NilAggregate("no aggregate")
        self._run("before_save", a)
        self.inner.save(a, skip_apply)
        self._run("after_save", a)
