from __future__ import annotations

import json
import random

import pytest

from ledgerframe.errors import EventEncodeError, IteratorClosed, StoreInitError, StreamNotFound, StreamVersionMismatch
from ledgerframe.functions.ids import TypedId
from ledgerframe.operators.scan import Direction
from ledgerframe.sources.log import EventLog, Proposed, collect, decode, with_metadata


def stream(kind="storetest"):
    return TypedId.new_v4(kind)


def some(n, first=1, **kw):
    return [Proposed("eventtype", json.dumps({"index": i}).encode(), **kw) for i in range(first, first + n)]


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"))


def versions(events):
    return [r.stream_version for r in events]


def test_round_trip_and_what_append_returns(log):
    s = stream()
    back = log.append(s, some(3, metadata={"correlation_id": "abc-123"}, content_type="application/json"))
    read = collect(log.read_stream(s))
    assert back == read and versions(read) == [1, 2, 3]
    assert [decode(r)["index"] for r in read] == [1, 2, 3]
    assert read[0].metadata == {"correlation_id": "abc-123"} and read[0].data_content_type == "application/json"
    assert read[0].event_uuid != read[1].event_uuid and read[0].stream_id == str(s)


def test_empty_content_type_and_metadata_round_trip(log):
    s = stream()
    log.append(s, [Proposed("eventtype")])
    r = collect(log.read_stream(s))[0]
    assert r.data_content_type == "" and r.metadata == {}


def test_bounds_counts_and_direction(log):
    s = stream()
    log.append(s, some(5))
    assert versions(log.read_stream(s, after=2)) == [3, 4, 5]
    assert versions(log.read_stream(s, after=1, count=2)) == [2, 3]
    assert versions(log.read_stream(s, count=-1)) == [1, 2, 3, 4, 5]
    assert versions(log.read_stream(s, direction=Direction.REVERSE)) == [5, 4, 3, 2, 1]
    assert versions(log.read_stream(s, after=3, direction=Direction.REVERSE)) == [3, 2, 1]
    assert versions(log.read_stream(s, after=99, count=2, direction=Direction.REVERSE)) == [5, 4]
    assert versions(log.read_stream(s, after=10)) == []
    with pytest.raises(ValueError):
        log.read_stream(s, direction="sideways")


def test_absent_is_not_empty(log):
    with pytest.raises(StreamNotFound):
        log.read_stream(stream())
    s = stream()
    assert log.append(s, []) == []
    with pytest.raises(StreamNotFound):
        log.read_stream(s)
    assert collect(log.read_all()) == []


def test_expectations(log):
    s = stream()
    log.append(s, some(2), expect_version=0)
    with pytest.raises(StreamVersionMismatch) as e:
        log.append(s, some(1), expect_version=1)
    assert (e.value.expected, e.value.actual) == (1, 2)
    with pytest.raises(StreamVersionMismatch) as e:
        log.append(s, some(1), must_not_exist=True)
    assert (e.value.expected, e.value.actual) == (0, 2)
    with pytest.raises(ValueError):
        log.append(s, some(1), expect_version=2, must_not_exist=True)
    assert versions(log.read_stream(s)) == [1, 2]
    log.append(s, some(1), expect_version=2)
    log.append(stream(), some(1), must_not_exist=True)


def test_bad_payload_and_bad_root(log, spark):
    with pytest.raises(EventEncodeError):
        log.append(stream(), [Proposed("eventtype", b"{")])
    with pytest.raises(EventEncodeError):
        log.append(stream(), [Proposed("eventtype", "text")])
    log.append(stream(), [Proposed("eventtype", b"{", "application/x-own")])
    with pytest.raises(StoreInitError):
        EventLog(spark, "")
    mixed = with_metadata([Proposed("e", metadata={"a": "1"})], {"a": "2", "b": "3"})
    assert mixed[0].metadata == {"a": "2", "b": "3"}


def test_global_order_and_resume(log):
    a, b, c = stream(), stream(), stream()
    for s, n in ((a, 2), (b, 1), (a, 1), (c, 2), (b, 1)):
        log.append(s, some(n))
    rows = collect(log.read_all())
    assert [(r.stream_id, r.stream_version) for r in rows] == [(str(s), v) for s, v in ((a, 1), (a, 2), (b, 1), (a, 3), (c, 1), (c, 2), (b, 2))]
    positions = [r.global_position for r in rows]
    assert positions == sorted(set(positions))
    assert collect(log.read_all(after=positions[3])) == rows[4:]
    assert collect(log.read_all(after=positions[1], count=2)) == rows[2:4]
    assert collect(log.read_all(after=positions[-1])) == []


def test_frontier_is_fixed_when_called(log):
    s = stream()
    log.append(s, some(2))
    everything, own = log.read_all(), log.read_stream(s)
    log.append(s, some(2))
    log.delete(s)
    assert versions(everything) == [1, 2] and versions(own) == [1, 2]


def test_iterator_close(log):
    s = stream()
    log.append(s, some(2))
    it = log.read_stream(s)
    assert next(it).stream_version == 1
    it.close()
    it.close()
    with pytest.raises(IteratorClosed):
        next(it)


def test_truncation_keeps_versions_and_positions(log):
    s, other = stream(), stream()
    log.append(s, some(5))
    log.append(other, some(2))
    before = {r.global_position: r for r in log.read_all()}
    log.delete(s, 2)
    assert versions(log.read_stream(s)) == [3, 4, 5]
    log.delete(s, 1)  # below what is there
    left = collect(log.read_all())
    assert len(left) == 5 and all(before[r.global_position] == r for r in left)
    log.delete(s, 10)
    assert collect(log.read_stream(s)) == []  # empty, not absent
    with pytest.raises(StreamVersionMismatch):
        log.append(s, some(1), must_not_exist=True)
    assert versions(log.append(s, some(1), expect_version=5)) == [6]


def test_deletion_frees_the_id(log):
    s = stream()
    with pytest.raises(StreamNotFound):
        log.delete(s)
    with pytest.raises(ValueError):
        log.delete(s, -1)
    log.append(s, some(3))
    last = log.position()
    log.delete(s)
    with pytest.raises(StreamNotFound):
        log.read_stream(s)
    assert collect(log.read_all()) == []
    again = log.append(s, some(2), must_not_exist=True)
    assert versions(again) == [1, 2] and again[0].global_position > last
    assert versions(log.read_stream(s)) == [1, 2]


def test_two_writers_and_a_stalled_commit(spark, tmp_path):
    s, root = stream(), str(tmp_path / "log")
    second = EventLog(spark, root)
    calls = []

    def stall():
        if not calls:
            calls.append(1)
            second.append(s, some(1))

    first = EventLog(spark, root, before_commit=stall)
    rows = first.append(s, some(2))  # loses the race, and numbers anew
    assert versions(rows) == [2, 3]
    assert versions(second.read_stream(s)) == [1, 2, 3]
    calls.clear()
    with pytest.raises(StreamVersionMismatch):
        first.append(s, some(1), expect_version=3)
    assert [r.global_position for r in second.read_all()] == [1, 2, 3, 4]


def test_random_scripts_against_a_list(spark, tmp_path):
    rnd = random.Random(5)
    log = EventLog(spark, str(tmp_path / "log"))
    ids, model, tips, position = [stream() for _ in range(3)], [], {}, 0
    for _ in range(12):
        s, what = rnd.choice(ids), rnd.random()
        if what < 0.6 or s not in tips:
            n = rnd.randint(1, 3)
            log.append(s, some(n))
            for _ in range(n):
                position += 1
                tips[s] = tips.get(s, 0) + 1
                model.append((position, str(s), tips[s]))
        else:
            to = rnd.choice([0, rnd.randint(1, 6)])
            log.delete(s, to)
            model = [e for e in model if e[1] != str(s) or to and e[2] > to]
            if to == 0:
                del tips[s]
    assert [(r.global_position, r.stream_id, r.stream_version) for r in log.read_all()] == model
    for s in tips:
        assert versions(log.read_stream(s)) == [e[2] for e in model if e[1] == str(s)]


def test_reads_open_only_files_that_can_match(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "pruned"))
    a, b = TypedId.new_v4("storetest"), TypedId.new_v4("storetest")
    for stream, n in ((a, 2), (b, 3), (a, 2), (b, 1)):
        log.append(stream, [Proposed("eventtype")] * n)
    files = lambda events: len(events.df.inputFiles())
    assert files(log.read_stream(a)) == 2 and files(log.read_stream(a, 2)) == 1 and files(log.read_stream(a, 2, direction=Direction.REVERSE)) == 1
    assert files(log.read_all(5)) == 2 and [r.global_position for r in log.read_all(5)] == [6, 7, 8]
    assert [r.stream_version for r in log.read_stream(a, 1)] == [2, 3, 4] and [r.stream_version for r in log.read_stream(b, 3, direction=Direction.REVERSE)] == [3, 2, 1]
    assert "GreaterThan(global_position,5)" in log.read_all(5).df._jdf.queryExecution().executedPlan().toString()
    log.delete(a, 1)
    assert [r.stream_version for r in log.read_stream(a)] == [2, 3, 4] and len(list(log.read_all())) == 7
