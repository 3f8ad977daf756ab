"""Exact repeats of a fixed length over a whole corpus, in supersteps between chunks of text and shards of passages.

A window is ``length`` consecutive units (words or bytes) of one document. To find every window whose content also
starts elsewhere without shuffling a row for each position:

* Each window has an anchor: the phrase of ``phrase`` units with the least fingerprint in it. Equal windows have equal
  anchors at equal offsets, at any distance and across documents. Consecutive windows with one anchor form a region.
* Superstep 1: every chunk sends the sorted fingerprints of its anchors and of its regions. A bucket (a range of
  fingerprints) sorts what it got and answers how often each occurs, and which chunk speaks for it.
* Superstep 2: regions whose anchor occurs more than once go to the anchor's shard: their text from the one chunk that
  speaks for them, their key from the others. All places where a passage of the shard can be stream through it there:
  the operator's own method (``decide``: automata, suffix arrays) says which windows of each region are repeats.
* Superstep 3: each chunk learns the repeated windows of its regions; what they cover follows.

Chunks, buckets and shards hold a bounded amount whatever the skew: a chunk sends each distinct key once, with its count, so
a passage that a third of all documents hold costs a shard one entry a chunk and one text. An anchor that occurs more than
HOT times doesn't gather its regions: their windows go to shards by their own fingerprint, each as a passage of its own.
Text is shuffled once (the three uses share one exchange); keys and passages go as packed blobs. Fingerprints have 64
bits and decide where things meet; two different regions would have to agree in one to be taken for equal, by
chance with probability n * n / 2**65 for n regions.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import parts, texts

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MESSAGES = "dest long, src long, kind int, payload binary"
KEYS, COUNTS, STATE, ITEMS = 0, 1, 2, 3
MARK = np.uint32(1 << 31)
PLACE = np.uint64((1 << 20) - 1)
#: Bytes of input files in a chunk of text; regions of an anchor beyond which its windows go by themselves; bytes of passages
#: that a shard decides at once, about.
CHUNK_BYTES, HOT, AT_ONCE = 1_200_000, 4096, 1_000_000

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(n + n // 4 + 1, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Text:
    """The documents of a chunk: one buffer, and for each unit where it starts, ends and whose it is."""

    def __init__(self, ids: np.ndarray, raw: list[bytes], words: bool):
        self.ids, self.words = ids, words
        self.raw = [b" ".join(x.split()) for x in raw] if words else raw
        self.buffer = b"\n".join(self.raw) if words else b"".join(self.raw)
        data = np.frombuffer(self.buffer, np.uint8)
        sizes = np.array([len(x) for x in self.raw], np.int64)
        if words:
            cut = np.flatnonzero((data == 32) | (data == 10))
            self.starts = np.concatenate([[0], cut + 1]).astype(np.int64)
            self.ends = np.concatenate([cut, [len(data)]]).astype(np.int64)
            full = self.ends > self.starts  # an empty document leaves an empty piece
            self.starts, self.ends = self.starts[full], self.ends[full]
            self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        else:
            self.starts = np.arange(len(data), dtype=np.int64)
            self.ends = self.starts + 1
            self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.offsets[:-1])  # first unit of each document
        self.last = np.append(self.first[1:], len(self.starts))
        self.data, self._sums = data, None

    def fingerprints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from begin to end, for units given by their numbers (end exclusive)."""
        if self._sums is None:
            n = len(self.data)
            self.up, self.down = _power(n + 1)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(TABLE[self.data] * self.up[:n], out=self._sums[1:], dtype=np.uint64)
        s, e = self.starts[begin], self.ends[end - 1]
        return mix((self._sums[e] - self._sums[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, length: int) -> np.ndarray:
        """Numbers of the units at which a window starts."""
        n = np.maximum(0, self.last - self.first - length + 1)
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        return np.repeat(self.first - (np.cumsum(n) - n), n) + np.arange(total)

    def regions(self, length: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each region: its sample's key, its own key, and its first and last window (numbers of units)."""
        at = self.windows(length)
        if not len(at):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        n = len(self.starts) - phrase + 1
        # the place, in the low bits, tells apart two occurrences of a sample: a region has one
        least = self.fingerprints(np.arange(n), np.arange(n) + phrase) & ~PLACE | np.arange(n, dtype=np.uint64) & PLACE
        span, have = length - phrase + 1, 1
        while have < span:  # the least of ever longer spans; those that leave a document aren't asked for
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        sample = least[at]
        edge = np.flatnonzero((sample[1:] != sample[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first, last = at[np.concatenate([[0], edge])], at[np.concatenate([edge - 1, [len(at) - 1]])]
        sample = sample[np.concatenate([[0], edge])] >> np.uint64(20)
        return mix(sample ^ np.uint64(0x5851F42D4C957F2D)), mix(self.fingerprints(first, last + length) ^ np.uint64(0x14057B7EF767814F)), first, last


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from first to last of each, and whose it is."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts (2**30 at most)."""
    if times is None:
        keys, n = np.unique(keys, return_counts=True)
    else:
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, times, len(keys)) if len(keys) else np.zeros(0)
    return keys, np.minimum(n, 1 << 30).astype(np.uint32)


def _messages(rows: list[tuple]) -> pa.Table:
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"dest": pa.array(a, pa.int64()), "src": pa.array(b, pa.int64()), "kind": pa.array(c, pa.int32()), "payload": pa.array(d, pa.binary())})


def _ask(chunk: int, buckets: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Sorted keys and counts, cut up by bucket. Counts of 1 only, the usual case, take no room."""
    bucket = (keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        i, j = cut[b], cut[b + 1]
        n = counts[i:j]
        rows.append((int(b), chunk, KEYS, struct.pack("<q", j - i) + keys[i:j].tobytes() + (b"" if (n == 1).all() else n.tobytes())))
    return rows


def _asked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", payload)
    rest = payload[8 + 8 * n :]
    return np.frombuffer(payload, np.uint64, n, 8), np.frombuffer(rest, np.uint32) if rest else np.ones(n, np.uint32)


def answer(t: pa.Table) -> pa.Table:
    """A bucket: sorts the keys of all chunks; each chunk gets the total of each of its keys, in its order, with a mark
    if this chunk is the one that speaks for the key. What is addressed to a chunk goes on."""
    rows = sorted(zip(*(t.column(x).to_pylist() for x in ("src", "kind", "payload")), strict=True))
    out = [(src, src, kind, payload) for src, kind, payload in rows if kind == STATE]
    asked = [(src, *_asked(payload)) for src, kind, payload in rows if kind == KEYS]
    if asked:
        keys = np.concatenate([x[1] for x in asked])
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.concatenate([x[2] for x in asked])[order])
        reply = np.empty(len(keys), np.uint32)
        reply[order] = np.minimum(total, 1 << 30).astype(np.uint32)[group] | np.where(new, MARK, np.uint32(0))
        bucket, at = int(t.column("dest")[0].as_py()), 0
        for src, k, _ in asked:
            out.append((src, bucket, COUNTS, reply[at : at + len(k)].tobytes()))
            at += len(k)
    return _messages(out)


def _told(t: pa.Table) -> tuple[list[bytes], bytes]:
    """What the buckets answered a chunk, in the order of its keys; its own state."""
    rows = sorted(zip(*(t.column(x).to_pylist() for x in ("src", "kind", "payload")), strict=True), key=lambda x: x[0])
    return [p for _, k, p in rows if k == COUNTS], next((p for _, k, p in rows if k == STATE), b"")


class Items(NamedTuple):
    """What a chunk asks shards about, once each and in order: the key that tells the shard, its own key, its first and last
    window, and how often the chunk has it; ``of`` says which item each asking region, and then each asking window of hot
    anchors, is."""

    anchor: np.ndarray
    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    times: np.ndarray
    of: np.ndarray


def _items(text: Text, length: int, found: tuple[np.ndarray, ...], ask: np.ndarray, hot: np.ndarray) -> Items:
    sample, region, a, b = (x[ask & ~hot] for x in found)
    at, _ = _spread(found[2][ask & hot], found[3][ask & hot])
    prints = text.fingerprints(at, at + length) if len(at) else np.zeros(0, np.uint64)
    anchor, key, a, b = np.concatenate([sample, prints]), np.concatenate([region, prints]), np.concatenate([a, at]), np.concatenate([b, at])
    if not len(key):
        return Items(anchor, key, a, b, np.zeros(0, np.uint32), np.zeros(0, np.int64))
    order = np.lexsort((key, anchor))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    lead = order[new]
    return Items(anchor[lead], key[lead], a[lead], b[lead], np.bincount(of).astype(np.uint32), of)


def _ask_about(chunk: int, buckets: int, items: Items, speaks: np.ndarray, text: Text, length: int) -> list[tuple]:
    """Items cut up by shard, with the texts of those that the chunk speaks for."""
    bucket = (items.anchor >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    begin, end = text.starts[items.first], text.ends[items.last + length - 1]
    size, windows, rows = np.where(speaks, end - begin, 0).astype(np.uint32), (items.last - items.first + 1).astype(np.uint32), []
    pack = zstandard.ZstdCompressor(1).compress
    for b in np.flatnonzero(np.diff(cut)):
        i, j = cut[b], cut[b + 1]
        blob = b"".join([text.buffer[x:y] for x, y, z in zip(begin[i:j].tolist(), end[i:j].tolist(), speaks[i:j].tolist(), strict=True) if z])
        rows.append((int(b), chunk, ITEMS, struct.pack("<q", j - i) + pack(b"".join([x[i:j].tobytes() for x in (items.anchor, items.key, items.times, windows, size)]) + blob)))
    return rows


def decided(t: pa.Table, decide: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """A shard: gathers what chunks ask about, decides each distinct passage once, and answers each chunk with the bits of its
    items' windows, each item in whole bytes. What is addressed to a chunk goes on."""
    rows = sorted(zip(*(t.column(x).to_pylist() for x in ("src", "kind", "payload")), strict=True))
    out = [(src, src, kind, payload) for src, kind, payload in rows if kind == STATE]
    unpack, asked, raw = zstandard.ZstdDecompressor().decompress, [], []
    for src, kind, payload in rows:
        if kind == ITEMS:
            (n,) = struct.unpack_from("<q", payload)
            body = unpack(payload[8:])
            asked.append((src, np.frombuffer(body, np.uint64, 2 * n).reshape(2, n), np.frombuffer(body, np.uint32, 3 * n, 16 * n).reshape(3, n)))
            ends = np.cumsum(asked[-1][2][2].astype(np.int64)) + 28 * n
            raw += [body[x - y : x] for x, y in zip(ends.tolist(), asked[-1][2][2].tolist(), strict=True)]
    if not asked:
        return _messages(out)
    anchor, key = np.concatenate([x[1] for x in asked], axis=1)
    times, windows, size = np.concatenate([x[2] for x in asked], axis=1).astype(np.int64)
    order = np.lexsort((size == 0, key, anchor))  # a text first
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    lead, total = order[new], np.bincount(of, times).astype(np.int64)
    if not size[lead].all():
        raise ValueError("a passage has no text")
    # one anchor's passages together, and no more at once than is needed
    upto, edge = np.cumsum(size[lead]), [0]
    for k in np.flatnonzero(anchor[lead][1:] != anchor[lead][:-1]) + 1:
        if upto[k - 1] - (upto[edge[-1] - 1] if edge[-1] else 0) >= AT_ONCE:
            edge.append(int(k))
    edge.append(len(lead))
    bits = [decide([raw[k] for k in lead[i:j].tolist()], total[i:j], windows[lead[i:j]]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    room = (windows[lead] + 7) // 8
    start = np.cumsum(room) - room
    flat = np.zeros(8 * int(room.sum()), bool)
    flat[_spread(8 * start, 8 * start + windows[lead] - 1)[0]] = np.concatenate(bits)
    packed, at, bucket = np.packbits(flat), 0, int(t.column("dest")[0].as_py())
    for src, keys, _ in asked:
        mine = of[at : at + keys.shape[1]]
        out.append((src, bucket, COUNTS, packed[_spread(start[mine], start[mine] + room[mine] - 1)[0]].tobytes()))
        at += len(mine)
    return _messages(out)


def _load(t: pa.Table, words: bool) -> tuple[int, Text]:
    """Rows in an order that doesn't depend on how they came."""
    rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist(), range(t.num_rows), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    chunk = int(t.column("chunk")[0].as_py()) if t.num_rows else 0
    text = Text(np.array([r[0] for r in rows], object), [r[1] for r in rows], words)
    text.table = t.take(pa.array([r[2] for r in rows], pa.int64()))
    return chunk, text


def repeats(
    docs: DataFrame, length: int, phrase: int, words: bool, decide: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray], finish: Callable[[Text, np.ndarray], pa.Table], schema: str, carry: tuple[str, ...] = (), settle: bool = False
) -> DataFrame:
    """finish(text, starts) gets each chunk with the units at which a repeated window starts, and makes its result. The
    columns named in ``carry`` are in text.table, a row a document, as _name.

    decide(passages, times, windows) gets distinct passages of a shard, with how often the corpus has each and how many windows;
    it says of each window, end to end, whether it is a repeat. With ``settle``, an anchor all of whose regions are equal
    isn't asked about: its windows repeat as often as the region."""
    chunks = parts(docs, CHUNK_BYTES)
    buckets = max(1, chunks // 4)
    t = texts(docs, carry=carry).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    hot_from = HOT

    def first(table: pa.Table) -> pa.Table:
        chunk, text = _load(table, words)
        sample, region, *_ = text.regions(length, phrase)
        return _messages(_ask(chunk, buckets, *_counted(np.concatenate([sample, region]))))

    def second(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk, text = _load(table, words)
        answers, _ = _told(told)
        if not answers:
            return _messages([])
        counts, found = np.frombuffer(b"".join(answers), np.uint32), text.regions(length, phrase)
        sample, region, *_ = found
        keys = np.unique(np.concatenate([sample, region]))
        own, about = counts[np.searchsorted(keys, region)], counts[np.searchsorted(keys, sample)] & ~MARK
        settled = (about == own & ~MARK) & (about > 1) & settle
        ask, hot = (about > 1) & ~settled, about > hot_from
        items = _items(text, length, found, ask, hot)
        # of equal regions the chunk that a bucket marked speaks, of windows by themselves each does
        marked = np.unique(region[own & MARK > 0])
        speaks = np.isin(items.key, marked) | np.isin(items.anchor, items.key) & (items.anchor == items.key)
        state = (chunk % buckets, chunk, STATE, b"".join(np.packbits(x).tobytes() for x in (settled, ask, hot)))
        return _messages([*_ask_about(chunk, buckets, items, speaks, text, length), state])

    def answered(table: pa.Table) -> pa.Table:
        return decided(table, decide)

    def third(table: pa.Table, told: pa.Table) -> pa.Table:
        _, text = _load(table, words)
        answers, state = _told(told) if table.num_rows else ([], b"")
        if not state:
            return finish(text, np.zeros(0, np.int64))
        found = text.regions(length, phrase)
        n, (_, _, a, b) = len(found[0]), found
        settled, ask, hot = np.unpackbits(np.frombuffer(state, np.uint8).reshape(3, -1), axis=1)[:, :n].astype(bool)
        items = _items(text, length, found, ask, hot)
        bits, room = np.unpackbits(np.frombuffer(b"".join(answers), np.uint8)).astype(bool), (items.last - items.first + 8) // 8
        start = 8 * (np.cumsum(room) - room)
        one, _ = _spread(a[ask & hot], b[ask & hot])
        begin, end = np.concatenate([a[ask & ~hot], one]), np.concatenate([b[ask & ~hot], one])
        at, of = _spread(begin, end)
        often = bits[start[items.of][of] + at - begin[of]] if len(at) else np.zeros(0, bool)
        return finish(text, np.unique(np.concatenate([_spread(a[settled], b[settled])[0], at[often]])))

    m = t.groupBy("chunk").applyInArrow(first, MESSAGES)
    m = m.groupBy("dest").applyInArrow(answer, MESSAGES)
    m = t.groupBy("chunk").cogroup(m.groupBy("dest")).applyInArrow(second, MESSAGES)
    m = m.groupBy("dest").applyInArrow(answered, MESSAGES)
    return t.groupBy("chunk").cogroup(m.groupBy("dest")).applyInArrow(third, schema)


def covered(text: Text, starts: np.ndarray, length: int) -> np.ndarray:
    """Which units a window from starts covers."""
    mark = np.zeros(len(text.starts) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + length, -1)
    return np.cumsum(mark[:-1]) > 0


def documents(text: Text) -> Iterator[tuple[int, object, int, int]]:
    """Number, id, first and last unit (exclusive) of each document."""
    yield from zip(range(len(text.ids)), text.ids, text.first, text.last, strict=True)
