"""Op 10, suffix-array dedup: repeated byte strings by difference-cover blockwise suffix sorting.

Passages that can hold repeats meet in shards (see repeats.py). A shard's text gets ranks for the suffixes of its difference
cover, every position that is 0 or 1 modulo 3: the cover is closed under steps of 3, so ranks double their depth by pairs
of ranks, without the other suffixes. Then the suffixes at which a window starts are sorted, one bucket of their
first bytes at a time, so that only the ranks and one bucket are held: any two positions have a distance below 3 at which
both are in the cover, so a tie is resolved by that many bytes and a rank, however long it is. Neighbours in that order
which agree for the whole length, by the same ranks, are repeats. Ranks come from comparing bytes, not from fingerprints.

Between documents no order is needed beyond the length asked for: suffixes in different shards can't share a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerframe.llm.repeats import Text, covered, documents, repeats

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Period and residues of the difference cover; suffixes that are sorted at once, about.
PERIOD, COVER, BUCKET = 3, (0, 1), 1 << 16
#: OFFSET[a][b]: least distance at which positions of residues a and b are both in the cover.
OFFSET = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


class CoverRanks:
    """Ranks of the suffixes of the cover by their first ``depth`` bytes, for depths of 3, 6, 12 and so on, up to one that is as
    long as ``length``; kept are those that are needed to compare ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.length = length
        self.data = np.concatenate([data, np.zeros(2 * length + 4 * PERIOD + 8, np.uint8)])
        self.head = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))  # eight bytes from each position on
        n = (len(data) + length) // PERIOD + 1
        at = (np.arange(n)[:, None] * PERIOD + np.array(COVER)).ravel()
        whole = (length - PERIOD + 1) // PERIOD  # periods that fit after any distance
        rank = np.unique(self.head[at].astype(np.uint64) >> np.uint64(64 - 8 * PERIOD), return_inverse=True)[1].astype(np.int64) + 1
        self.levels: list[tuple[int, np.ndarray]] = []
        periods = 1
        while True:
            if whole & periods:
                self.levels.append((periods * PERIOD, rank.astype(np.uint32)))
            if periods * PERIOD >= length:
                break
            step = periods * len(COVER)
            after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
            rank = np.unique(rank << 32 | after, return_inverse=True)[1].astype(np.int64) + 1
            periods *= 2
        self.rank, self.tail = rank, whole * PERIOD

    def _index(self, p: np.ndarray) -> np.ndarray:
        """Of positions in the cover."""
        return p // PERIOD * len(COVER) + p % PERIOD

    def keys(self, p: np.ndarray, distance: int) -> np.ndarray:
        """Bytes up to the distance, and the rank there: in the order of the suffixes."""
        front = self.head[p].astype(np.uint64) >> np.uint64(64 - 8 * distance) if distance else np.zeros(len(p), np.uint64)
        return front << np.uint64(40) | self.rank[self._index(p + distance)].astype(np.uint64)

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffixes share their first ``length`` bytes, pair by pair."""
        d = OFFSET[x % PERIOD, y % PERIOD]
        same = np.ones(len(x), bool)
        for k in range(PERIOD - 1):
            same &= (self.data[x + k] == self.data[y + k]) | (d <= k)
        at = d.copy()
        for depth, rank in reversed(self.levels):
            same &= rank[self._index(x + at)] == rank[self._index(y + at)]
            at += depth
        for k in range(self.tail, self.length):
            same &= self.data[x + k] == self.data[y + k]
        return same


def _sorted(ranks: CoverRanks, p: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes: each residue by itself, and merged by comparing at the distance of each two."""
    classes = [p[p % PERIOD == r] for r in range(PERIOD)]
    classes = [x[np.argsort(ranks.keys(x, int(OFFSET[r, r])), kind="stable")] for r, x in enumerate(classes)]
    place = []
    for r, x in enumerate(classes):
        own = np.arange(len(x))
        for other, y in enumerate(classes):
            if other != r and len(x) and len(y):
                d = int(OFFSET[r, other])
                own = own + np.searchsorted(ranks.keys(y, d), ranks.keys(x, d), "right" if other < r else "left")
        place.append(own)
    return np.concatenate(classes)[np.argsort(np.concatenate(place), kind="stable")]


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes that start there share their first ``length`` bytes with another of them. Each has as many bytes."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    ranks = CoverRanks(data, length)
    head = ranks.head[starts].astype(np.uint64) >> np.uint64(max(0, 64 - 8 * length))
    splitters = np.unique(np.sort(head)[BUCKET::BUCKET])
    bucket = np.searchsorted(splitters, head, "right")
    for k in range(len(splitters) + 1):
        mine = np.flatnonzero(bucket == k)
        if len(mine) > 1:
            order = _sorted(ranks, starts[mine])
            same = ranks.agree(order[:-1], order[1:])
            again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            out[mine] = np.isin(starts[mine], order[again])
    return out


def remove_repeated_bytes(docs: DataFrame, length: int = 400, sample: int = 64) -> DataFrame:
    """One row for each row of docs. Texts shorter than ``length`` bytes, empty and null ones keep all; of repeated
    rows all copies lose what repeats; a text of any length is read whole, by the chunk that holds it."""

    def decide(passages: list[bytes], times: np.ndarray, windows: np.ndarray) -> np.ndarray:
        size = windows + length - 1
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(windows)), windows)
        starts = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[own]
        return repeated_suffixes(np.frombuffer(b"".join(passages), np.uint8), starts, length) | (times[own] > 1)

    def finish(text: Text, starts: np.ndarray) -> pa.Table:
        gone = covered(text, starts, length)
        rows = []
        for k, doc, a, b in documents(text):
            g = gone[a:b]
            n = int(g.sum())
            kept = text.data[a:b][~g].tobytes() if n else text.raw[k]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            rows.append((doc, b - a, n, spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs, length, sample, False, decide, finish, SCHEMA, settle=True)


ORACLE = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
h AS (SELECT r, doc_id, t, hex(t) AS x, octet_length(t) AS n FROM b),
win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM h, unnest(range(0, n - 399)) u(i)),
st AS (SELECT r, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS d FROM st),
run AS (SELECT r, i, sum(CASE WHEN d IS NULL OR d > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s FROM g),
span AS (SELECT r, s, min(i) AS a, max(i) + 400 AS e FROM run GROUP BY r, s),
gap AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
part AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, string_agg(substr(h.x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM gap JOIN h USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM h LEFT JOIN part USING (r)
"""
