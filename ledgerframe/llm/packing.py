"""Op 3, best-fit packing: patterns of a few lengths fitted to the length histogram by non-negative least squares.

Documents become pieces of at most 2048 tokens. Only their length histogram (at most 2048 numbers) goes to the driver,
which enumerates patterns of two or three lengths that fill a sequence, fits how often each should occur, rounds, and
packs the residue by best fit, longest first, all on counts. The plan says, for each length, which ranks go to which
sequences; its size is bounded by the number of lengths and patterns, whatever the corpus. Executors then place each
piece by its rank among those of its length. Ranks come from counts by length and hash bucket, so that a length that a
third of all pieces have isn't numbered in one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import checkpoint, texts

CAPACITY, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text that are tokenized at once; bytes of words and ids that a worker remembers, until its partition ends.
BATCH_BYTES, REMEMBER = 4_000_000, 16_000_000
#: Hash buckets in which the pieces of one length are numbered.
BUCKETS = 256

#: A word that is letters whose lower case is plain, and then marks: the tokenizer takes it apart just there.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

_loaded: dict[str, Words] = {}


class Words:
    """Ids of words, as bytes. Normalizing takes a tokenizer longer than merging does: plain words are brought to their normal
    form here and merged together in one call, in which a token that ends a word tells where the next begins."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.merge = Tokenizer.from_file(path)
        self.merge.normalizer, self.merge.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size() + 1, bool)
        for token, k in self.full.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.letters = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.words: dict[str, bytes] = {}
        self.room = REMEMBER

    def learn(self, words: list[str]) -> None:
        found = list(map(PLAIN.fullmatch, words))
        plain = [w for w, m in zip(words, found, strict=True) if m]
        odd = [w for w, m in zip(words, found, strict=True) if not m]
        if plain:
            parts = [f"{m[1]} {m[2]}" if m[2] else m[1] for m in found if m]
            joined = " ".join(parts).lower()
            if not joined.isascii():
                for c in set(joined) & self.letters.keys():
                    joined = joined.replace(c, self.letters[c])
            ids = np.array(self.merge.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 + (" " in x) for x in parts]) - 1  # of each word, its last part
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                raise ValueError("the tokenizer doesn't mark the ends of words")
            raw, cut = ids.tobytes(), (4 * ends[last]).tolist()
            self.words.update(zip(plain, (raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)), strict=True))
            self.room -= len(raw) + len(joined)
        for w, e in zip(odd, self.full.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            ids = self.words[w] = np.array(e.ids, np.uint32).tobytes()
            self.room -= len(ids) + len(w)

    def forget(self) -> None:
        self.words.clear()
        self.room = REMEMBER


def encode(raw: pa.Array, path: str) -> list[bytes]:
    """Ids of each text, 32 bits each, END last. White space only separates for this tokenizer: words are encoded once each.
    The tokenizer's special tokens in a text are their own ids, as the library has it."""
    words = _loaded.get(path) or _loaded.setdefault(path, Words(path))
    split = pc.ascii_split_whitespace(raw)
    own = split.flatten().dictionary_encode()
    n, at = len(own.dictionary), own.indices.to_numpy()
    # no word holds white space: joined and split again, which is faster than a scalar at a time
    distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own.dictionary), "\n")[0].as_py().split("\n") if n else []
    if words.room <= 0:
        words.forget()
    ids = list(map(words.words.get, distinct))
    if new := [w for w, x in zip(distinct, ids, strict=True) if x is None]:
        words.learn(new)
        ids = [words.words[w] if x is None else x for w, x in zip(distinct, ids, strict=True)]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    upto = np.concatenate([[0], np.cumsum(size[at])])
    begin = np.cumsum(size) - size
    tokens = np.frombuffer(b"".join(ids), np.uint32)[np.arange(upto[-1]) + np.repeat(begin[at] - upto[:-1], size[at])].tobytes()
    edge = (4 * upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]).tolist()
    end = END.to_bytes(4, "little")
    return [tokens[a:b] + end for a, b in zip(edge[:-1], edge[1:], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    def cut(batches):
        for batch in batches:
            ids, raw = batch.column("doc_id").to_pylist(), batch.column("text")
            size = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = []
                for doc, tokens in zip(ids[a:b], encode(raw.slice(a, b - a), path), strict=True):
                    for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        for words in _loaded.values():  # workers live on and wait for other stages
            words.forget()

    return texts(docs).mapInArrow(cut, PIECES)


def patterns(count: np.ndarray, capacity: int, most: int = 20_000) -> list[tuple[int, ...]]:
    """Two or three lengths that occur and fill a sequence exactly, those of frequent lengths first."""
    have = [int(x) for x in np.flatnonzero(count) if x < capacity]
    common = sorted(have, key=lambda x: -count[x])[:128]
    found = {(capacity - a, a) for a in have if 2 * a <= capacity and count[capacity - a]}
    for a in have:
        for b in common:
            c = capacity - a - b
            if c > 0 and count[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, key=lambda p: (-min(count[x] for x in p), p))[:most]


def fit(count: np.ndarray, pats: list[tuple[int, ...]], sweeps: int = 30) -> list[float]:
    """Non-negative least squares by coordinate descent: x >= 0 with sum of x * pattern near count."""
    rest = [float(x) for x in count]
    x = [0.0] * len(pats)
    parts = [[(n, p.count(n)) for n in set(p)] for p in pats]
    norm = [float(sum(m * m for _, m in p)) for p in parts]
    for _ in range(sweeps):
        moved = 0.0
        for i, p in enumerate(parts):
            step = sum(m * rest[n] for n, m in p) / norm[i]
            step = max(step, -x[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, m in p:
                    rest[n] -= step * m
        if moved < 0.5:
            break
    return x


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold exactly what the histogram counts, in about as few sequences as can be."""
    left = [int(x) for x in count]
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), left[capacity]))
        left[capacity] = 0
    pats = patterns(np.array(left), capacity)
    for x, p in sorted(zip(fit(np.array(left), pats), pats, strict=True), key=lambda t: (-t[0], t[1])):
        n = min([int(x), *(left[k] // p.count(k) for k in set(p))])
        if n > 0:
            out.append((p, n))
            for k in p:
                left[k] -= n
    # the residue: groups of equal sequences by what room they have
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(r: int, p: tuple[int, ...], n: int) -> None:
        if r not in room:
            room[r] = []
            insort(rooms, r)
        room[r].append((p, n))

    for k in range(capacity, 0, -1):
        n = left[k]
        while n:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                each = capacity // k
                if n >= each:
                    put(capacity - each * k, (k,) * each, n // each)
                if n % each:
                    put(capacity - n % each * k, (k,) * (n % each), 1)
                break
            r = rooms[i]
            p, m = room[r].pop()
            if not room[r]:
                del room[r], rooms[i]
            each = min(r // k, max(1, n // m))
            if n < m:
                put(r, p, m - n)
                m = n
            put(r - each * k, p + (k,) * each, m)
            n -= each * m
    out += [x for r in sorted(room) for x in room[r]]
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, from which rank on pieces go to which sequences (one each, in turn) and where in them."""
    rows, ranks, sequence = [], {}, 0
    for p, n in packed:
        offset = 0
        for k in p:
            rows.append((k, ranks.get(k, 0), sequence, offset))
            ranks[k] = ranks.get(k, 0) + n
            offset += k
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id. Repeated rows are packed each. An empty table gives no rows."""
    found = checkpoint(pieces(docs, path, capacity))  # numbers only; counted and then placed
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = found.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        totals[r.length] = r.n
    table = slots(plan(totals, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = found.withColumn("bucket", bucket).withColumn("number", number).join(counts.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    key = table["length"].to_numpy() << 44 | table["rank"].to_numpy()
    first, sequence, offset = (table[c].to_numpy() for c in ("rank", "sequence", "offset"))

    def place(batches):
        for t in batches:
            rank = t.column("rank").to_numpy()
            at = np.searchsorted(key, t.column("length").to_numpy() << 44 | rank, "right") - 1
            put = (pa.array(sequence[at] + rank - first[at]), pa.array(offset[at]))
            yield pa.record_batch([*t.columns[:5], *put], names=[*t.schema.names[:5], "sequence_id", "offset"])

    rank = (F.col("before") + F.col("number")).cast("long").alias("rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank).mapInArrow(place, PIECES + ", sequence_id long, offset long")
