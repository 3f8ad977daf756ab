"""Op 6, near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words. Their document frequencies are exact: chunks of texts send their shingles, packed and counted, to
   shards by hash, whose number grows with the corpus; a shard adds them up and answers each chunk with the totals in the
   order of what it sent. Nothing is broadcast. A text keeps the IDF of its shingles, packed, for what follows.
2. Equal texts (as words) are one class from the start; only one text of each class goes on.
3. Each text gets BANDS * ROWS samples: two texts have the same one with the probability of their weighted Jaccard
   similarity. Texts that agree in all samples of a band meet in a bucket.
4. In a bucket every text is compared with one leader, the one that most texts meet, never with all. The similarity of a
   candidate pair is computed in full. Texts that the leader doesn't hold, few as a rule, are then compared with the whole
   bucket, in blocks of bounded size inside a task; of a text's links to those that the leader holds one is kept, and of
   those among the rest a spanning forest. So no link that joins two parts of a bucket is lost, and no bucket emits its pairs.
5. Classes are the connected components of the verified pairs.

A bucket of any size costs as many pairs as it has texts, and a block for each BLOCK bytes of it and of what its leader
doesn't hold. Buckets are counted before the shuffle and joined by sort-merge, whose skewed partitions the engine splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import checkpoint, texts
from ledgerframe.llm.repeats import Text

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Bytes of text in a chunk, and for each shard of shingles, about; shards at least.
CHUNK, SHARD, LEAST = 4_000_000, 8_000_000, 24
#: Bytes of text on each side of a block, with ROW more for each text; shingles that are sampled at once.
BLOCK, ROW, AT_ONCE = 2_000_000, 2_000, 4096
SEED = 0x6C62272E07BB0142

_random = np.random.default_rng(SEED & 0xFFFFFFFF)
_ODD = _random.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables() -> tuple[np.ndarray, ...]:
    """r, ln c and beta of the sampling, by 16 bits of a hash each: Gamma(2, 1) twice, and uniform."""
    n = 1 << 16
    x = (np.arange(n) + 0.5) / n
    gamma = np.full(n, 1.0)
    for _ in range(60):  # Newton's method on the distribution function 1 - (1 + g) exp(-g)
        gamma -= (1 - (1 + gamma) * np.exp(-gamma) - x) / np.maximum(gamma * np.exp(-gamma), 1e-12)
        gamma = np.clip(gamma, 1e-6, 60)
    return gamma, np.log(gamma), x


R, LN_C, BETA = _tables()


def shingles(raw: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of each text's shingles, in order, with repeats; a text of fewer words is one shingle, one without any has none."""
    for some in _portions(raw):
        text = Text(np.arange(len(some)), some, True)
        at = text.windows(size)
        all_of = text.fingerprints(at, at + size) if len(at) else np.zeros(0, np.uint64)
        n = np.cumsum(np.maximum(0, text.last - text.first - size + 1))
        for k, (a, b) in enumerate(zip(text.first.tolist(), text.last.tolist(), strict=True)):
            if b - a >= size:
                yield all_of[n[k] - (b - a - size + 1) : n[k]]
            elif b > a:
                yield text.fingerprints(np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, np.uint64)


def _portions(raw: list[bytes], most: int = 1_000_000) -> Iterator[list[bytes]]:
    """Of about so many bytes each."""
    some, n = [], 0
    for x in raw:
        some.append(x)
        n += len(x)
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _packed(s: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, so that the shuffle's compression finds the upper ones empty."""
    return np.diff(s, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """IDF is between 1 and 2: shared shingles of a large group of copies keep half the weight of unique ones at least, so that
    a group's size alone doesn't push its members apart."""
    n = max(2, n)
    return (1 + np.log(n / np.clip(df, 1, n)) / np.log(n)).astype(np.float32)


class Idf:
    """IDF of shingles by their document frequencies, all in memory: for small tables."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, shift: int):
        order = np.argsort(keys)
        self.keys, self.df, self.n, self.shift = keys[order], df[order], n, np.uint64(shift)

    def of(self, s: np.ndarray) -> np.ndarray:
        return inverse_frequency(self.df[np.searchsorted(self.keys, s >> self.shift)], self.n)


def weights(raw: list[bytes], idf: Idf | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, distinct shingles in order, and TF * IDF of each. An array holds weights by 20 bits of the hash."""
    for all_of in shingles(raw):
        s, tf = np.unique(all_of, return_counts=True)
        yield s, tf * (idf.of(s) if isinstance(idf, Idf) else idf[(s >> np.uint64(44)).astype(np.int64)])


def kept_weights(raw: Iterable[bytes], kept: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, of texts that come with their IDF."""
    for all_of, idf in zip(shingles(list(raw)), kept, strict=True):
        s, tf = np.unique(all_of, return_counts=True)
        yield s, tf * np.frombuffer(_unpack(idf), np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the lesser weights by that of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    union = float(a[1].sum() + b[1].sum()) - common
    return common / union if union else 0.0


def bands(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of the bands. Of each sample the shingle with the least ln a = ln c - r (t - beta + 1) is taken, with its t,
    where t = floor(ln w / r + beta)."""
    k = np.arange(BANDS * ROWS)
    least, key = np.full(len(k), np.inf), np.zeros(len(k), np.uint64)
    for i in range(0, len(s), AT_ONCE):
        h = s[i : i + AT_ONCE, None] * _ODD
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        r, ln_c, beta = R[(h >> np.uint64(48)).astype(np.int64)], LN_C[(h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)], BETA[(h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(np.log(w[i : i + AT_ONCE])[:, None] / r + beta)
        ln_a = ln_c - r * (t - beta + 1)
        best = np.argmin(ln_a, axis=0)
        new = h[best, k] ^ (t[best, k].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        key, least = np.where(ln_a[best, k] < least, new, key), np.minimum(least, ln_a[best, k])
    key = key.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = (out ^ key[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(30)
    return out.view(np.int64)


class Frequencies(NamedTuple):
    """texts has chunk, node, least, n and text (packed), copies mostly as one row; counts has chunk, shard and df: in how many
    documents each of the chunk's shingles is, in their order; n is the number of documents; of a shingle's hash the bits
    above ``shift`` count: twice as many as their number has and two more, so that hardly two of them agree by chance."""

    texts: DataFrame
    counts: DataFrame
    n: int
    shift: int


def _merged(t: pa.Table) -> tuple[list[bytes], list[int | None], np.ndarray, list[bytes]]:
    """Nodes of a chunk, once each and in order: node, least doc_id, number of documents and text."""
    of: dict[bytes, list] = {}
    for node, least, n, k in zip(*(t.column(c).to_pylist() for c in ("node", "least", "n")), range(t.num_rows), strict=True):
        row = of.setdefault(node, [least, 0, k])
        row[1] += n
        row[0] = min((x for x in (row[0], least) if x is not None), default=None)
    nodes = sorted(of)
    raw = t.column("text").take(pa.array([of[x][2] for x in nodes], pa.int64())).to_pylist()
    return nodes, [of[x][0] for x in nodes], np.array([of[x][1] for x in nodes], np.int64), list(map(_unpack, raw))


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[list], pa.Array]]:
    """Texts of a batch that have words, equal ones once: nodes; least doc_id and number of each; texts, packed. So a group of
    copies of any size is a row a batch before it is shuffled."""
    for b in batches:
        of: dict[bytes, list] = {}
        raw = b.column("text").cast(pa.binary()).to_pylist()
        for k, (text, doc_id) in enumerate(zip(raw, b.column("doc_id").to_pylist(), strict=True)):
            if node := digest(text):
                row = of.setdefault(node, [doc_id, 0, k])
                row[1] += 1
                if doc_id is not None and (row[0] is None or doc_id < row[0]):
                    row[0] = doc_id
        yield list(of), [x[:2] for x in of.values()], pa.array([_pack(raw[x[2]]) for x in of.values()], pa.binary())


def _of_chunk(raw: list[bytes], shift: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Each text's distinct shingles and how often it has them; the chunk's, in order; which of those each text's are, end to end."""
    each = [np.unique(x, return_counts=True) for x in shingles(raw)]
    keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in each)]) >> np.uint64(shift), return_inverse=True)
    return each, keys, at


def document_frequencies(docs: DataFrame) -> Frequencies:
    """How many documents have each shingle, exactly, copies and documents without an id included."""
    size = texts(docs).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total = size.bytes or 0
    chunks, shards, bits = total // CHUNK + 1, max(LEAST, total // SHARD + 1), min(64, 2 * max(1, total // 4).bit_length() + 2)
    shift = 64 - bits

    def combine(batches):
        for nodes, rows, packed in _distinct(batches):
            chunk = pa.array([int.from_bytes(x[:8], "big") % chunks for x in nodes], pa.int64())
            yield pa.record_batch([chunk, pa.array(nodes, pa.binary()), *(pa.array([x[k] for x in rows], pa.int64()) for k in range(2)), packed], names=["chunk", "node", "least", "n", "text"])

    def send(t: pa.Table) -> pa.Table:
        _, _, n, raw = _merged(t)
        each, keys, at = _of_chunk(raw, shift)
        counts = np.bincount(at, np.repeat(n, [len(x) for x, _ in each]), len(keys)).astype(np.int64)
        shard = (keys >> np.uint64(bits - min(bits, 32))).astype(np.int64) * shards >> min(bits, 32)  # in order, as keys are
        cut = np.searchsorted(shard, np.arange(shards + 1))
        rows = [k for k in range(shards) if cut[k] < cut[k + 1]]
        pieces = [[f(x[cut[k] : cut[k + 1]]) for k in rows] for x, f in ((keys, _packed), (counts, np.ndarray.tobytes))]
        return pa.table([pa.array(rows, pa.int64()), pa.array([t.column("chunk")[0].as_py()] * len(rows), pa.int64()), *(pa.array(x, pa.binary()) for x in pieces)], names=["shard", "chunk", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        keys = [_unpacked(x) for x in t.column("keys").to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])).astype(np.int64)[at]
        parts = np.split(total, np.cumsum([len(x) for x in keys])[:-1])
        return pa.table([t.column("chunk"), t.column("shard"), pa.array([_pack(x.tobytes()) for x in parts], pa.binary())], names=["chunk", "shard", "df"])

    combined = texts(docs).mapInArrow(combine, "chunk long, node binary, least long, n long, text binary")
    sent = combined.groupBy("chunk").applyInArrow(send, "shard long, chunk long, keys binary, counts binary")
    return Frequencies(combined, sent.groupBy("shard").applyInArrow(add, "chunk long, shard long, df binary"), size.n, shift)


def _answered(counts: pa.Table) -> np.ndarray:
    """Frequencies of a chunk's shingles in their order: shards are ranges."""
    rows = sorted(zip(counts.column("shard").to_pylist(), counts.column("df").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(_unpack(x), np.int64) for _, x in rows)])


def inverse(df: Frequencies) -> Idf:
    """Of all shingles at once, for small tables."""
    shift = df.shift

    def run(mine: pa.Table, counts: pa.Table) -> pa.Table:
        _, keys, _ = _of_chunk(_merged(mine)[3], shift)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(_answered(counts))], names=["key", "df"])

    rows = df.texts.groupBy("chunk").cogroup(df.counts.groupBy("chunk")).applyInArrow(run, "key long, df long").distinct().collect()
    return Idf(np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.df for r in rows], np.int64), df.n, shift)


def digest(text: bytes) -> bytes | None:
    """Of the words of a text; none without any."""
    words = b" ".join(text.split())
    return hashlib.md5(words, usedforsecurity=False).digest() if words else None


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, content) of each row."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(map(digest, b.column("text").cast(pa.binary()).to_pylist()), pa.binary())], names=["doc_id", "content"])

    return texts(docs).mapInArrow(run, "doc_id long, content binary")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, text), packed; copies once a batch."""

    def run(batches):
        for nodes, _, packed in _distinct(batches):
            yield pa.record_batch([pa.array(nodes, pa.binary()), packed], names=["node", "text"])

    return texts(docs).mapInArrow(run, "node binary, text binary")


def signatures(df: Frequencies) -> DataFrame:
    """(node, least, size, bands, idf) of each distinct text: its least doc_id, size in bytes, the keys of the bands, and
    the IDF of its distinct shingles in order, packed."""
    n, shift = df.n, df.shift

    def sign(mine: pa.Table, counts: pa.Table) -> pa.Table:
        nodes, least, _, raw = _merged(mine)
        each, _, at = _of_chunk(raw, shift)
        idf, upto = inverse_frequency(_answered(counts), n)[at], np.cumsum([0, *(len(x) for x, _ in each)])
        keys, kept = [], []
        for k, (s, tf) in enumerate(each):
            own = idf[upto[k] : upto[k + 1]]
            keys.append(bands(s, tf * own).tolist())
            kept.append(_pack(own.tobytes()))
        return pa.table([pa.array(nodes, pa.binary()), pa.array(least, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["node", "least", "size", "bands", "idf"])

    return df.texts.groupBy("chunk").cogroup(df.counts.groupBy("chunk")).applyInArrow(sign, "node binary, least long, size long, bands array<long>, idf binary")


def _shuffled(df: DataFrame) -> DataFrame:
    """Sides of joins here grow with the corpus. They meet by shuffle: none goes through the driver as a broadcast."""
    return df.hint("merge")


def _verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs that are as similar as that; known has the text and IDF of each."""
    side = lambda c: _shuffled(known.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"), F.col("idf").alias(f"idf_{c}")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for t in batches:
            xs, ys = (t.column(c).to_pylist() for c in ("a", "b"))
            of = dict(zip([*xs, *ys], zip([*t.column("text_a").to_pylist(), *t.column("text_b").to_pylist()], [*t.column("idf_a").to_pylist(), *t.column("idf_b").to_pylist()], strict=True), strict=True))
            ok = []  # each text of a portion is cut into shingles once
            for k in range(0, len(xs), 200):
                part = sorted({*xs[k : k + 200], *ys[k : k + 200]})
                seen = dict(zip(part, kept_weights([_unpack(of[x][0]) for x in part], [of[x][1] for x in part]), strict=True))
                ok += [similarity(seen[x], seen[y]) >= threshold for x, y in zip(xs[k : k + 200], ys[k : k + 200], strict=True)]
            yield pa.record_batch([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b", "idf_a", "idf_b").mapInArrow(check, "a binary, b binary")


def _links(nodes: list[bytes], asks: np.ndarray, member: np.ndarray, loose: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[bytes, bytes]]:
    """Of a block: links of those that ask with members, without those that close a ring. Members that aren't loose are
    linked already, by their leader."""
    start = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])])
    vocabulary, at = np.unique(np.concatenate([s for s, _ in found]), return_inverse=True)
    w = np.concatenate([x for _, x in found]).astype(np.float64)
    total, own = np.add.reduceat(w, start[:-1]), np.zeros(len(vocabulary))
    root, out = list(range(len(nodes))), []
    held = np.flatnonzero(~loose)
    for j in held:
        root[j] = int(held[0])

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in np.flatnonzero(asks):
        part = slice(start[i], start[i + 1])
        own[at[part]] = w[part]
        common = np.add.reduceat(np.minimum(own[at], w), start[:-1])
        own[at[part]] = 0
        for j in np.flatnonzero(member & (common >= threshold * (total[i] + total - common))):
            x, y = top(int(i)), top(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return out


def _blocks(led: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of texts that a bucket's leader doesn't hold, with all others of the bucket. led has band, key, node,
    size and loose (not held) of all but the leaders."""
    weight = F.col("size") + F.lit(ROW)
    sums = led.groupBy("band", "key").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("loose"), weight)).alias("some"), F.count(F.lit(1)).alias("n")).where("some is not null and n > 1")
    count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK))
    sides = led.join(_shuffled(sums.select("band", "key", count("all").alias("rows"), count("some").alias("cols"))), ["band", "key"])
    own = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asking = sides.where("loose").select("band", "key", "node", "loose", F.lit(False).alias("member"), own("cols", 1).alias("col"), upto("rows").alias("row"))
    asked = sides.select("band", "key", "node", "loose", F.lit(True).alias("member"), own("rows", 2).alias("row"), upto("cols").alias("col"))
    rows = asking.unionByName(asked).join(_shuffled(known), "node")

    def compare(t: pa.Table) -> pa.Table:
        of: dict[bytes, list] = {}  # a text may be on both sides
        for node, loose, member, idf, text in zip(*(t.column(c).to_pylist() for c in ("node", "loose", "member", "idf", "text")), strict=True):
            row = of.setdefault(node, [False, False, loose, text, idf])
            row[member] = True
        nodes = sorted(of)
        asks, member, loose = (np.array([of[x][k] for x in nodes], bool) for k in range(3))
        out = _links(nodes, asks, member, loose, list(kept_weights([_unpack(of[x][3]) for x in nodes], [of[x][4] for x in nodes])), threshold) if asks.any() else []
        return pa.table([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["a", "b"])

    return rows.groupBy("band", "key", "row", "col").applyInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node of the connected component, of each node that has a link. Labels spread to neighbours and
    then jump to the label of their label, until nothing changes; each round is checkpointed."""
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("class")))
    while True:
        near = both.join(_shuffled(labels), both.b == labels.node).groupBy("a").agg(F.min("class").alias("near"))
        spread = labels.join(_shuffled(near), labels.node == near.a).select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        to = labels.select(F.col("node").alias("class"), F.col("class").alias("root"))
        jumped = checkpoint(spread.join(_shuffled(to), "class").select("node", "old", F.least("class", "root").alias("class")))
        labels = jumped.select("node", "class")
        if not jumped.where("old <> class").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) for each row of docs.

    Documents without words, null or empty, are classes of their own. Each row has the class of its own text, also if its
    doc_id is repeated. Rows with a null doc_id have a null class and join no others. An empty table gives no rows."""
    equal = checkpoint(signatures(document_frequencies(docs)).where("least is not null"))
    at = equal.select("node", "size", F.posexplode("bands").alias("band", "key"))
    many = at.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpoint(at.join(_shuffled(many), ["band", "key"]))  # texts that meet others, in each bucket
    popular = checkpoint(met.groupBy("node").agg(F.sum("n").alias("pop")))
    known = distinct_texts(docs).join(_shuffled(equal.join(_shuffled(popular.select("node")), "node", "left_semi").select("node", "idf")), "node")
    known = checkpoint(known.groupBy("node").agg(F.first("text").alias("text"), F.first("idf").alias("idf")))  # in place, after the join's shuffle
    ranked = met.join(_shuffled(popular), "node")
    lead = ranked.groupBy("band", "key").agg(F.max(F.struct("pop", "node")).alias("lead")).select("band", "key", F.col("lead.node").alias("lead"))
    led = checkpoint(met.join(_shuffled(lead), ["band", "key"]).where("node <> lead").select("band", "key", "node", "size", "lead"))
    star = checkpoint(_verified(led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), known, threshold))
    held = led.join(_shuffled(star), (F.least("node", "lead") == star.a) & (F.greatest("node", "lead") == star.b), "left")
    loose = checkpoint(held.select("band", "key", "node", "size", F.col("a").isNull().alias("loose")))
    links = checkpoint(star.union(_blocks(loose, known, threshold)))
    classes = components(links)
    roots = equal.join(_shuffled(classes), "node", "left").select("node", "least", F.coalesce("class", "node").alias("class"))
    least = roots.groupBy("class").agg(F.min("least").alias("class_id"))
    of = roots.join(_shuffled(least), "class").select(F.col("node").alias("content"), "class_id")
    out = contents(docs).join(_shuffled(of), "content", "left")
    return out.select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
