"""Op 5, exact top-k inner products with a pivot table.

The table holds each vector's distances to many pivots, computed once. With the norms, they give the inner products with the
pivots, and so the vector's part in their span and the length r of the rest. What is left unknown of <q, x> is at most
r(q) r(x): this is the largest lower bound on the distance d(q, x) (2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2) that the
distances to all pivots allow, at least as large as any pivot's triangle inequality gives by itself.

Candidates are evaluated in the order of that bound until it falls below the k-th best score: exact. The k-th best score
starts from a bounded sample of vectors and carries on through a cell. Cells are a grid: a part of the candidates meets a
part of the queries, both of bounded size, and k results a cell and query leave it; no pair of rows is emitted, and nothing
but the sample and the pivots goes to every task.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a cell, about; pivots; vectors of the sample that gives pivots and first thresholds.
CANDIDATES, QUERIES, PIVOTS, SAMPLE = 16_384, 4096, 56, 2000
FOUND = "query_id long, row binary, times long, vec_id long, score long"


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, whole numbers as doubles. Null vectors and ones that hold nulls, NaN or
    infinities go; so do rows without a vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, bad)
    # floor() of a double is a long in SQL: beyond its range doubles are whole already
    whole = lambda x: F.when(F.abs(x * scale) < F.lit(2.0**53), F.floor(x * scale).cast("double")).otherwise(x * scale)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).select("vec_id", F.transform(v, whole).alias("v"))


class Table(NamedTuple):
    """Vectors as rows: ids, components, distances to the pivots, how often the row occurs."""

    ids: np.ndarray
    x: np.ndarray
    distances: np.ndarray
    times: np.ndarray


class Pivots:
    """From a bounded sample, farthest first; without those in the span of the ones before."""

    def __init__(self, sample: np.ndarray, most: int = PIVOTS):
        np.seterr(over="ignore", invalid="ignore")
        at, far, got, basis = 0, np.full(len(sample), np.inf), [], np.zeros((sample.shape[1], 0))
        scale = np.abs(sample).max(initial=1.0)
        x = sample / scale
        while len(got) < min(most, len(x)) and far[at] > 0:
            rest = x[at] - basis @ (basis.T @ x[at])
            rest -= basis @ (basis.T @ rest)
            if np.linalg.norm(rest) > 1e-6 * max(1e-300, np.linalg.norm(x[at])):
                got.append(at)
                basis = np.hstack([basis, (rest / np.linalg.norm(rest))[:, None]])
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
            far[at] = 0
            at = int(far.argmax())
        self.points = sample[got]
        self.square = (self.points**2).sum(1)
        # coordinates in the span from inner products with the pivots
        self.solve = np.linalg.inv(basis.T @ self.points.T) if got else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        np.seterr(over="ignore", invalid="ignore")
        square = (x**2).sum(1)[:, None] + self.square[None] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def split(self, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Norms, coordinates in the span, the most that the rest's length can be, and what rounding can put on coordinates."""
        square = (t.x**2).sum(1)
        c = ((square[:, None] + self.square[None] - t.distances**2) / 2) @ self.solve
        off = 1e-14 * (square + self.square.max(initial=0.0)) * len(self.points) * np.abs(self.solve).sum(1).max(initial=0.0)
        rest = np.maximum(square - (c**2).sum(1), 0) + 2 * np.sqrt(square) * off + off**2 + 1e-14 * square
        return np.sqrt(square), c, np.sqrt(rest), off


def _exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products: by doubles, where every sum is a whole number below 2**53, and by Python's integers elsewhere."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < 2.0**53:
        return (x @ q).astype(np.int64).tolist()
    own = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x]


def search(q: Table, x: Table, pivots: Pivots, sample: Table, k: int, portion: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """(number of the query, vector, score), the k best of a cell for each query, ties to the smaller id; exact. Rows that
    occur several times count as often, but for the query's own. And how many candidates were evaluated."""
    out, evaluated = [], 0
    np.seterr(over="ignore", invalid="ignore")
    if not len(q.ids) or not len(x.ids):
        return out, evaluated
    (nq, cq, rq, eq), (nx, cx, rx, ex) = pivots.split(q), pivots.split(x)
    for i in range(0, len(q.ids), portion):
        part = slice(i, i + portion)
        bound = cq[part] @ cx.T + rq[part, None] * rx[None]
        bound += 1 + (nq[part, None] + eq[part, None]) * ex[None] + eq[part, None] * nx[None] + nq[part, None] * nx[None] * 1e-12  # rounding
        bound[np.isnan(bound)] = np.inf  # beyond the range of doubles: evaluated
        for j in range(i, min(i + portion, len(q.ids))):
            first = _exact(sample.x, q.x[j]) if len(sample.ids) else []
            own = (sample.ids == q.ids[j]) & (sample.x == q.x[j]).all(1)
            first = sorted((s for s, mine in zip(first, own.tolist(), strict=True) if not mine), reverse=True)[:k]
            least = first[-1] if len(first) == k else -np.inf
            mine = bound[j - i]
            by_bound = np.flatnonzero(mine >= least)
            by_bound = by_bound[np.argsort(-mine[by_bound], kind="stable")]
            done, step, top = 0, 32, []
            while done < len(by_bound):
                at = by_bound[done : done + step]
                if len(top) >= k and mine[at[0]] < top[k - 1][0]:
                    break
                evaluated += len(at)
                kth = top[k - 1][0] if len(top) >= k else None
                for score, v in zip(_exact(x.x[at], q.x[j]), at.tolist(), strict=True):
                    if kth is None or score >= kth:
                        same = x.ids[v] == q.ids[j] and bool((x.x[v] == q.x[j]).all())
                        top += [(score, int(x.ids[v]))] * min(k, int(x.times[v]) - same)
                top = sorted(top, key=lambda t: (-t[0], t[1]))[:k]
                done, step = done + step, min(2 * step, 1024)
            out += [(j, v, s) for s, v in top]
    return out, evaluated


def _loaded(t: pa.Table, width: int, n: int) -> Table:
    """Equal rows once."""
    of: dict[tuple[int, bytes], list[int]] = {}
    for at, row in enumerate(zip(t.column("vec_id").to_pylist(), t.column("v").to_pylist(), strict=True)):
        of.setdefault(row, [at, 0])[1] += 1
    d = t.column("d").take(pa.array([x[0] for x in of.values()], pa.int64())).to_pylist()
    ids = np.array([i for i, _ in of], np.int64)
    return Table(ids, np.frombuffer(b"".join(v for _, v in of)).reshape(len(ids), width), np.frombuffer(b"".join(d)).reshape(len(ids), n), np.array([x[1] for x in of.values()], np.int64))


def _padded(rows: list, width: int) -> np.ndarray:
    """Shorter vectors count as ending in zeros."""
    out = np.zeros((len(rows), width))
    for r, v in zip(out, rows, strict=True):
        r[: len(v)] = v
    return out


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of each row whose vec_id is divisible by ``every``, against every other row.

    Rows are told apart, not ids: rows with one id are queries and candidates each, and equal rows as often as they occur.
    Fewer than k others give fewer ranks. An empty table gives no rows. A result beyond 64 bits is an error (OverflowError)."""
    spark, vectors = embeddings.sparkSession, quantized(embeddings)
    size = vectors.agg(F.count(F.lit(1)).alias("x"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width, parts_x, parts_q = max(1, size.width or 0), size.x // CANDIDATES + 1, size.q // QUERIES + 1
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    some = _padded([r.v for r in rows], width)
    pivots = Pivots(some)
    n = len(pivots.points)
    few = Table(np.array([r.vec_id for r in rows], np.int64), some, np.zeros((len(rows), n)), np.ones(len(rows), np.int64))
    shared = spark.sparkContext.broadcast((pivots, few))

    def measure(batches):
        for b in batches:
            x = _padded(b.column("v").to_pylist(), width)
            d = shared.value[0].distances(x)
            yield pa.record_batch([b.column("vec_id"), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, d))], names=["vec_id", "v", "d"])

    table = vectors.mapInArrow(measure, "vec_id long, v binary, d binary")
    part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = table.withColumn("i", part(parts_x)).withColumn("j", each(parts_q))
    q = table.where(F.col("vec_id") % every == 0).withColumn("j", part(parts_q)).withColumn("i", each(parts_x))

    def cell(mine: pa.Table, asking: pa.Table) -> pa.Table:
        a, b = _loaded(asking, width, n), _loaded(mine, width, n)
        found, _ = search(a, b, *shared.value, k)
        key = [hashlib.md5(v.tobytes(), usedforsecurity=False).digest() for v in a.x]
        cols = ([int(a.ids[j]) for j, _, _ in found], [key[j] for j, _, _ in found], [int(a.times[j]) for j, _, _ in found], [v for _, v, _ in found], [s for _, _, s in found])
        return pa.table([pa.array(c, pa.binary() if m == 1 else pa.int64()) for m, c in enumerate(cols)], names=["query_id", "row", "times", "vec_id", "score"])

    found = x.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInArrow(cell, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.r <> x.r),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""
