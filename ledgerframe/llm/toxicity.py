"""Op 4, toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares words by their common subsequences of three letters, each weighted by DECAY for every letter that it
skips, three at most: an insult with letters inserted, left out or spread by blanks and dots keeps most of its
subsequences. Landmarks are words that toxic training documents hold and clean ones don't, chosen apart from each other.
With K over the landmarks, K(x, landmarks) K^(-1/2) maps a word to coordinates in which a linear machine is trained.

Training is on sentences of labelled documents: all sentences of clean ones are negative; a toxic one is toxic by its
most suspicious sentence, which is looked up anew in each round. A sentence is as toxic as its worst word, a document as
its worst sentence. As the kernel has explicit coordinates (triples of letters), the machine folds into one weight a
triple: scoring a word takes one pass over its triples, whatever the number of landmarks.

Training reads a bounded sample: the SAMPLE documents of each label with the least hash of their id. Scores cover every
word of every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import texts

SAMPLE, LANDMARKS, ROUNDS, REMEMBER = 1000, 96, 4, 300_000
DECAY, REACH, LETTERS = 0.5, 5, 64
THRESHOLD = 0.7
#: Log likelihood ratio that a landmark needs: below it, chance finds such words among a hundred thousand.
CHANCE = 12.0
PATTERNS = [(i, j) for j in range(2, REACH + 1) for i in range(1, j)]
SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:\s\w){2,}(?=\s|$)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_CODE: dict[str, int] = {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def folded(word: str) -> str:
    """Lower case, without accents and whatever isn't a letter or digit."""
    word = word.lower()
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def words_of(text: str) -> list[str]:
    """Words, and single letters set apart by blanks as one word each run."""
    return text.split() + [re.sub(r"\s", "", x) for x in SPACED.findall(text)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words, and whose each is."""
    joined = "".join(words)
    codes = np.fromiter((_CODE.get(c) or 37 + ord(c) % 27 for c in joined), np.int64, len(joined))
    return codes, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))


def _triples(words: list[str]):
    """For each pattern of gaps: whose, which triple, its weight."""
    codes, own = _codes(words)
    for i, j in PATTERNS:
        if len(codes) > j:
            ok = np.flatnonzero(own[:-j] == own[j:])
            yield own[ok], (codes[ok] * LETTERS + codes[ok + i]) * LETTERS + codes[ok + j], DECAY ** (j - 2)


def norms(words: list[str]) -> np.ndarray:
    """Of each word in the kernel's space; a triple that occurs in several ways adds up first."""
    parts = list(_triples(words))
    if not parts:
        return np.full(len(words), 1e-6)
    key = np.concatenate([own * LETTERS**3 + t for own, t, _ in parts])
    weight = np.concatenate([np.full(len(own), w) for own, _, w in parts])
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
    return np.sqrt(np.maximum(np.bincount(key[first] // LETTERS**3, sums**2, len(words)), 1e-12))


def kernel(words: list[str], marks: list[str], portion: int = 20_000) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    table = np.full(LETTERS**3, -1)
    seen = np.unique(np.concatenate([t for _, t, _ in _triples(marks)] or [np.zeros(0, np.int64)]))
    table[seen] = np.arange(len(seen))
    side = np.zeros((len(seen), len(marks)), np.float32)
    for own, t, w in _triples(marks):
        np.add.at(side, (table[t], own), w)
    side /= norms(marks)[None]
    out = np.zeros((len(words), len(marks)), np.float32)
    for k in range(0, len(words), portion):
        part = words[k : k + portion]
        for own, t, w in _triples(part):
            hit = np.flatnonzero(table[t] >= 0)
            if len(hit):
                own, row = own[hit], table[t[hit]]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[k + own[first]] += np.add.reduceat(side[row], first, axis=0) * np.float32(w)
        out[k : k + portion] /= norms(part)[:, None].astype(np.float32)
    return out


class Model:
    """weights by triple, the offset, and the map of margins to scores."""

    def __init__(self, weights: np.ndarray, offset: float, cut: float, slope: float, constant: float | None = None):
        self.weights, self.offset, self.cut, self.slope, self.constant = weights, offset, cut, slope, constant
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Of folded words."""
        out = np.zeros(len(words))
        for own, t, w in _triples(words):
            out += np.bincount(own, self.weights[t] * w, len(words))
        return out / norms(words) + self.offset

    def worst(self, raw: list[str]) -> list[float]:
        """The largest margin of each text's words; the offset if it has none."""
        split = [words_of(t) for t in raw]
        new = [w for w in {w for ws in split for w in ws} if w not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list({w for ws in split for w in ws})
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.known.update(zip(part, self.margins([folded(w) for w in part]).tolist(), strict=True))
        get = self.known.__getitem__
        return [max(map(get, ws), default=self.offset) for ws in split]

    def scores(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        x = self.slope * (margin - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _landmarks(docs: list[set[str]], toxic: np.ndarray, n: int) -> list[str]:
    """Words that toxic documents hold far more often, by their log likelihood ratio. The next one is always that which does
    most for documents that few landmarks hold yet: a word that only copies of one document share adds little."""
    bad, good = Counter(w for d, t in zip(docs, toxic, strict=True) if t for w in d), Counter(w for d, t in zip(docs, toxic, strict=True) if not t for w in d)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = {w: np.log(((c + 0.5) / (n_bad + 1)) / ((good[w] + 0.5) / (n_good + 1))) for w, c in bad.items() if len(w) >= 3 and c > 2 and good[w] / n_good < c / n_bad / 10}
    pool = sorted((w for w, x in odds.items() if bad[w] * x >= CHANCE), key=lambda w: (-bad[w] * odds[w], w))[: 20 * n]
    number = {w: i for i, w in enumerate(pool)}
    holds = [[number[w] for w in d if w in number] for d, t in zip(docs, toxic, strict=True) if t]
    of: list[list[int]] = [[] for _ in pool]
    for k, ws in enumerate(holds):
        for i in ws:
            of[i].append(k)
    need, chosen = np.ones(len(holds)), []
    gain = np.array([odds[w] for w in pool])
    while len(chosen) < min(n, len(pool)):
        worth = np.array([need[k].sum() for k in of]) * gain
        worth[chosen] = 0
        at = int(worth.argmax())
        if worth[at] < CHANCE / 2:
            break
        chosen.append(at)
        need[of[at]] /= 2
    return [pool[i] for i in chosen]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, keep: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient descent; deterministic."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    rate = 1 / (2 * np.linalg.norm((z * np.sqrt(weight)[:, None]).T @ (z * np.sqrt(weight)[:, None]), 2) + keep)
    w = v = np.zeros(z.shape[1], np.float32)
    for i in range(steps):
        short = np.maximum(0, 1 - y * (z @ v))
        grad = -2 * z.T @ (weight * y * short) + keep * np.append(v[:-1], 0)
        new = v - rate * grad
        v, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(raw: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """From whole labelled texts. Without both labels the score is the only label."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, 0.0, 1.0, float(y.any()) if len(y) else 0.0)
    sentences = [[{f for w in words_of(s) if (f := folded(w))} for s in SENTENCE.split(t)] for t in raw]
    marks = _landmarks([set().union(*s) for s in sentences], y, landmarks)
    if not marks:
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, 0.0, 1.0, float(y.mean()))
    vocab = sorted(set().union(*(w for s in sentences for w in s)))
    number = {w: i for i, w in enumerate(vocab)}
    k_mm = kernel(marks, marks)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    near = kernel(vocab, marks)
    coords = near @ root.astype(np.float32)
    suspicion, mark = near.max(1), np.zeros(LETTERS**3)
    docs = [[np.array([number[w] for w in s]) for s in d if s] for d in sentences]
    w, b = np.zeros(root.shape[1]), 0.0
    for _ in range(rounds):
        # a toxic document without a word above what clean ones have tells nothing yet
        clean = np.quantile([max((suspicion[s].max() for s in d), default=-1.0) for d, t in zip(docs, y, strict=True) if not t], 0.95)
        x, label = [], []
        for d, t in zip(docs, y, strict=True):
            worst = [s[suspicion[s].argmax()] for s in d]
            if t and worst:
                worst = [i for i in [max(worst, key=lambda i: suspicion[i])] if suspicion[i] >= clean]
            x += worst
            label += [1.0 if t else -1.0] * len(worst)
        # a word counts by its sentences; repeated ones are one row with that weight
        rows, times = np.unique(np.array([x, label]).T, axis=0, return_counts=True)
        own, sign = rows[:, 0].astype(int), rows[:, 1]
        if not (sign > 0).any():
            break
        part = np.where(sign > 0, 0.5 * times / times[sign > 0].sum(), 0.5 * times / max(1, times[sign < 0].sum()))
        w, b = _machine(coords[own], sign, part)
        suspicion = coords @ w + b
    alpha = root @ w
    for own, t, d in _triples(marks):
        np.add.at(mark, t, d * (alpha / norms(marks))[own])
    margin = np.array([max((suspicion[s].max() for s in d), default=b) for d in docs])
    # the cut with the fewest errors, each label weighing half, in the middle of its gap
    order = np.argsort(margin)
    m, t = margin[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) / y.sum() + ((~t).sum() - np.concatenate([[0], np.cumsum(~t)])) / (~y).sum()
    at = np.flatnonzero(wrong == wrong.min())
    at = int(at[len(at) // 2])
    cut = (m[max(at - 1, 0)] + m[min(at, len(m) - 1)]) / 2
    spread = max(1e-3, float(np.median(margin[y]) - np.median(margin[~y])))
    return Model(mark.astype(np.float32), b, float(cut), 10 / spread)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``most`` documents of each label, by the least hash of the id, outside the held-out third."""
    ids = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = None
    for label in (0, 1):
        part = ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # one text an id, however often documents repeat it: 2 * most rows at most
    found = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.toxic) for r in sorted(found, key=lambda r: (r.doc_id, r.toxic, r.text))]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Null and empty texts get the score of a text without words;
    repeated rows the same score; a null id isn't held out."""
    rows = sample(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows]))

    def run(batches):
        model = shared.value
        for b in batches:
            raw, out = b.column("text").to_pylist(), []
            for k in range(0, len(raw), 500):
                out += model.worst(raw[k : k + 500])
            yield pa.record_batch([b.column("doc_id"), pa.array(model.scores(np.array(out)), pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
