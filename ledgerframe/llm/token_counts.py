"""Op 7, token counts by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; dynamic programming carries, for each end, the
best score and how many pieces it took, and nothing else: no back-pointers, no ids. The rules are those of the unigram
model of the ``tokenizers`` library with byte fallback: a text gets the mark U+2581 before it and for each blank; at equal
scores the piece that starts first stands; a character that no piece of one character covers costs the least score less 10
as an unknown, and counts as its bytes in UTF-8. Line breaks and tabs are such characters. Without byte fallback,
consecutive unknowns count as one, and white space only parts words.

Scores are integers (of this vocabulary, minus the rank), so sums are exact, and no piece has a mark but at its start: those
with marks inside score -10**9 in the model, below any number of single marks that a text holds. Hence a text can be cut
before each mark and around each line break, and the best split is that of each part; a part is counted once for a batch of
documents.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerframe.llm.common import texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_words long, n_tokens long, score double"
#: Words that a worker remembers.
REMEMBER = 400_000

_loaded: dict = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces and scores of a sentencepiece model, but for control and byte pieces and those with a mark inside; the
    unknown piece's number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab, unknown = [], 0
    for k in range(model.get_piece_size()):
        p = model.id_to_piece(k)
        if model.is_unknown(k):
            unknown = len(vocab)
            vocab.append((p, 0.0))
        elif not (model.is_control(k) or model.is_byte(k) or model.is_unused(k) or MARK in p[1:]):
            vocab.append((p, float(model.get_score(k))))
    return vocab, unknown


class Counter:
    """Counts the pieces of words over one vocabulary; with fallback, of all of a text, unknown characters as bytes."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int, fallback: bool = False):
        self.fallback = fallback
        held = {c for k, (piece, _) in enumerate(vocab) if k != unknown for c in piece}
        breaks = "".join(c for c in "\t\n\x0b\x0c\r" if c not in held)
        self.parts = re.compile(f"{MARK}?[^{MARK}{breaks}]+|{MARK}" + f"|[{breaks}]" * bool(breaks))
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocab):
            if k != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """(score, pieces) of a word, mark included. Unknowns fuse within the best path: whether the last piece of it
        was one is carried along."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, after_unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(word):
            by_start[end + 1 - size].append((end + 1, score))
        for s in range(n):
            base, single = best[s], False
            for e, score in by_start[s]:
                single |= e == s + 1
                if best[e] is None or base + score > best[e]:
                    best[e], count[e], after_unknown[e] = base + score, count[s] + 1, False
            if not single and (best[s + 1] is None or base + self.unknown > best[s + 1]):
                best[s + 1], count[s + 1], after_unknown[s + 1] = base + self.unknown, count[s] + (len(word[s].encode()) if self.fallback else not after_unknown[s]), True
        return best[n], count[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, pieces, score."""
        words = text.split()
        parts = [MARK + w for w in words]
        if self.fallback:
            parts = self.parts.findall(MARK + text.replace(" ", MARK)) if words else []
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        n, total = 0, 0.0
        for w in parts:
            x = known.get(w)
            if x is None:
                x = known[w] = self.word(w)
            total += x[0]
            n += x[1]
        return len(words), n, total


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and the best score of each row of docs. Null and empty texts, and blank ones: 0, 0, 0."""

    def run(batches):
        if path not in _loaded:
            _loaded[path] = Counter(*vocabulary(path), fallback=True)
        counter = _loaded[path]
        for b in batches:
            found = [counter.text(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.record_batch([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return texts(docs).mapInArrow(run, SCHEMA)
