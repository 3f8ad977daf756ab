"""Op 1, substring dedup: repeated passages of words, located by Aho-Corasick automata.

Passages that can recur meet in shards (see repeats.py). A shard confirms those that do: it counts the contents of windows over
the whole corpus, without places. Consecutive confirmed windows are a passage, whose first and last window cover it. Those
are compiled into the shard's automaton over words, and the text of every document that can match streams
through it: each occurrence it finds, and nothing else, removes its words. Equal stretches of documents stream once for all.
"""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerframe.llm.repeats import Text, covered, documents, repeats


def confirmed(text: Text, times: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Passages that recur, as the first and last window (numbers of words) of one place of each."""
    at = text.windows(length)
    if not len(at):
        return []
    own = np.searchsorted(text.first, at, "right") - 1
    _, content = np.unique(text.fingerprints(at, at + length), return_inverse=True)
    often = np.flatnonzero(np.bincount(content, times[own])[content] > 1)
    if not len(often):
        return []
    edge = np.flatnonzero((np.diff(at[often]) != 1) | (np.diff(own[often]) != 0)) + 1
    return list(zip(at[often[np.concatenate([[0], edge])]].tolist(), at[often[np.concatenate([edge - 1, [len(often) - 1]])]].tolist(), strict=True))


def compiled(words: list[int], passages: list[tuple[int, int]], length: int) -> ahocorasick.Automaton:
    """Of windows that cover the passages: the first, those that follow end to end, and the last."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for window in {tuple(words[x : x + length]) for a, b in passages for x in (*range(a, b, length), b)}:
        automaton.add_word(window, 1)
    automaton.make_automaton()
    return automaton


def located(passages: list[bytes], times: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Of each window of the passages, end to end, whether the automaton finds it."""
    text = Text(np.arange(len(passages)), passages, True)
    number: dict[bytes, int] = {}
    words = [number.setdefault(w, len(number)) for x in text.raw for w in x.split()]
    out, first = np.zeros(int(windows.sum()), bool), np.cumsum(windows) - windows
    found = confirmed(text, times, length)
    if found:
        automaton = compiled(words, found, length)
        for k, _, a, b in documents(text):
            ends = [e for e, _ in automaton.iter(tuple(words[a:b]))]
            out[first[k] + np.array(ends, np.int64) - length + 1] = True
    return out


def _kept(text: Text, k: int, a: int, b: int, gone: np.ndarray) -> bytes:
    if not gone.any():
        return text.raw[k]
    return b" ".join([text.buffer[s:e] for s, e in zip(text.starts[a:b][~gone].tolist(), text.ends[a:b][~gone].tolist(), strict=True)])


def remove_repeated_passages(docs: DataFrame, length: int = 35, phrase: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Documents of fewer than ``length`` words, empty and null ones keep all; of repeated rows all copies lose what
    repeats."""

    def finish(text: Text, starts: np.ndarray) -> pa.Table:
        gone = covered(text, starts, length)
        rows = [(doc, b - a, int(gone[a:b].sum()), hashlib.sha256(_kept(text, k, a, b, gone[a:b])).hexdigest()) for k, doc, a, b in documents(text)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    decide = partial(located, length=length)
    return repeats(docs, length, phrase, True, decide, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeated_passages(docs: DataFrame, length: int = 35, phrase: int = 8) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with the words of repeated passages taken out of the texts. Texts that lose
    words are joined by single blanks, others stay as they are; null texts come back empty."""

    def finish(text: Text, starts: np.ndarray) -> pa.Table:
        gone = covered(text, starts, length)
        old = text.table.column("text").to_pylist()
        new = [_kept(text, k, a, b, gone[a:b]).decode() if gone[a:b].any() else old[k] for k, _, a, b in documents(text)]
        ids = pa.array(text.ids.tolist(), pa.int64())
        return pa.table([ids, pa.array(new, pa.string()), text.table.column("_lang"), text.table.column("_source"), pa.array(map(len, new), pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    decide = partial(located, length=length)
    return repeats(docs, length, phrase, True, decide, finish, "doc_id long, text string, lang string, source string, n_chars long", carry=("lang", "source"))


ORACLE = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM b, unnest(range(1, len(ws) - 33)) u(i)),
cov AS (SELECT DISTINCT r, i + d AS p FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k), unnest(range(0, 35)) u(d)),
n AS (SELECT r, count(*) AS n FROM cov GROUP BY r),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM b) x WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.r = x.r AND cov.p = x.p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM b LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
