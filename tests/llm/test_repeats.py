"""Ops 1 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import ledgerframe.llm.repeats as engine
from ledgerframe.llm import substring_dedup, suffix_dedup
from ledgerframe.llm.substring_dedup import remove_repeated_passages, without_repeated_passages
from ledgerframe.llm.suffix_dedup import remove_repeated_bytes


def marks(units, length, times):
    gone = [0] * len(units)
    for j in range(len(units) - length + 1):
        if times[tuple(units[j : j + length]) if isinstance(units, list) else units[j : j + length]] > 1:
            gone[j : j + length] = [1] * length
    return gone


def brute_words(rows, length=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    times = Counter(tuple(w[j : j + length]) for _, w in split for j in range(len(w) - length + 1))
    out = []
    for i, w in split:
        g = marks(w, length, times)
        out.append((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()))
    return Counter(out)


def brute_bytes(rows, length=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[j : j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        g = marks(b, length, times)
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((i, len(b), sum(g), len(re.findall("1+", "".join(map(str, g)))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def planted(seed):
    """Documents of few different words, with passages moved between them, periods, and copies with edits."""
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "cd", "é", "the", "of", "x" * r.randint(1, 3), f"u{r.randint(0, 3000)}"])
    docs = [[word() for _ in range(r.choice([0, 5, 34, 35, 36, 150, 300]))] for _ in range(30)]
    for _ in range(12):
        a, b = r.choice(docs), r.choice(docs)
        if len(a) > 40:
            at = r.randint(0, len(a) - 36)
            b[len(b) // 2 : len(b) // 2] = a[at : at + r.randint(34, 80)]
    docs.append(["per", "iod"] * 60)
    docs.append(["one"] * 36)
    for d in docs[:3]:
        e = list(d)
        if e:
            e[len(e) // 2] = "edited"
        docs.append(e)
    return [(k, r.choice([" ", "\n", " \t"]).join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("chunk", [1_200_000, 2_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_planted(make, monkeypatch, seed, chunk):
    monkeypatch.setattr(engine, "CHUNK_BYTES", chunk)
    rows = planted(seed)
    assert Counter(map(tuple, remove_repeated_passages(make(*rows)).collect())) == brute_words(rows)
    assert Counter(map(tuple, remove_repeated_bytes(make(*rows)).collect())) == brute_bytes(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, remove_repeated_passages(odd).collect())) == brute_words(rows)
    assert Counter(map(tuple, remove_repeated_bytes(odd).collect())) == brute_bytes(rows)


def test_hot_anchors(make, monkeypatch):
    """Anchors that occur more often than HOT send their windows one by one: the same result."""
    monkeypatch.setattr(engine, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(engine, "HOT", 1)
    rows = planted(3)
    assert Counter(map(tuple, remove_repeated_passages(make(*rows)).collect())) == brute_words(rows)
    assert Counter(map(tuple, remove_repeated_bytes(make(*rows)).collect())) == brute_bytes(rows)


def test_the_automaton_locates():
    """Places come from the automaton alone: with another one they are others."""
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([*["a", "b"][k % 2 :], *passage, f"e{k}"]).encode() for k in range(3)]
    windows = np.array([len(x.split()) - 34 for x in texts])
    want = substring_dedup.located(texts, np.ones(3, int), windows, 35)
    assert want.sum() == 3 * 2 + 2 and want.any()  # the first and last window of what recurs: p0 to p49 in all, after b in two
    none = substring_dedup.ahocorasick.Automaton(substring_dedup.ahocorasick.STORE_INTS, substring_dedup.ahocorasick.KEY_SEQUENCE)
    none.add_word((10**6,), 1)
    none.make_automaton()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substring_dedup, "compiled", lambda *_: none)
        assert not substring_dedup.located(texts, np.ones(3, int), windows, 35).any()


@pytest.mark.parametrize("length", [9, 40, 400])
def test_suffixes_of_any_kind(length, monkeypatch):
    r = random.Random(length)
    for trial in range(12):
        monkeypatch.setattr(suffix_dedup, "BUCKET", r.choice([16, 1000, 1 << 16]))
        base = bytes(r.choice(b"ab") if trial % 2 else r.randrange(256) for _ in range(3000))
        text = b"".join(base[a : a + r.randint(length, 3 * length)] for a in [r.randrange(0, 3000) for _ in range(20)]) + bytes(r.randint(length, 2 * length))
        starts = np.array(sorted(r.sample(range(len(text) - length + 1), (len(text) - length) * 2 // 3 + 1)))
        times = Counter(text[i : i + length] for i in starts.tolist())
        want = [times[text[i : i + length]] > 1 for i in starts.tolist()]
        assert suffix_dedup.repeated_suffixes(np.frombuffer(text, np.uint8), starts, length).tolist() == want


def test_empty_table(odd):
    assert remove_repeated_passages(odd.limit(0)).collect() == []
    assert remove_repeated_bytes(odd.limit(0)).collect() == []


def test_clashing_columns(odd):
    from pyspark.sql import functions as F

    df = odd.withColumn("chunk", F.lit(1)).withColumn("dest", F.lit("x"))
    assert remove_repeated_passages(df).count() == odd.count()


def test_texts_that_lose_nothing_stay(make):
    passage = " ".join(f"p{i}" for i in range(40))
    df = make((1, f"start\n {passage} end"), (2, f"other {passage}"), (3, "keeps  its \n blanks"))
    got = {r.doc_id: r.text for r in without_repeated_passages(df).collect()}
    assert got == {1: "start end", 2: "other", 3: "keeps  its \n blanks"}
