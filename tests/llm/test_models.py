"""Ops 3, 4, 6 and 7: round trips, held-out accuracy, brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer, models

from ledgerframe.llm import minhash, packing, token_counts, toxicity
from ledgerframe.llm.common import tokenizer_file

WORDS = "word_bpe_49k.json"


def test_packing(spark, data, odd, make):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    docs = docs.unionByName(make((9001, "a <|endoftext|> b"), (9002, "x<|startoftext|>y ends.<|endoftext|>"), (9003, "Don't İt ǅ e\u0301 \u0301 a ß ſ\u00a0b\u3000c"), (9004, "one.two\x1cthree\x85four")))
    rows = packing.pack(docs, tokenizer_file(WORDS)).collect()
    t = Tokenizer.from_file(tokenizer_file(WORDS))
    want = []
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(odd.limit(0), tokenizer_file(WORDS)).collect() == []


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 5000), np.full(700, 683), rng.geometric(0.002, 5000).clip(1, 2048), np.array([], int)):
        count = np.bincount(lengths, minlength=2049)
        total = np.zeros(2049, int)
        plan = packing.plan(count)
        for p, n in plan:
            assert sum(p) <= 2048
            for k in p:
                total[k] += n
        assert (total == count).all()
    assert sum(n for _, n in packing.plan(np.bincount(np.full(700, 683), minlength=2049))) == 350


def test_token_counts_equal_the_library(spark, data, odd):
    vocab, unknown = token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocab, unknown, False))
    c = token_counts.Counter(vocab, unknown)
    own = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", " \n", "漢字𠀀𠀁 ͸͹ ab͸c͸", "don't <unk> ▁▁a"]
    for text in own:
        assert c.text(text)[1] == len(t.encode("".join("▁" + w for w in text.split())).ids)
    rows = token_counts.count_tokens(odd, tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 0 for r in rows if r.n_words == 0)


def test_white_space_and_bytes_are_counted(spark, data, make):
    """As the library with byte fallback counts the whole text, blanks as marks."""
    path = tokenizer_file("piece_bpe_32k.model")
    vocab, unknown = token_counts.vocabulary(path)
    t = Tokenizer(models.Unigram([*vocab, *((f"<0x{k:02X}>", 0.0) for k in range(256))], unknown, True))
    odd = ["a\nb", "a\n\n\tb\r\n", "  a    b ", "漢字𠀀𠀁 ͸͹ ab͸c͸", "x" + "𠀀" * 50, "▁▁a\n ▁", "a\u00a0b\u3000c\x85d\u2028e"]
    own = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if (r.text or "").split()] + odd
    docs = make(*enumerate(own))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    for k, text in enumerate(own):
        assert got[k] == len(t.encode("▁" + text.replace(" ", "▁")).ids)
    assert got[len(own) - len(odd)] == 3 and got[len(own) - 3] == token_counts.Counter(vocab, unknown).text("x")[1] + 200


def test_toxicity(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    right = sum(a == b for a, b in held) / len(held)
    assert right > 0.93 and sum(p for t, p in held if t) > 0.7 * sum(t for t, _ in held)
    model = toxicity.train(["you idiot. fine day", "an idiot spoke"] * 20, [1, 1] * 20)
    assert model.scores(np.array(model.worst(["", "x"]))).tolist() == [1.0, 1.0]
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(none) == odd.count() and {r.predicted for r in none} == {0}


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["idiot", "idiiot", "idxiot", "station"], ["idiot"])[:, 0]
    assert abs(k[0] - 1) < 1e-5 and k[1] > 0.5 and k[2] > 0.2 and k[3] < 0.1
    assert toxicity.words_of("he is an i d i o t now")[-1] == "idiot" and toxicity.folded("I.d-i_o.T!") == "idiot"


def test_near_duplicates(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    idf = minhash.inverse(minhash.document_frequencies(docs))
    w = list(minhash.weights([(r.text or "").encode() for r in rows], idf))
    of, pairs = defaultdict(list), set()
    for i, (s, _) in enumerate(w):
        for h in s.tolist():
            pairs.update((j, i) for j in of[h])
            of[h].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        if minhash.similarity(w[i], w[j]) >= 0.8:
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k].doc_id)
            root[b] = a
    want = {r.doc_id: rows[find(i)].doc_id for i, r in enumerate(rows)}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert sum(want[k] == got[k] for k in want) >= 0.995 * len(want)
    few = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect()}
    assert few == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 6)}
    assert minhash.near_duplicates(odd.limit(0)).collect() == []


def test_document_frequencies_are_exact(spark, make, monkeypatch):
    """Weights are those of brute force, however chunks and shards fall: more shingles than a table of 2**20 tells apart."""
    words = [" ".join(f"d{k}w{i}" for i in range(3000)) for k in range(100)]
    rows = [(k, w) for k, w in enumerate(words)] + [(500, words[7] + " "), (None, words[7]), (501, words[3] + " end"), (502, "one two"), (503, None)]
    docs = make(*rows)
    raw = [(t or "").encode() for _, t in rows]
    df = Counter(h for x in minhash.shingles(raw) for h in set(x.tolist()))
    if hasattr(minhash, "CHUNK"):
        monkeypatch.setattr(minhash, "CHUNK", 300_000)
    frequencies = minhash.document_frequencies(docs)
    for s, w in minhash.weights(raw, minhash.inverse(frequencies)):
        want = [1 + np.log(len(rows) / df[h]) / np.log(len(rows)) for h in s.tolist()]
        assert np.allclose(w, want, atol=1e-6)  # no shingle occurs twice in a text
    got = {r.node: r for r in minhash.signatures(frequencies).collect()}
    assert len(got) == 102 and min(r.least for r in got.values()) == 0
    row = got[minhash.digest(raw[7])]
    ((_, w),) = minhash.kept_weights([raw[7]], [row.idf])
    assert np.allclose(w, 1 + np.log(len(rows) / 3) / np.log(len(rows)), atol=1e-6) and row.least == 7


def test_blocks_of_any_size_find_the_same_classes(spark, make, monkeypatch):
    """Families whose members drift apart, so that a leader doesn't hold them all: classes are those of all pairs."""
    rng, rows = np.random.default_rng(5), []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(120)]
        for step in range(14):
            rows.append((100 * family + step, " ".join(words)))
            words[int(rng.integers(0, 120))] = f"e{family}x{step}"
    docs = make(*rows, (5000, rows[3][1] + " "), (5001, rows[3][1]))
    whole = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "BLOCK", 9_000)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == whole
    assert {c for _, c in whole} == {100 * f for f in range(12)}
    assert (5001, 0) in whole and (5000, 0) in whole


def test_links_of_a_block():
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    raw = []
    for k in range(40):
        words = list(base) if k % 2 else [f"v{w}" for w in base]
        for i in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[i] = f"x{k}"
        raw.append(" ".join(words).encode())
    found = list(minhash.weights(raw, np.ones(1 << 20, np.float32)))
    asks, member = rng.random(40) < 0.5, rng.random(40) < 0.8
    loose = asks | (rng.random(40) < 0.2)
    nodes = [bytes([k]) for k in range(40)]
    links = {(a[0], b[0]) for a, b in minhash._links(nodes, asks, member, loose, found, 0.8)}
    true = {(i, j) for i in np.flatnonzero(asks) for j in np.flatnonzero(member) if i != j and minhash.similarity(found[i], found[j]) >= 0.8}
    assert links <= true

    def parts(pairs):
        root = list(range(41))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in [*pairs, *((k, 40) for k in range(40) if not loose[k])]:  # their leader joins those that it holds
            root[top(i)] = top(j)
        return {frozenset(k for k in range(41) if top(k) == r) for r in range(41)}

    assert parts(links) == parts(true)


def test_samples_agree_as_often_as_the_weights_say():
    rng = np.random.default_rng(1)
    one = np.ones(1 << 20, np.float32)
    for edits in (0, 20):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 400)]
        other = list(words)
        for i in range(0, edits * 19, 19):
            other[i] = "e"
        a, b = minhash.weights([" ".join(words).encode(), " ".join(other).encode()], one)
        same = (minhash.bands(*a) == minhash.bands(*b)).sum()
        assert same == minhash.BANDS if not edits else same < minhash.BANDS
