"""BPE by trie and packing: exact against the tokenizers library, and round trips."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fragweave.llm import bpe, packing
from tests.llm import samples

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
library = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
trie = bpe.Bpe(WORD)
ALPHABET = "aabbthines'sdllve 0123\n\tÀéßøΣσςİI<|endoftext|>#$%…—日本́  ñẞﬁ🙂"


def expected(text):
    ids = library[WORD].encode(text, add_special_tokens=False).ids
    decoded = library[WORD].decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=5))
def test_trie_equals_library(texts):
    assert bpe.digests(texts, trie, {}) == [expected(t) for t in texts]


def test_repeats_and_specials():
    texts = ["a" * 50, "!" * 40, "hahahaha" * 9, "<|endoftext|>A<|startoftext|> b<|EndOfText|>", "-" * 31, "abab" * 20]
    assert bpe.digests(texts, trie, {}) == [expected(t) for t in texts]
    known = {}
    bpe.digests(texts, trie, known, most=1)
    assert bpe.digests(["new words here"], trie, known, most=1) == [expected("new words here")]


def test_new_words_take_little_memory():
    """Of many words never met before, tokens and what is kept are held, but no tree of them."""
    rng, known = random.Random(7), {}
    texts = [" ".join("".join(rng.choices("aeiourstln", k=9)) for _ in range(500)) for _ in range(100)]
    tracemalloc.start()
    got = bpe.digests(texts, trie, known, most=20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [expected(t) for t in texts]
    assert peak < 50e6


@pytest.mark.parametrize("run", [1, 7, 60])
def test_texts_longer_than_a_run(run):
    texts = ["", "Hello, wide world!", "<|endoftext|>A<|startoftext|> b", "", "été " * 40 + "x" * 300, " \n", "it's 2024"]
    known = {}
    assert bpe.digests(texts, trie, known, most=3, run=run) == [expected(t) for t in texts]
    assert not any(len(w) > bpe.KNOWN_CHARS for w in known)


def test_encode_table(spark):
    data = samples.rows(30) + samples.ODD
    got = sorted(map(tuple, bpe.encode(samples.table(spark, data), WORD).collect()))
    assert got == sorted((i, *expected(t or "")) for i, t, _ in data)
    assert bpe.encode(samples.empty(spark), WORD).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=5))
def test_packing_ids_equal_library(texts):
    got = packing.Tokens(BYTE) if not packing._LOADED.get(BYTE) else packing._LOADED[BYTE]
    packing._LOADED[BYTE] = got
    want = [np.array(library[BYTE].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got.encode(texts) == want


def check(pieces, limits, totals, loss):
    by, seq = {}, {}
    for p in pieces:
        by.setdefault(p.doc, []).append((p.start, p.length))
        seq.setdefault(p.sequence, []).append((p.offset, p.length, max(0, p.start + p.length - max(p.start, totals[p.doc] - loss[p.doc]))))
    for d, total in totals.items():
        at = 0
        for s, n in sorted(by.get(d, [])):
            assert s == at and n > 0
            at += n
        assert at == total
    for parts in seq.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]
    return [sum(p[1] for p in parts) for parts in seq.values()]


@pytest.mark.parametrize("limits", [(1024, 128, 1024), (64, 4, 20), (16, 1, 16)])
def test_packer(limits):
    rng = random.Random(limits[0])
    packer = packing.Packer(*limits, pool=50)
    totals = {i: rng.choice([1, 2, 5, 40, 700, 3000]) if limits[0] > 64 else rng.randrange(1, 150) for i in range(400)}
    loss = {i: t if limits[2] == limits[0] else rng.randrange(t + 1) for i, t in totals.items()}
    out = []
    for i, t in totals.items():
        out += packer.add(i, t, loss[i])
    sizes = check(out + packer.finish(), limits, totals, loss)
    if limits == (1024, 128, 1024):
        assert all(n == 1024 or n & (n - 1) == 0 for n in sizes)
        assert sum(n != 1024 for n in sizes) <= 11


def test_pack_table(spark):
    data = samples.rows(60) + samples.ODD
    rows = packing.pack(samples.table(spark, data), BYTE).collect()
    ids = {}
    for i, t, _ in data:
        ids[i] = np.array([*library[BYTE].encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    got = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(b) // 4 * (2 if i == 9008 else 1) for i, b in ids.items()}
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(samples.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n" * 1_200_000, " \n" * 2_500_000 + "x"])
def test_long_runs_of_white_space(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.Tokens(path).encode(["x", text])[1] == want


def test_very_long_text_and_null_ids(spark):
    """A text of 5 million characters is packed whole, as are rows without an id."""
    long = "word " * 1_000_000
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, long)], "doc_id long, text string")
    got = packing.pack(rows, BYTE).collect()
    n = len(library[BYTE].encode(long, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got if r.doc_id == 3) == n and {r.doc_tokens for r in got} == {n, 3}
    assert sum(r.length for r in got if r.doc_id is None) == 6


def test_prompt_bears_no_loss_and_all_terms_choose():
    tokens = packing.Tokens(BYTE)
    text = "A heading é\nand then the text"
    b = tokens.encode([text])[0]
    head = len(library[BYTE].encode("A heading é\n", add_special_tokens=False).ids)
    assert packing.prompt(text) == "A heading é\n" and tokens.within(b, len(packing.prompt(text).encode())) == head
    assert packing.prompt("one line\n ") == packing.prompt("") == ""
    # of two that fit and are as long, the one with more loss-bearing tokens has the larger dot product while there is room for them
    packer = packing.Packer(100, 10, 100, pool=10)
    packer.add("start", 40, 40)
    packer.add("prompt", 30, 5)
    packer.add("loss", 30, 30)
    packer.add("rest", 30, 30)
    first = [p.doc for p in packer.finish() if p.sequence == 0]
    assert first[0] == "start" and first[1:3] == ["loss", "rest"]
    # with little room for loss, a longer example with less of it fits and a shorter one with more doesn't
    packer = packing.Packer(100, 10, 50, pool=10)
    packer.add("a", 40, 40)
    packer.add("b", 30, 30)
    packer.add("c", 60, 10)
    out = packer.finish()
    assert {p.doc for p in out if p.sequence == 0} == {"a", "c"}
