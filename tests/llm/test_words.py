"""Kernels against plain Python: words, shingles, pre-tokens, the suffix automaton, placement."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtide.llm import licenses, packing, pretoken, words
from sigtide.llm.queries import vocabulary

LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = ["", None, "One two  THREE", "ünïcode, Ärger 42!", "a b c d", "a b c d e", "a b c d e f",
         "\n\t", "x" * 3000, "word " * 2000, "!", "ends with sep.", "日本語 テスト"]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_shingles(text, width=5):
    w = plain_words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def test_words_and_hashes():
    found = words.find_words(pa.array(TEXTS))
    assert found.counts.tolist() == [len(plain_words(t)) for t in TEXTS]
    every = [w for t in TEXTS for w in plain_words(t)]
    assert len(set(found.hashes.tolist())) == len(set(every))
    by_word = dict(zip(every, found.hashes.tolist(), strict=True))
    assert [by_word[w] for w in every] == found.hashes.tolist()


def test_slices_and_sliced_arrays_agree():
    texts = pa.array([*TEXTS, *TEXTS])
    assert [r for i, j in words.slices(texts, 50) for r in range(i, j)] == list(range(len(texts)))
    part = words.find_words(texts.slice(len(TEXTS)))
    assert part.hashes.tolist() == words.find_words(pa.array(TEXTS)).hashes.tolist()
    assert words.find_words(pa.array([], pa.string())).n_docs == 0
    assert words.find_words(pa.array([None, None], pa.string())).counts.tolist() == [0, 0]


def test_shingles():
    docs, hashes = words.shingles(words.find_words(pa.array(TEXTS)))
    for d, text in enumerate(TEXTS):
        assert len(set(hashes[docs == d].tolist())) == len(plain_shingles(text)), text
    assert (np.diff(docs) >= 0).all()


@pytest.mark.parametrize("seed", range(3))
def test_token_ids_equal_the_library(seed):
    rng = random.Random(seed)
    letters = "a'strevldmXé \n\t1.!Ç²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", " ", "  \n x", "don't they're 'S 's 'sa", "a<|endoftext|>b <|endoftext|>",
              "日本語 12３", "\0a\0", "x y z", "Ᲊ new letter", "tail   "]
    encoder = pretoken.encoder(vocabulary())
    ids, offsets = encoder.ids_of(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_token_cache_that_overflows():
    encoder = pretoken.Encoder(vocabulary())
    encoder._clear(64)
    texts = [f"w{i} q{i * 7} z" for i in range(300)]
    ids, offsets = encoder.ids_of(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_hash_table():
    table = pretoken.HashTable(64)
    keys = np.array([1, 65, 129, 2, 193], np.uint64)  # four share a slot
    table.put(keys, np.arange(5, dtype=np.int32))
    assert table.get(keys).tolist() == [0, 1, 2, 3, 4]
    assert table.get(np.array([3, 257], np.uint64)).tolist() == [-1, -1]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_matches(seed):
    rng = random.Random(seed)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
    automaton = licenses.Automaton(sequences)
    tokens = [rng.randint(0, 4) for _ in range(20)]
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    stat = [max(n for n in range(i + 2) if not n or tuple(tokens[i + 1 - n:i + 1]) in known)
            for i in range(len(tokens))] + [0]
    want = {(i + 1 - stat[i], stat[i]) for i in range(len(tokens))
            if stat[i] >= 2 and i + 2 - stat[i + 1] > i + 1 - stat[i]}
    got = automaton.matches(tokens, 2)
    assert {(s, n) for s, n, _ in got} == want
    for s, n, state in got:
        assert automaton.ends[state] == {
            (k, e) for k, q in enumerate(sequences) for e in range(n, len(q) + 1)
            if q[e - n:e] == tokens[s:s + n]}


@pytest.mark.parametrize("sizes", [[], [5], [1023, 1], [1] * 3000, [700] * 9, [1023] * 7, list(range(1, 1024))])
def test_placement_is_gapless_and_tight(sizes):
    placed = packing.place(np.array(sizes, np.int64))
    total, used = sum(sizes), {}
    for item, start, length, sequence, offset in placed:
        assert offset == used.get(sequence, 0) and length > 0
        used[sequence] = offset + length
    assert all(n <= packing.CAPACITY for n in used.values())
    assert len(used) == -(-total // packing.CAPACITY)
    for item, size in enumerate(sizes):
        parts = sorted((s, n) for i, s, n, _, _ in placed if i == item)
        assert sum(n for _, n in parts) == size
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_lowest_cost_first():
    # two large items open both sequences, the next goes to the cheaper one
    placed = packing.place(np.array([600, 500, 300, 200]))
    assert {(i, k) for i, _, _, k, _ in placed} == {(0, 0), (1, 1), (2, 1), (3, 0)}


@given(st.lists(st.integers(1, 1024), min_size=1, max_size=120), st.sampled_from([0.0, 1 / 1024, 1.0]))
@settings(max_examples=60, deadline=None)
def test_place_follows_the_plain_rule(sizes, quadratic):
    """Falling sizes, each to the cheapest sequence with room; cut only where none has room."""
    count = -(-sum(sizes) // packing.CAPACITY)
    sequences, want = [[] for _ in range(count)], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[item]
        while left:
            room = [packing.CAPACITY - sum(s) for s in sequences]
            able = [k for k in range(count) if room[k] >= left] or [k for k in range(count) if room[k]]
            k = min(able, key=lambda k: (sum(n + quadratic * n * n for n in sequences[k]), k))
            take = min(left, room[k])
            want.append((item, start, take, k, sum(sequences[k])))
            sequences[k].append(take)
            start, left = start + take, left - take
    assert packing.place(np.array(sizes, np.int64), quadratic=quadratic) == want


def test_place_looks_past_many_cheap_sequences():
    """Forty cheaper sequences have room for 14 tokens; the dearest one takes the piece whole."""
    placed = packing.place(np.array([900] + [505] * 80 + [100], np.int64))
    assert [p for p in placed if p[0] == 81] == [(81, 0, 100, 0, 900)]
    assert len(placed) == 82
