"""Encoding, decoding and packing beside the public libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from rowassay.llm import catalog, packing, sentencepieces
from rowassay.llm.bpe import Merges, merge_rounds
from rowassay.llm.common import vocabulary


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_pieces_equal_the_library(odd, library):
    for r in sentencepieces.round_trip(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert list(r["piece_ids"]) == library.encode(r["text"] or ""), r["text"]
        assert r["decoded"] == library.decode(list(r["piece_ids"]))


def test_no_row_is_lost(odd, empty):
    assert sentencepieces.encode(odd).count() == odd.count()
    assert sentencepieces.encode(empty).count() == 0


def test_random_texts(spark, library):
    pick = random.Random(3)
    texts = ["".join(pick.choice("abcdeinorst  .▁é\n𝒳<0x>") for _ in range(pick.randint(0, 60))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: list(r["piece_ids"]) for r in sentencepieces.encode(frame).collect()}
    assert [found[i] for i in range(len(texts))] == [library.encode(t) for t in texts]


def test_decoding_any_ids(spark, library):
    pick = random.Random(5)
    # control and unknown ids, bytes that are no UTF-8, marks at the start
    lists = [[], [1, 2], [259, 259], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [3 + 0xE2, 3 + 0x82, 300], [1, 300, 2], *([pick.randint(1, 31999) for _ in range(20)] for _ in range(50))]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(99, None)], "doc_id long, piece_ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in sentencepieces.decode(frame).collect()}
    assert found.pop(99) == ""
    assert [found[i] for i in range(len(lists))] == [library.decode(x) for x in lists]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=6), st.permutations(["ab", "bc", "aa", "abc", "ca", "aab", "bca", "abab"]))
def test_rounds_equal_one_merge_at_a_time(words, pieces):
    names = ["a", "b", "c", *pieces]
    number = {p: i for i, p in enumerate(names)}
    parts = [(number[p[:k]], number[p[k:]], number[p], rank) for rank, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
    merges = Merges(*zip(*parts))
    rank = {(a, b): (r, i) for a, b, i, r in parts}
    symbols, sizes = merge_rounds(np.array([number[c] for w in words for c in w]), np.array([len(w) for w in words]), merges)
    ends = np.cumsum(sizes)
    for word, end, size in zip(words, ends, sizes):
        left = [number[c] for c in word]
        while True:
            ranked = [(*rank[pair], at) for at, pair in enumerate(zip(left, left[1:])) if pair in rank]
            if not ranked:
                break
            _, into, at = min(ranked, key=lambda x: (x[0], x[2]))
            left[at : at + 2] = [into]
        assert symbols[end - size : end].tolist() == left


def test_packing(odd, tokenizer):
    size = 7
    rows = packing.pack(odd, size=size).collect()
    by_text = {}
    for r in odd.collect():
        by_text.setdefault(r["doc_id"], []).append(r["text"])
    expected = sorted(
        (-1 if doc is None else doc, k, start, len(part), zlib.crc32(part.tobytes()))
        for doc, texts in by_text.items()
        for text in texts
        for ids in [np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)]
        for k, start in enumerate(range(0, len(ids), size))
        for part in [ids[start : start + size]]
    )
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    _gapless(rows, size)


def _gapless(rows, size):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing_needs_few_sequences(documents):
    rows = packing.pack(documents).collect()
    used = _gapless(rows, 4096)
    assert used <= 1 + 1.01 * sum(r["length"] for r in rows) / 4096


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_plan_places_every_rank_once(histogram):
    runs = sorted(packing.plan(histogram, 40))
    cells, room = set(), {}
    for k, (length, first, each, sequence, offset) in enumerate(runs):
        after = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else histogram[length]
        assert first < after
        for rank in range(first, after):
            turn, slot = divmod(rank - first, each)
            at = offset + slot * length
            for cell in range(at, at + length):
                assert (sequence + turn, cell) not in cells and cell < 40
                cells.add((sequence + turn, cell))
            room[sequence + turn] = room.get(sequence + turn, 0) + length
    assert sum(room.values()) == sum(n * c for n, c in histogram.items())
    assert sorted(room) == list(range(len(room)))


def test_queries(spark, small, library):
    done = {r["doc_id"]: r for r in catalog.QUERIES["op9_sentencepiece"](spark, SMALL).collect()}
    assert len(done) == len(small)
    for r in small:
        ids = library.encode(r["text"] or "")
        got = done[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
