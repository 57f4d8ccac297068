import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartlode.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("size", [64, 1024])
def test_pieces_cover_each_document_and_fill_sequences_without_gaps(odd, texts, size):
    rows = packing.pack(odd, JSON, ranks=RANKS, size=size, keep_ids=True).collect()
    encode = packing.encoder(JSON, None)
    want = Counter()
    for doc, text, *_ in texts:
        ids = [*encode(text or ""), 2]
        first = len(ids) % size or size if len(ids) > size else len(ids)
        for k, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start : start + (size if k else first)]
            want[doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size


def test_an_empty_table_packs_to_nothing(empty):
    assert packing.pack(empty, JSON, ranks=RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 20), max_size=12))
def test_plans_use_every_piece_once_and_no_more_sequences_than_best_fit(counts):
    patterns = packing.plan(counts, 32)
    used = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 32
        for x in lengths:
            used[x] += n
    assert used == Counter(counts)
    assert sum(n for n, _ in patterns) <= sum(n for n, _ in packing.best_fit(np.array([counts.get(x, 0) for x in range(33)]), 32))
    assert sum(n for n, _ in patterns) >= -(-sum(k * v for k, v in counts.items()) // 32)


def test_exact_complements_are_found():
    assert packing.plan({10: 3, 22: 3}, 32) == [(3, [22, 10])]
    assert sum(n for n, _ in packing.plan({20: 2, 7: 2, 5: 2}, 32)) == 2
    assert sum(n for n, _ in packing.plan({17: 1, 8: 1, 4: 1, 3: 1}, 32)) == 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=10), st.integers(1, 12), st.integers(1, 12), st.integers(1, 3))
def test_sums_give_every_combination_once(counts, gap, most, kind):
    got = [tuple(c) for c in packing.Sums(counts, 12).of(gap, most, kind)]
    assert sorted(got) == sorted(c for c in combinations_with_replacement(sorted(counts, reverse=True), kind) if sum(c) == gap and max(c) <= most)


def test_combinations_that_would_cost_a_sequence_are_left_to_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.clip(rng.lognormal(3.5, 1, rng.integers(20, 400)).astype(int), 1, 128)
        counts = Counter(lengths.tolist())
        best = sum(n for n, _ in packing.best_fit(np.array([counts.get(x, 0) for x in range(129)]), 128))
        patterns = packing.plan(counts, 128)
        assert sum(n for n, _ in patterns) <= best
        assert any(sum(p) == 128 and len(p) in (2, 3, 4) for _, p in patterns)


def test_both_tokenizers_give_the_same_ids():
    fast, slow = packing.encoder(JSON, RANKS), packing.encoder(JSON, None)
    for text in ("", " ", "Hello  world\n\n", "naïve — café 東京 🙂", "a" * 3000, "x<|endoftext|>y", "1234567 it's\tI'LL"):
        assert list(fast(text)) == list(slow(text))
