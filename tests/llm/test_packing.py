import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formbook.llm.packing import Encoder, best_plan, pack, places, plan

FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*FILES)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_files_own(text):
    global _encoder
    _encoder = globals().get("_encoder") or Encoder(*FILES)
    assert _encoder.ids(text) == _encoder._own.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text(encoder):
    text = "a <|endoftext|> b"
    assert encoder.ids(text) == encoder._own.encode(text, add_special_tokens=False).ids


def check(histogram, capacity, bins):
    used = Counter()
    for kind in bins:
        contents = list(kind.contents())
        assert sum(length * copies for length, copies in contents) <= capacity
        for length, copies in contents:
            used[length] += copies * kind.count
    assert used == Counter(histogram)
    return sum(kind.count for kind in bins)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("small", [1.0, 0.5, 0.25, 0.0])
@pytest.mark.parametrize("groups", [1, 3, 64])
def test_plan_places_every_length(small, groups):
    for seed in range(40):
        rng = random.Random(seed)
        capacity = rng.randint(1, 50)
        histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 90)))
        check(histogram, capacity, plan(histogram, capacity, groups, small))


def test_best_plan_is_as_good_as_best_fit():
    for seed in range(20):
        rng = random.Random(seed)
        lengths = [min(200, int(rng.lognormvariate(4, 0.8)) + 1) for _ in range(400)]
        count = check(Counter(lengths), 200, best_plan(Counter(lengths), 200, 64))
        assert count <= best_fit(lengths, 200)
        assert count >= -(-sum(lengths) // 200)


def test_counts_do_not_cost_time():
    histogram = {length: 10**12 + length for length in range(1, 2049)}
    bins = best_plan(histogram, 2048, 256)
    check(histogram, 2048, bins)
    assert len(places(bins)) < 200_000


@pytest.mark.parametrize("capacity, rows_per_part", [(2048, 100_000), (64, 7)])
def test_pack_is_gapless(odd, odd_docs, empty_docs, encoder, capacity, rows_per_part):
    found = pack(odd_docs, capacity=capacity, rows_per_part=rows_per_part).collect()
    want = Counter()
    for doc_id, text, *_ in odd:
        ids = [*encoder.ids(text or ""), 0]
        start, k = 0, 0
        while start < len(ids):
            length = (len(ids) - start - 1) % capacity + 1 if not k else capacity
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            want[doc_id, k, start, length, crc] += 1
            start, k = start + length, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= best_fit([r.length for r in found], capacity)
    assert pack(empty_docs).count() == 0
