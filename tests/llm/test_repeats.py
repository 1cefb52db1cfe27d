import hashlib
import random

import numpy as np
import pytest

from formbook.llm import repeats
from formbook.llm.repeats import anchors, remove_repeats

from .conftest import frame


def brute(docs, least):
    """Documents in order; every string of ``least`` bytes looked up among those that start earlier."""
    seen, found = set(), []
    for doc_id, raw in docs:
        gone = np.zeros(len(raw), dtype=bool)
        for at in range(len(raw) - least + 1):
            string = raw[at : at + least]
            if string in seen:
                gone[at : at + least] = True
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        found.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def shuffled_passages(seed, n, doc):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    text = lambda: "".join(rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(0, doc)))
    return [(i, text()) for i in rng.sample(range(n), n)]


@pytest.mark.parametrize("seed, least, fan_in", [(1, 100, 32), (2, 40, 2), (3, 255, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, least, fan_in):
    monkeypatch.setattr(repeats, "_BLOCK", 4000)
    monkeypatch.setattr(repeats, "_BUCKET", 20_000)
    docs = shuffled_passages(seed, 120, 12)
    found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), least, fan_in)
    want = brute([(i, t.encode()) for i, t in sorted(docs)], least)
    assert ordered(tuple(r) for r in found.collect()) == ordered(want)


def test_odd_rows(odd, odd_docs, empty_docs):
    found = ordered(tuple(r) for r in remove_repeats(odd_docs).collect())
    known = sorted(((d, (t or "").encode()) for d, t, *_ in odd), key=lambda r: (r[0] is None, r[0] or 0))
    assert found == ordered(brute(known, 100))
    assert remove_repeats(empty_docs).count() == 0


def test_rows_that_repeat_an_identifier(spark):
    text = "".join(random.Random(1).choices("abcdef", k=400))
    docs = frame(spark, [(5, text, "en", "a")] * 3 + [(None, text, "en", "a"), (4, text[:250], "en", "a")])
    found = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect())
    # 301 windows; 151 of them are in document 4 and cover its 250 bytes.
    assert found == [(0, 400), (4, 0), (5, 250), (5, 400), (5, 400)]


def test_windows_elect_anchors_by_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 256, 500, dtype=np.uint8)
    text = np.concatenate((rng.integers(0, 256, 333, dtype=np.uint8), shared, rng.integers(0, 256, 77, dtype=np.uint8), shared))
    anchor, first, last, hashes = anchors(text, np.array([333 + 500, len(text)]), 100)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(covered) == [*range(0, 833 - 99), *range(833, len(text) - 99)]
    assert ((first <= anchor) & (anchor + 32 <= first + 100) & (last <= anchor)).all()
    elect = {int(s): (int(a - s), int(h)) for a, f, l, h in zip(anchor, first, last, hashes) for s in range(f, l + 1)}
    assert all(elect[333 + i] == elect[910 + i] for i in range(401))


def test_least_is_bounded(odd_docs):
    with pytest.raises(ValueError):
        remove_repeats(odd_docs, least=20)
    with pytest.raises(ValueError):
        remove_repeats(odd_docs, fan_in=1)


def factor_array(text):
    """Longest previous factors from a plain suffix array: common prefixes with the previous and the next smaller position
    in suffix order, found by a stack."""
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def common(i, j):
        n = 0
        while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n

    factor = [0] * len(text)
    for sequence in (order, order[::-1]):  # previous smaller, then next smaller positions
        stack = []
        for at in sequence:
            while stack and stack[-1] > at:
                stack.pop()
            if stack:
                factor[at] = max(factor[at], common(stack[-1], at))
            stack.append(at)
    return factor


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_removal_equals_an_independent_factor_array(spark, monkeypatch, seed):
    """Documents end to end, each closed by a character of its own: what a factor of 40 or more covers goes."""
    monkeypatch.setattr(repeats, "_BLOCK", 500)
    docs = sorted((i, t.replace("é", "e")) for i, t in shuffled_passages(seed, 25, 4))
    text, begins = "", {}
    for i, t in docs:
        begins[i] = len(text)
        text += t + chr(0x1000 + i)
    covered = [False] * len(text)
    for at, factor in enumerate(factor_array(text)):
        if factor >= 40:
            covered[at : at + 40] = [True] * 40
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 40).collect()}
    for i, t in docs:
        gone = covered[begins[i] : begins[i] + len(t)]
        kept = "".join(c for c, g in zip(t, gone) if not g)
        assert got[i] == (sum(gone), hashlib.sha256(kept.encode()).hexdigest())
