import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from formbook.llm.simhash import cell_links, components, fingerprint, gray_rank, near_duplicates, near_links, without_near_copies

from .conftest import WORD, lower


def brute_print(text, width=4):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def near_values(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)
    values = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        flip = rng.random(n) < 0.6
        values = np.where(flip, values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), values)
    return np.unique(values)


@given(st.text(alphabet="aAbBÉé \t\n\x0b\x85漢", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_brute_force(text):
    assert fingerprint(text.encode(), 4) == brute_print(text)


def test_gray_rank_inverts_the_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("n", [1, 2, 8, 9, 33, 500, 2500])
def test_cell_links_connect_what_the_radius_connects(n):
    values = near_values(n, n)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = grouped(len(values), zip(*np.nonzero(apart <= 4)))
    place = {int(v): i for i, v in enumerate(values)}
    a, b = cell_links(values, 4, at_once=1000)
    assert len(a) <= len(values)
    assert grouped(len(values), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]) == want


@pytest.mark.parametrize("radius", [2, 4])
def test_links_and_components_over_cells(spark, radius):
    values = near_values(1500, 5)
    signed = values.view(np.int64).tolist()
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, name long").repartition(4)
    want = grouped(len(values), zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)))
    found = {r.fp: r.component for r in components(near_links(prints, radius), prints).collect()}
    assert [found.get(v, i) for i, v in enumerate(signed)] == want


def test_long_chain_has_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    names = spark.createDataFrame([(i, i) for i in range(301)], "fp long, name long")
    assert {r.component for r in components(links, names).collect()} == {0}


def test_near_duplicates_equal_brute_force(odd, odd_docs, empty_docs):
    prints = [brute_print(t) for _, t, *_ in odd]
    roots = grouped(len(odd), [(i, j) for i in range(len(odd)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    members = defaultdict(list)
    for (doc_id, *_), root in zip(odd, roots):
        members[root].append(doc_id)
    name = {root: min((i for i in ids if i is not None), default=None) for root, ids in members.items()}
    want = sorted(((r[0] is None, r[0] or 0), f"{p:016x}", name[root]) for r, p, root in zip(odd, prints, roots))
    found = near_duplicates(odd_docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in found) == want
    assert sum(r.kept for r in found) == len(members)
    left = without_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == len(members)
    assert near_duplicates(empty_docs).count() == 0


def test_dense_ball_needs_no_pairs():
    rng = random.Random(1)
    center = rng.getrandbits(64)
    ball = np.unique(np.array([center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)], dtype=np.uint64))
    a, b = cell_links(ball, 4)
    assert len(a) == len(ball) - 1


def test_cells_beyond_a_size_are_joined_block_by_block(spark):
    """A hot template: most fingerprints are a few bits from one, so they share cells; blocks of ten at most."""
    rng = random.Random(2)
    template = rng.getrandbits(64)
    prints = {template ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long").repartition(4)
    place = {v: i for i, v in enumerate(signed.values())}
    want = grouped(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    for most in (10, 100_000):
        links = [(place[r.a], place[r.b]) for r in near_links(df, 4, most).collect()]
        assert grouped(len(prints), links) == want
