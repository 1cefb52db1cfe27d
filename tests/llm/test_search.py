import math
import re
from collections import Counter

import numpy as np
import pytest

from formbook.llm import search
from formbook.llm.search import Block, Best, Statistics, ranked, terms, tile_scores

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, _row long, score string"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most):
    """docs, items: (identifier, text). Every document against every item, in whole numbers."""
    counts = [(name, Counter(split(text))) for name, text in docs]
    total = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for name, c in counts:
            score = 0
            for term in set(split(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                m = 50 + 50 * sum(c.values()) * total // length
                score += w * (10**9 * c[term] // (1000 * c[term] + 20 * m))
            if score > 0:
                scored.append((-score, name is None, name or 0, name))
        found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:most], 1)]
    return sorted(found, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(odd):
    texts = [None, "", "...", "One one ONE words", odd[8][1][:300], odd[15][1], "É ü 漢字 x", odd[18][1], "the The re"]
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(7, "other words")]


@pytest.mark.parametrize("most", [1, 7, 50])
def test_equals_brute_force(spark, odd, odd_docs, items, most):
    asked = spark.createDataFrame([(*i, 3, 4, "s") for i in items], ITEMS)
    docs = [(r[0], r[1]) for r in odd]
    assert rows(ranked(odd_docs, asked, most=most)) == brute(docs, items, most)


def test_blocks_and_tiles_do_not_matter(spark, odd, odd_docs, items, monkeypatch):
    asked = spark.createDataFrame([(*i, 3, 4, "s") for i in items], ITEMS)
    monkeypatch.setattr(search, "_TILE", 3)
    found = ranked(odd_docs, asked, most=5, block_items=2, block_terms=10)
    assert rows(found) == brute([(r[0], r[1]) for r in odd], items, 5)


def test_empty(spark, odd_docs, empty_docs, items):
    asked = spark.createDataFrame([(*i, 3, 4, "s") for i in items], ITEMS)
    assert ranked(empty_docs, asked).count() == 0
    assert ranked(odd_docs, asked.limit(0)).count() == 0
    assert ranked(odd_docs.filter("text IS NULL"), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_are_ascii_alphanumerics_and_all_beyond():
    every = "".join(map(chr, range(1, 0x300))) + "Ａ漢 z"
    assert [t.decode() for t in terms(every.encode())] == split(every)


def test_sums_beyond_float_precision_are_exact():
    """So large impacts that a single product over all columns would pass 2**53."""
    n, weight = 40, (1 << 53) // 10**6 - 7
    block = Block(np.array([9]), {bytes([65 + i]): i for i in range(n)}, np.zeros(n, dtype=np.int64), np.arange(n))
    known = Statistics(10, 100, np.full(n, weight))
    found = [(100, np.arange(n), np.arange(1, n + 1))]
    want = sum(weight * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * 100 * 10 // 100))) for tf in range(1, n + 1))
    assert want > 1 << 53 and tile_scores(block, known, found).tolist() == [[want]]


def test_ties_at_the_cut_go_by_identifier():
    best = Best(1, 3)
    for ids in ([50, 40], [30, 20, 10], [5, 60]):
        best.add(np.full((1, len(ids)), 7), np.array(ids), np.zeros(len(ids), dtype=np.int64))
        best.shrink()
    assert best.shrink()[2].tolist() == [5, 10, 20]
