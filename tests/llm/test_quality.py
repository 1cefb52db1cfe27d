import math
import random
from collections import Counter

import numpy as np
import pytest

from formbook.llm.quality import CUTOFFS, _binomial_cdf, certified, good_documents, judge

from .conftest import WORD


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered))


def test_counts_equal_brute_force(spark, odd, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    found = judge(odd_docs, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    want = [(d, *brute(t)) for d, t, *_ in odd]
    assert sorted(got, key=key) == sorted(want, key=key)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # two labels certify nothing
    assert judge(empty_docs, labels).count() == 0 and judge(odd_docs, labels.limit(0)).count() == len(odd)


@pytest.mark.parametrize("n, p", [(1, 0.3), (40, 0.02), (300, 0.5)])
def test_binomial_is_exact(n, p):
    for k in range(0, n + 1, max(1, n // 7)):
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert _binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_certified_rates_hold():
    """Over many draws, a certified cutoff's true false rejection rate exceeds the risk about as seldom as stated."""
    rng, risk, level, broken = np.random.default_rng(4), 0.05, 0.05, 0
    true = 1.0 - np.array(CUTOFFS)  # uniform shares: P(share > c)
    for _ in range(300):
        shares = rng.random(400)
        bucket = np.array([sum(s <= c for c in CUTOFFS) for s in shares])
        steps = certified(np.bincount(bucket, minlength=len(CUTOFFS) + 1), risk, level)
        broken += steps > 0 and true[steps - 1] > risk
    assert broken <= 0.05 * 300 + 3 * math.sqrt(300 * 0.05 * 0.95)
    assert certified(np.zeros(len(CUTOFFS) + 1, dtype=int), risk, level) == 0


def test_rules_find_bad_documents_and_keep_good(spark):
    rng = random.Random(2)
    syllables = "the an re ou st ing ion er ha to de la".split()
    words = lambda: ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(80)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "###" * bad for w in words()), "en" if i % 2 else "de"))
        if i % 10:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert found == {i: i % 3 != 0 for i in range(1500)}
    left = good_documents(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in range(1500) if i % 3}
