import hashlib
from collections import Counter, defaultdict

import pytest

from formbook.llm.exact import exact_groups, without_copies
from formbook.llm.mixing import mix, mixed, targets

from .conftest import WORD, lower


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups_equal_brute_force(odd, odd_docs, keep, fan_in):
    groups = defaultdict(list)
    for doc_id, text, *_ in odd:
        groups[lower(text)].append(doc_id)
    found = exact_groups(odd_docs, keep=keep, fan_in=fan_in).collect()
    assert len(found) == len(odd)
    kept = Counter()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.text_sha256].append(r)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert Counter(r.doc_id for r in by_id[sha]) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in by_id[sha]} == {(best, len(ids))}
        kept = [r.doc_id for r in by_id[sha] if r.kept]
        assert kept == [best]


def test_without_copies_keeps_all_columns(odd, odd_docs, empty_docs):
    found = without_copies(odd_docs)
    assert found.columns == odd_docs.columns
    texts = [lower(r.text) for r in found.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t, *_ in odd})
    assert without_copies(empty_docs).count() == 0 and exact_groups(empty_docs).count() == 0


def test_exact_plan_has_no_python(odd_docs):
    plan = exact_groups(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def fill(sizes, weights, most):
    """Targets by repeating: whoever is above its ceiling stops there, the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return share | {s: most * sizes[s] for s in stopped}
        stopped |= above


def test_mix_meets_targets(odd, odd_docs):
    sizes = defaultdict(int)
    for _, text, _, source in odd:
        sizes[source] += len(WORD.findall(text or ""))
    want = fill(sizes, (5, 2, 1), 3)
    found = mix(odd_docs).collect()
    assert len(found) == len(odd)
    taken, largest = Counter(), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.times * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        # Rows that repeat an identifier are chosen together: up to two of them here.
        assert abs(taken[source] - want[source]) <= largest[source] + 1
    assert as_rows(mix(odd_docs.repartition(3))) == as_rows(mix(odd_docs))


def test_mixed_repeats_documents(odd, odd_docs, empty_docs):
    times = Counter()
    for r in mix(odd_docs).collect():
        times[r.doc_id, r.size] += 1 if r.size == 0 else r.times
    found = mixed(odd_docs)
    assert found.columns == odd_docs.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in found.collect())
    assert got == +times
    assert mix(empty_docs).count() == 0 and mixed(empty_docs).count() == 0


def test_mix_of_one_source_takes_all(spark):
    docs = spark.createDataFrame([(i, "w " * i, None) for i in range(20)], "doc_id long, text string, source string")
    assert all(r.times == 1 for r in mix(docs).collect() if r["size"])


def test_targets_of_a_billion_words(spark):
    """Words that fit 32 bits, times a weight that does not."""
    words = {"a": 700_000_000, "b": 20_000_000, "c": 300_000_000, "d": 2_000_000, None: 100_000_000}
    assert sum(words.values()) < 2**31 < 2 * sum(words.values())
    rows = [("=" + s if s else "", s, size) for s, size in words.items()]
    sizes = spark.createDataFrame(rows, "_source string, source string, source_size long")
    found = {r["_source"][1:] or None: r.target for r in targets(sizes, (5, 2, 1), 3).collect()}
    assert found == pytest.approx(fill(words, (5, 2, 1), 3))


def test_large_weights_share_like_small_ones(odd_docs):
    """Few words, times weights that leave 32 bits."""
    large = (500_000_000, 200_000_000, 100_000_000)
    assert as_rows(mix(odd_docs, weights=large)) == as_rows(mix(odd_docs))
