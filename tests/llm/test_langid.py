import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from formbook.llm import langid
from formbook.llm.queries import op9_language_id

COUNTS = {("a", b" th"): 5, ("a", b"he"): 3, ("b", b" t"): 4, ("b", b"e"): 9, ("a", b"the"): 2, ("b", "é".encode()): 2}


@pytest.fixture(scope="module")
def model():
    return langid.Model(COUNTS, {"a": 1, "b": 2})


def brute(model, word, language):
    pieces = sorted({bytes([b]) for b in range(256)} | {p for _, p in COUNTS})
    p = dict(zip(pieces, model.probability[:, language]))

    @lru_cache(None)
    def rest(i):
        return 1.0 if i == len(word) else sum(p[word[i:j]] * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in p)

    return math.log(rest(0))


def test_forward_sums_all_segmentations(model):
    words = [b" the", b" thhethethe", b" x", b" " + b"the" * 12, " éthé".encode(), b" "]
    want = [[brute(model, w, g) for g in range(2)] for w in words]
    assert np.allclose(model.log_likelihoods(words), want)
    assert np.allclose(model.probability.sum(axis=0), 1)


def log_sums(model, word):
    """The sum over all segmentations of a word of any length, byte by byte, each language in logarithms."""
    pieces = sorted({bytes([b]) for b in range(256)} | {p for _, p in COUNTS})
    place, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    logs = [np.zeros(2)]
    for stop in range(1, len(word) + 1):
        ways = [logs[a] + np.log(model.probability[place[word[a:stop]]]) for a in range(max(0, stop - longest), stop) if word[a:stop] in place]
        logs.append(np.logaddexp.reduce(ways))
    return logs[-1]


def test_long_words_equal_brute_force(model, monkeypatch):
    """No segmentation is lost at any border: words longer than a stretch, together with short ones, and of exactly its length."""
    words = [b" " + b"the" * 700, (" " + "éthe" * 500).encode(), b" the", b"", b" " + b"he" * 255 + b"t", b" " + b"t" * 511, b" " + b"the " * 256]
    want = [log_sums(model, w) if w else np.zeros(2) for w in words]
    for stretch in (512, 7, 1):
        monkeypatch.setattr(langid, "_STRETCH", stretch)
        assert np.allclose(model.log_likelihoods(words), want, rtol=1e-10)


def test_long_words_do_not_underflow(model):
    scorer = langid.Scorer(model, remember=10)
    assert np.isfinite(model.log_likelihoods([b" " + b"q" * 5000])).all()
    texts = [b"the " * 50, b"q" * 100_000, b"he he", b"e e e"]
    once = scorer.posteriors(texts)
    for _ in range(3):  # forgotten words are scored again
        assert np.allclose(scorer.posteriors(texts), once)
    assert np.allclose(once.sum(axis=1), 1)


def test_odd_rows(spark, odd, odd_docs, empty_docs):
    found = langid.identify(odd_docs)
    got = found.collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in odd)
    learned = {x for _, _, x, _ in odd if x}
    for r in got:
        assert r.lang_pred in learned | {"und"} and 0 <= r.score <= 1
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and 20 not in und
    assert langid.identify(empty_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs["_doc"].substr(1, 0)).filter("false").unionByName(odd_docs.selectExpr("* except (lang)", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op9_language_id(spark, folder).collect() if r.held_out]
    assert len(held) > 250
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_predictions_equal_brute_force(spark, model):
    texts = [b"the the", b"e e", b"he the \xc3\xa9th", b"123", b"", b" \n"]
    rows = [(i, False, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, _raw binary")
    for r in langid.predict(docs, model).collect():
        if not any(chr(b).isalpha() for b in texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = [sum(brute(model, b" " + w, g) for w in texts[r.doc_id].split()) + math.log((g + 1) / 3) for g in range(2)]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert r.lang_pred == "ab"[logs.index(max(logs))] and r.score == pytest.approx(max(odds) / sum(odds))
