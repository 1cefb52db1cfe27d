import random

import corpus_pipeline
import numpy as np
from formbook.llm import jaccard
from formbook.llm.jaccard import parities, shingles, similar, without_similar

from .conftest import WORD, frame, lower
from .test_simhash import grouped

FOLDER = "/root/testdata/sf0.001"


def brute_set(text, width=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_roots(texts):
    sets = [brute_set(t) for t in texts]
    near = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    return grouped(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])


def variants():
    """Texts with one to thirty words changed, so that similarities lie on both sides of 0.8, and a line that many share."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(50, 250))]
        for _ in range(10):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text) + (" this line stands in every other text of the whole table" if rng.random() < 0.5 else ""))
    return [(i, t, "en", "a") for i, t in enumerate(rows)]


def check(docs, rows):
    roots = brute_roots([t for _, t, *_ in rows])
    left = without_similar(docs)
    assert left.columns == docs.columns and left.count() == len(set(roots))
    return roots


def test_components_equal_brute_force(spark, odd, odd_docs, empty_docs):
    rows = variants()
    docs = frame(spark, rows).repartition(4)
    roots = check(docs, rows)
    assert 12 < len(set(roots)) < len(rows)
    assert {r.doc_id: r.component_id for r in similar(docs).collect()} == dict(enumerate(roots))
    check(odd_docs, odd)
    assert without_similar(empty_docs).count() == 0


def test_pipeline_stage_drops_every_similar_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = brute_roots([t for _, t in rows])
    out = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert {r.doc_id for r in out.collect()} == {rows[i][0] for i in roots}


def test_sketches_find_more_than_nine_tenths(spark):
    """Pairs just above 0.8, far from each other in fingerprint: what share is linked, against brute force."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 400
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        other = list(base)
        while True:  # one word less at a time, until the next would go below
            trial = list(other)
            trial[rng.randrange(len(trial))] = rng.choice(words)
            x, y = brute_set(" ".join(base)), brute_set(" ".join(trial))
            if 10 * len(x & y) < 8 * len(x | y):
                break
            other = trial
        rows += [(2 * i, " ".join(base), "en", "a"), (2 * i + 1, " ".join(other), "en", "a")]
    found = {r.doc_id: r.component_id for r in similar(frame(spark, rows).repartition(4)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(n)) >= 0.99 * n
    assert all(found[2 * i] == 2 * i for i in range(n))


def test_a_hot_group_and_texts_that_share_most_words(spark):
    """A third are variants of one text; another third share a long passage, too little to be similar."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    template, passage = prose(200), prose(100)
    rows = []
    for _ in range(60):
        text = list(template)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(200)] = rng.choice(words)
        rows += [" ".join(text), " ".join(passage + prose(60)), " ".join(prose(rng.randint(50, 200)))]
    rows = [(i, t, "en", "a") for i, t in enumerate(rows)]
    check(frame(spark, rows).repartition(5), rows)


def template_texts(count):
    """Texts of one template with a tenth of the words changed, most pairs somewhat below 0.8, and a near copy of every tenth."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    template, rows = [rng.choice(words) for _ in range(160)], []
    for i in range(count):
        text = list(template)
        for at in rng.sample(range(160), 8):
            text[at] = rng.choice(words)
        rows.append(" ".join(text))
        if i % 10 == 0:
            text[rng.randrange(160)] = rng.choice(words)
            rows.append(" ".join(text))
    return [(i, t, "en", "a") for i, t in enumerate(rows)]


def test_texts_of_a_template_that_are_less_than_similar_are_not_paired(spark, monkeypatch):
    rows, compared, linked = template_texts(250), [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda texts, pairs, *rest: compared.append(pairs.distinct().count()) or linked(texts, pairs, *rest))
    check(frame(spark, rows).repartition(4), rows)
    assert compared[1] < 2 * len(rows)


def test_no_similar_pair_fails_the_parities():
    sets = [shingles(t.encode(), 5) for _, t, *_ in variants() + template_texts(60)]
    odd = [parities(s).view(np.uint64) for s in sets]
    near = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            only_one = len(np.setxor1d(x, y, assume_unique=True))
            places = int(np.bitwise_count(odd[i] ^ odd[j]).sum())
            assert places <= only_one
            if 10 * (len(x) + len(y) - only_one) >= 8 * (len(x) + len(y) + only_one):
                near += 1
                assert 9 * places <= len(x) + len(y)
    assert near > 100
