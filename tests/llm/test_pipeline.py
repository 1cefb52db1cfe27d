from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from formbook.llm.packing import Encoder
from formbook.operators import durable

from .conftest import WORD, frame, lower
from .test_exact_and_mixing import fill
from .test_jaccard import brute_roots
from .test_packing import best_fit
from .test_quality import brute as brute_counts

FOLDER = "/root/testdata/sf0.001"


def documents(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage, each written and read again."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        found.append((name, docs, out))
        docs = out
    return found


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    for _, docs, out in stages[:-1]:
        assert out.columns == docs.columns


def test_quality_stage(stages):
    _, docs, out = stages[0]
    kept = set(documents(out))
    for doc_id, r in documents(docs).items():
        words, _, symbols, _, again = brute_counts(r.text)
        if words < 50 or 100 * again > 50 * words:
            assert doc_id not in kept
        elif not symbols:
            assert doc_id in kept


def test_exact_stage(stages):
    _, docs, out = stages[1]
    want = {}
    for doc_id, r in documents(docs).items():
        want[lower(r.text)] = max(doc_id, want.get(lower(r.text), doc_id))
    assert set(documents(out)) == set(want.values())


def test_near_stage(stages):
    """Brute force over all pairs: five-word shingle sets with a Jaccard similarity of 0.8 or more; the smallest identifier stays."""
    _, docs, out = stages[2]
    rows = documents(docs)
    ids = sorted(rows)
    roots = brute_roots([rows[i].text for i in ids])
    assert set(documents(out)) == {ids[r] for r in roots}


def test_mixing_stage(stages):
    _, docs, out = stages[3]
    sizes, largest, taken = defaultdict(int), defaultdict(int), Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text))
    for source, target in fill(sizes, (5, 2, 1), 3).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1


def test_packing_stage_and_run(spark, stages):
    _, docs, out = stages[4]
    encoder = Encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    lengths = Counter()
    for r in docs.collect():
        n = len(encoder.ids(r.text)) + 1
        lengths[(n - 1) % 2048 + 1] += 1
        lengths[2048] += (n - 1) // 2048
    got = out.collect()
    assert Counter(r.length for r in got) == +lengths
    assert len({r.sequence_id for r in got}) <= best_fit([r.length for r in got], 2048)
    again = corpus_pipeline.run(spark, FOLDER)
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again.collect()) == key(got)


def test_stages_take_odd_and_empty_documents(spark, odd_docs, empty_docs):
    for docs in (odd_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER).cache()
            docs.count()
    assert docs.count() == 0


def test_near_stage_keeps_one_of_each_component(spark):
    docs = frame(spark, [(3, "a b c d e f", "en", "a"), (2, "a b c d e f", "en", "b"), (2, "a B c d e f", "en", "b"), (9, "other words here now", "en", "a")])
    out = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in out.collect()) == [2, 9]


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:3]], ids=["quality", "exact", "near"])
def test_stages_over_a_table_leave_no_copy_of_it(spark, monkeypatch, tmp_path, stage):
    """A table that is read again holds its texts already; only numbers of rows stay behind. The rows are those that a copy gives."""
    path = f"{tmp_path}/documents.parquet"
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3).write.parquet(path)
    docs, folder = spark.read.parquet(path), tmp_path / "shared"
    monkeypatch.setattr(durable, "shared_folder", lambda spark: str(folder))
    found = sorted(stage(spark, docs, FOLDER).collect(), key=str)
    size = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    assert size(folder) < size(tmp_path / "documents.parquet") / 4
    assert len(found) < docs.count()
    assert found == sorted(stage(spark, docs.filter("true OR rand() < 2"), FOLDER).collect(), key=str)
