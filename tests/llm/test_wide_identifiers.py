import pytest

from formbook.llm.langid import identify
from formbook.llm.packing import pack
from formbook.llm.repeats import remove_repeats
from formbook.llm.warc import normalise, round_trip, write_monolithic

WIDE = 2**60


def test_archives_keep_wide_identifiers_next_to_nulls(spark, tmp_path):
    rows = [(WIDE + 1, "u", "<p>one</p>"), (None, "u", "<p>two</p>"), (WIDE + 3, "u", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = {(r.page_id, r.refers_to) for r in round_trip(pages).collect()}
    assert found == {(WIDE + 1, None), (None, None), (WIDE + 3, WIDE + 1)}
    write_monolithic(pages, f"file://{tmp_path}/mono")
    index = normalise(spark, f"file://{tmp_path}/mono", f"file://{tmp_path}/members")
    assert {r.page_id for r in index.collect()} == {WIDE + 1, None, WIDE + 3}


@pytest.mark.parametrize("operator", [remove_repeats, lambda d: pack(d, 2048), identify], ids=["repeats", "packing", "langid"])
def test_documents_keep_wide_identifiers_next_to_nulls(spark, operator):
    rows = [(WIDE + 1, "one two " * 60, "en"), (None, "three four " * 60, "en"), (WIDE + 3, "five six " * 60, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    found = operator(docs)
    assert found.schema["doc_id"].dataType.simpleString() == "bigint"
    assert {r.doc_id for r in found.collect()} == {WIDE + 1, None, WIDE + 3}
