import hashlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from formbook.llm.bpe import coder, join, leaves, round_trip

from .conftest import frame

FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(FILES[0]))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def compared(library, docs, found):
    expected = sorted((str(r.doc_id), *want(library, r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == expected


SPECIAL = "<|endoftext|>"
LONG = [
    "x" * 3000, " " * 700 + "end", "\n \n\t " * 300, "'ll" * 400, "don't we'll they're I'm he'd " * 60, "漢字かな" * 300, "😀" * 500,
    "1234567890" * 200, "!?'s" * 300, "a" + SPECIAL * 20 + "b" * 900 + SPECIAL, "̀" * 500, "é è ê " * 200, "=-" * 800 + "ab" * 400,
    "the " + "thethe" * 500 + " " * 99 + "é" * 500, SPECIAL[:-1] * 40, " '" * 300 + "re" * 300, "\x00\x01\x85\xa0" * 200,
]


@pytest.mark.parametrize("leaf, fan", [(7, 2), (64, 3), (16_384, 64)])
def test_equals_the_library(spark, library, odd, leaf, fan):
    docs = frame(spark, odd[:22] + [(200 + i, t, "en", "a") for i, t in enumerate(LONG)] + [((1 << 60) + 1, "x y " * 20, "en", "a")])
    if leaf == 7:  # every character joined somewhere; short of the longest texts
        docs = docs.filter("length(text) < 4000 OR text IS NULL")
    compared(library, docs, round_trip(docs.repartition(3), leaf=leaf, fan=fan))


def test_documents_of_the_small_table(spark, library, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    compared(library, docs, round_trip(docs, leaf=300, fan=4))


def test_empty(spark, empty_docs):
    assert round_trip(empty_docs).collect() == []


PARTS = st.one_of(
    st.text(max_size=30), st.sampled_from(["'", "'l", "l", "ll", "'re", "r", "e", " ", "  ", "\n", "\t\n", "the", " the", "x" * 40, "é", "漢", "12", "!!", "a'", " "]),
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=40), st.data())
@example(["don'", "t" * 30], None)
def test_any_two_halves_join(parts, data):
    use, text = coder(*FILES), "".join(parts)
    for at in range(0, len(text) + 1, max(1, len(text) // 6)) if data is None else [data.draw(st.integers(0, len(text)))]:
        left, right = use.ordinary(text[:at]), use.ordinary(text[at:])
        assert join(left, right, use.spelled, use.ordinary) == use.ordinary(text)


def test_windows_stay_small_in_a_long_run():
    """A join inside one run of a million letters encodes a few tokens again, not the run."""
    use, seen = coder(*FILES), []

    def encode(text):
        seen.append(len(text))
        return use.ordinary(text)

    text = "".join("abcdefghijklmnop"[i * i % 16] for i in range(200_003))
    assert join(use.ordinary(text[:100_001]), use.ordinary(text[100_001:]), use.spelled, encode) == use.ordinary(text)
    assert sum(seen) < 2_000


def test_leaves_are_halves_in_order():
    assert "".join(leaves("abcdefghij", 3)) == "abcdefghij" and max(map(len, leaves("abcdefghij", 3))) <= 3


def test_decoding_gives_the_text_back():
    use = coder(*FILES)
    for text in LONG:
        assert use.decode(use.encode(text)) == text
