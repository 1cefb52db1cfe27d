import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _row long, _doc string, _key string,"
    " _hash long, _stratum string, size long, kept boolean, piece int"
)
CLASHES = (7, "x", "y", 1, "z", 5, True, 3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHES) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, long texts, odd characters."""
    rng = random.Random(3)
    syllables = "the an re ou st ing ion er ha to".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    first, second = prose(300), prose(120)
    rows = [
        (1, None, "en", "b"), (2, "", None, None), (3, " \t\n ", "en", "b"), (4, "One", "en", None), (4, "One", "en", None),
        (4, "other words", "de", "a"), (None, "no name", "en", "a"), (None, None, None, None),
        (10, first, "en", "a"), (11, first.upper(), "en", "a"), (12, first, "en", "c"), (13, first + " tail", "en", "é"),
        (14, first.replace("ing", "ung", 1), "en", "b"), (15, second, "fr", "b"), (16, second + "\n" + second, "fr", "b"),
        (17, "É " + second[5:] + " ü 漢字   \x85 end", "fr", "b"), (18, "x" * 5000, "de", "c"), (19, "ab" * 3000, "de", "c"),
        (20, prose(9000), "en", "a"), (21, "line one\nline one\nline two\n\nline two", "en", "a"),
    ]
    rows += [(30 + i, prose(rng.randint(1, 150)), rng.choice(["en", "de", None]), rng.choice("abcd")) for i in range(40)]
    rows += [(100 + i, second, "fr", "hot") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    return frame(spark, odd).repartition(5).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
