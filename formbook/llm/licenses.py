"""Licence scans with a positional rare-token index.

Licence notices are templates: words in order, part of which is a mandatory key phrase. The index
lists every template under the word of its key phrase that is rarest in the corpus (highest inverse document
frequency, counted over all documents). In a document, the templates whose key words are all present are
looked up by that word: each place where it stands proposes the place at which the template would begin. There the
template's postings are intersected with the document's words by relative position; the place is verified if the whole
key phrase stands there, and what else of the notice does makes the score.

The index is small and fixed, so it is a literal and a document is matched inside its row: nothing is
exploded, joined or shuffled but the counts of licence words. Only documents that have all words of some key phrase keep
their words for it. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import ascii_lower
from formbook.operators.durable import written

#: The word pattern and the base phrases with their labels, as stated.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Label, notice, key phrase (which stands in the notice).
NOTICES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the"
        " software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to"
        " the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "to deal in the software without restriction",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
        " arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial"
        " applications and to alter it and redistribute it freely subject to the following restrictions",
        "to alter it and redistribute it freely",
    ),
    (
        "bsd-2-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
        " the documentation and or other materials provided with the distribution",
        "redistributions in binary form must reproduce",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
        "endorse or promote products derived from this software",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may"
        " obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
        " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing software distributed under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published"
        " by the free software foundation either version 3 of the license or at your option any later version",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
)


def postings_values(notices=NOTICES, base=BASE) -> str:
    """Rows ``(template, label, is_base, nth, word, is_key)`` of all templates, as SQL values."""
    every = [(label, phrase, phrase, True) for label, phrase in base] + [(*n, False) for n in notices]
    rows = []
    for number, (label, notice, key, is_base) in enumerate(every):
        words, wanted = notice.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        for at, word in enumerate(words):
            rows.append(f"({number}, '{label}', {is_base}, {at}, '{word}', {first <= at < first + len(wanted)})")
    return "VALUES " + ", ".join(rows)


def _phrases(notices, base) -> Iterator[tuple[str, list[str], int, list[str], bool]]:
    """Label, words, place and words of the key phrase, and whether it is a base phrase."""
    for label, notice, key, is_base in [*((label, p, p, True) for label, p in base), *((*n, False) for n in notices)]:
        words, wanted = notice.split(), key.split()
        yield label, words, next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted), wanted, is_base


def _strings(words) -> Column:
    return F.array(*map(F.lit, words))


def tokenized(docs: DataFrame, notices, base, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, _present`` (licence words it has), ``_words`` (all words in order; null unless all words of a key
    phrase are present)."""
    phrases = list(_phrases(notices, base))
    lexicon = sorted({w for _, words, _, _, _ in phrases for w in words})
    complete = F.lit(False)
    for key in sorted({tuple(sorted(set(key))) for _, _, _, key, _ in phrases}):
        complete = complete | (F.size(F.array_except(_strings(key), "_present")) == 0)
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(_WORD), F.lit(0))
    return (
        docs.select(F.col(id_col).alias("doc_id"), words.alias("_words"))
        .withColumn("_present", F.array_distinct(F.filter("_words", lambda w: w.isin(lexicon))))
        .select("doc_id", F.size("_words").cast("long").alias("n_words"), "_present", F.when(complete, F.col("_words")).alias("_words"))
    )


def weights(rows: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents and, for each licence word in one, of documents that have it."""
    seen = rows.select(F.explode("_present").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return rows.count(), {r["word"]: r["df"] for r in seen.collect()}


def index(notices, base, total: int, df: dict[str, int]) -> Column:
    """The templates as an array: ``label, is_base, words, idf, whole`` (sum of idf), ``key, first`` (its place in the
    notice) and the entry under which it is looked up: ``anchor`` and its place ``nth``."""
    entries = []
    for label, words, first, key, is_base in _phrases(notices, base):
        idf = [math.log(1 + total / max(df.get(w, 1), 1)) for w in words]
        nth = max(range(first, first + len(key)), key=lambda i: (idf[i], -i))
        entries.append(
            F.struct(
                F.lit(label).alias("label"), F.lit(is_base).alias("is_base"), _strings(words).alias("words"), F.array(*map(F.lit, idf)).alias("idf"),
                F.lit(sum(idf)).alias("whole"), _strings(key).alias("key"), F.lit(first).alias("first"), F.lit(words[nth]).alias("anchor"), F.lit(nth).alias("nth"),
            )
        )
    return F.array(*entries)


def places(templates: Column) -> Column:
    """Verified places in ``_words``: an array of ``label, is_base, place, share`` (of the template's idf that is there)."""
    def there(place: Column, template: Column) -> Column:
        matched = F.zip_with(
            F.transform(template["words"], lambda w, j: F.get("_words", place + j) == w), template["idf"], lambda same, idf: F.when(same, idf).otherwise(0.0)
        )
        return F.aggregate(matched, F.lit(0.0), lambda sum_, x: sum_ + x) / template["whole"]

    def of_template(template: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda p: F.get("_words", p) == template["anchor"])
        begun = F.transform(at, lambda p: p - template["nth"])
        stands = lambda place: F.forall(
            F.transform(template["key"], lambda w, j: F.coalesce(F.get("_words", place + template["first"] + j) == w, F.lit(False))), lambda same: same
        )
        return F.transform(
            F.filter(begun, stands),
            lambda place: F.struct(template["label"].alias("label"), template["is_base"].alias("is_base"), place.alias("place"), there(place, template).alias("share")),
        )

    complete = F.filter(templates, lambda t: F.size(F.array_except(t["key"], F.col("_present"))) == 0)
    return F.when(F.col("_words").isNotNull(), F.flatten(F.transform(complete, of_template)))


def scan(docs: DataFrame, notices=NOTICES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of base phrases, overlapping ones included; ``first_word`` and ``last_word`` are the
    smallest and largest start, null without one. ``score`` is the best share of a verified template, by
    weight; 0 without one. A null text counts as empty. Rows that repeat or lack an identifier are
    scanned one by one. An empty table gives an empty result.
    """
    rows = written(tokenized(docs, notices, base, id_col, text_col))
    found = rows.withColumn("_found", places(index(notices, base, *weights(rows)))).select(
        "doc_id", "n_words", "_found", F.filter("_found", lambda x: x["is_base"]).alias("_base")
    )
    labels = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ","), F.lit(""))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.greatest(F.size("_base"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("_base.place").cast("long").alias("first_word"),
        F.array_max("_base.place").cast("long").alias("last_word"),
        labels("_base").alias("base_labels"),
        labels("_found").alias("labels"),
        F.coalesce(F.round(F.array_max("_found.share"), 6), F.lit(0.0)).alias("score"),
    )
