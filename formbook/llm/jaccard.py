"""Near duplicates by the Jaccard similarity of shingle sets: SimHash and MinHash propose, whole sets decide.

A text has a 64-bit SimHash of its shingle set and a few bands, each the digest of some minima of the set under random
orders. Candidates come from two places. Fingerprints a few bits apart are found by the Gray-order index of
``simhash``; this folds copies and slight variants. Texts farther apart, as most with a similarity of
0.8 are (about 10 of 64 bits), meet in a band: two such texts share one of 24 bands of 6 minima in 9,993 of 10,000 cases. Candidates
whose sizes cannot be similar, or whose fingerprints differ in more than 20 bits (3.7 deviations beyond the mean at
0.8), go. The sets of the others are compared, so no link is made on a sketch's word.

Only components are wanted. So the texts of a band are first paired with two of them, and only then, between
components, with each other: a group of variants never meets pair by pair, and no group is ever collected.

Texts of one template that are less than similar stay in components of their own, and a band may have many. What is left of them is
held against a bound that no link fails: a text's parities say for 512 parts of the hashes whether its set has an odd number there, and
the parities of two sets differ in no more places than the sets have shingles that the other lacks. So of such texts the pairs near
the wanted similarity alone are brought together; the others cost a comparison of eight numbers inside the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import join_small, numbered, small_batches, utf8, without_rows
from formbook.llm.simhash import components, near_links
from formbook.operators.durable import scratch, written

_SEED, _BANDS, _MINIMA, _APART, _CLOSE = 42, 24, 6, 20, 3
_PARITIES = 512
_FEW = 1_000_000  # rows of two numbers that are sent to all executors
_ODD = np.random.default_rng(_SEED).integers(0, 1 << 63, _BANDS * _MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Distinct hashes, rising, of the ``width``-word shingles with A-Z lower-cased; a shorter text is one shingle."""
    words = raw.lower().split()
    text, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words] or [1])
    starts, stops = np.concatenate(([0], ends[:-1]))[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(text[a:b], _SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The SimHash of a set and its bands, all as signed 64-bit numbers."""
    ones, least = np.zeros(64, dtype=np.int64), np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):  # very large sets go in pieces
        part = hashes[at : at + (1 << 12)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part[:, None] * _ODD).min(axis=0))
    fp = ((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)
    bands = [xxhash.xxh64_intdigest(least[i : i + _MINIMA].tobytes(), i) for i in range(0, len(least), _MINIMA)]
    return int(fp.view(np.int64)), np.array(bands, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each part of the hashes, by their upper bits, whether the set has an odd number there, as signed 64-bit numbers."""
    part = hashes >> np.uint64(64 - (_PARITIES - 1).bit_length())
    return np.packbits(np.bincount(part.astype(np.int64), minlength=_PARITIES).astype(np.uint8) & 1).view(np.int64)


def _measured(width: int, raw: Column) -> Column:
    @F.pandas_udf("n int, fp long, bands array<long>, odd array<long>")
    def measure(raws: pd.Series) -> pd.DataFrame:
        found = []
        for raw in raws:
            own = shingles(raw, width)
            found.append((len(own), *sketch(own), parities(own)))
        return pd.DataFrame(found, columns=["n", "fp", "bands", "odd"])

    return measure(raw)


def _may_be_similar(a: str, b: str, least: Fraction) -> Column:
    """Sizes and fingerprints of the texts ``a`` and ``b`` (structs of ``_row, n, fp``) allow a similarity of ``least``."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    sizes = small.cast("long") * least.denominator >= large.cast("long") * least.numerator
    return (F.col(f"{a}._row") != F.col(f"{b}._row")) & sizes & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= _APART)


def _differ_little(a: str, b: str, least: Fraction) -> Column:
    """Parities of the texts ``a`` and ``b`` allow a similarity of ``least``: with x and y shingles, d of them in one set only, it is
    (x + y - d) / (x + y + d)."""
    places = [F.bit_count(F.col(f"{a}_odd")[i].bitwiseXOR(F.col(f"{b}_odd")[i])) for i in range(_PARITIES // 64)]
    d, both = reduce(lambda x, y: x + y, places).cast("long"), F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")
    return d * (least.denominator + least.numerator) <= both * (least.denominator - least.numerator)


def _pair(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(f"{a}._row", f"{b}._row").alias("a"), F.greatest(f"{a}._row", f"{b}._row").alias("b")]


def _linked(texts: DataFrame, pairs: DataFrame, width: int, least: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar. Only texts of candidates travel."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sets of the last few texts: a text meets many others in a row

        def own(row: int, raw: pa.Scalar) -> np.ndarray:
            if row not in known:
                if len(known) >= 256:
                    known.clear()
                known[row] = shingles(raw.as_py(), width)
            return known[row]

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            a, b, near = a.to_numpy(), b.to_numpy(), np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                one, two = own(int(a[i]), x[i]), own(int(b[i]), y[i])
                either = len(np.union1d(one, two))
                near[i] = (len(one) + len(two) - either) * least.denominator >= least.numerator * either
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    pairs = written(pairs.distinct())
    asked = pairs.select(F.col("a").alias("_row")).union(pairs.select(F.col("b").alias("_row"))).distinct()
    known = written(join_small(texts.select("_row", "_raw"), asked, ["_row"], limit=_FEW))
    one, two = (known.select(F.col("_row").alias(k), F.col("_raw").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return written(pairs.join(one, "a").join(two, "b").mapInArrow(compare, "a long, b long"))


def _by_fingerprint(rows: DataFrame, least: Fraction) -> DataFrame:
    """Candidates: texts of one fingerprint with the first of them, and first ones whose fingerprints are close."""
    text = F.struct("_row", "n", "fp")
    firsts = written(rows.groupBy("fp").agg(F.min(text).alias("a"), F.count("*").alias("_copies")))
    equal = rows.select("fp", text.alias("b")).join(firsts.filter("_copies > 1"), "fp").filter(_may_be_similar("a", "b", least)).select(_pair())
    close = near_links(firsts.select("fp"), _CLOSE).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    for side in "ab":
        close = close.join(firsts.select(F.col("fp").alias(f"_{side}"), F.col("a").alias(side)), f"_{side}")
    return equal.union(close.filter(_may_be_similar("a", "b", least)).select(_pair()))


def _met(rows: DataFrame) -> DataFrame:
    """``key, text`` for every band that several texts have."""
    entries = rows.select(F.explode("bands").alias("key"), F.struct("_row", "n", "fp").alias("text"))
    shared = entries.groupBy("key").count().filter("count > 1").select("key")
    return written(join_small(entries, shared, ["key"], limit=_FEW))


def _with_two(met: DataFrame, least: Fraction) -> DataFrame:
    """Candidates: every text of a band with two of that band."""
    stars = met.groupBy("key").agg(F.min("text").alias("first"), F.min_by("text", F.xxhash64("text._row")).alias("other"))
    both = met.join(stars, "key").select(F.col("text").alias("b"), F.explode(F.array("first", "other")).alias("a"))
    return both.filter(_may_be_similar("a", "b", least)).select(_pair())


def _between(met: DataFrame, found: DataFrame, rows: DataFrame, least: Fraction) -> DataFrame:
    """Candidates: texts of a band that are in different components. One side is never of the band's largest component."""
    label = F.coalesce("component", "text._row")
    met = written(met.join(found.withColumnRenamed("fp", "_row"), met["text._row"] == F.col("_row"), "left").select("key", "text", label.alias("label")))
    sizes = met.groupBy("key", "label").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("key", "main")
    met = written(join_small(met, apart, ["key"], limit=_FEW).withColumn("_row", F.col("text._row")))
    odd = join_small(rows.select("_row", "odd"), met.select("_row").distinct(), ["_row"], limit=_FEW)
    met = written(met.join(odd, "_row"))
    rest = met.filter("label <> main").select("key", F.col("text").alias("a"), F.col("label").alias("a_label"), F.col("odd").alias("a_odd"))
    every = met.select("key", F.col("text").alias("b"), F.col("label").alias("b_label"), F.col("odd").alias("b_odd"), "main")
    once = (F.col("b_label") == F.col("main")) | (F.col("a._row") < F.col("b._row"))
    apart = F.col("a_label") != F.col("b_label")
    return rest.join(every, "key").filter(apart & once & _may_be_similar("a", "b", least) & _differ_little("a", "b", least)).select(_pair())


def _classes(rows: DataFrame, texts: DataFrame, width: int, least: Fraction) -> DataFrame:
    """``_row, component_id, kept`` of the rows that have a link; ``rows`` has ``_row, doc_id, n, fp, bands, odd``, ``texts`` ``_row, _raw``."""
    names = rows.select(F.col("_row").alias("fp"), F.col("_row").alias("name"))
    with scratch(rows.sparkSession) as keep:
        met = _met(rows)
        links = _linked(texts, _by_fingerprint(rows, least).union(_with_two(met, least)), width, least)
        more = _linked(texts, _between(met, components(links, names), rows, least), width, least)
        found = components(links.union(more), names).withColumnRenamed("fp", "_row")
        named = written(join_small(rows.select("_row", "doc_id"), found, ["_row"], limit=_FEW))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")).alias("of_all")
        of_all = named.groupBy("component").agg(first)
        return keep(named.join(of_all, "component").select("_row", F.col("of_all.doc_id").alias("component_id"), (F.col("_row") == F.col("of_all._row")).alias("kept")))


def similar(docs: DataFrame, width: int = 5, least: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, component_id, kept``.

    Rows link where the sets of their ``width``-word shingles have a Jaccard similarity of ``least`` (0.8 or more) or more and a sketch
    proposed them; see above for how many it misses. Components, names and the row that is kept are as in
    ``near_duplicates``. A blank text is like any other blank one. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        rows = numbered(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("_raw"), _measured(width, utf8(text_col)).alias("_m"))).select("_row", "doc_id", "_raw", "_m.*")
        found = _classes(rows, rows, width, Fraction(least)).withColumn("_linked", F.lit(True))
    return rows.select("_row", "doc_id").join(found, "_row", "left").select(
        "doc_id", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept")
    )


def without_similar(docs: DataFrame, width: int = 5, least: str = "0.8") -> DataFrame:
    """``docs`` with one row of every component, all columns."""
    def dropped(rows: DataFrame) -> DataFrame:
        texts = rows.select("_row", utf8("_doc.text").alias("_raw"))
        sketches = written(rows.select("_row", "_doc.doc_id", _measured(width, utf8("_doc.text")).alias("_m"))).select("_row", "doc_id", "_m.*")
        return _classes(sketches, texts, width, Fraction(least)).filter("NOT kept")

    with small_batches(docs.sparkSession):
        return without_rows(docs, dropped)
