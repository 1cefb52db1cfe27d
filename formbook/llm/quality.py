"""Quality rules whose cutoffs limit the share of good documents they reject.

Hard rules come first: too few words, or too much of the text in repeated three-word windows.
What passes them is judged by shares (symbols, repeated lines, repeated windows, upper case): a
document goes if a share exceeds its stratum's cutoff. Cutoffs are learned from labels.

Labelled documents are split by identifier. On three quarters, the holdout, cutoffs are
tested from the most lenient on: with n good documents of which k exceed the cutoff, it is
certified if P(Binomial(n, risk) <= k) <= level, which says that the exact upper
confidence limit of the false rejection rate is at most ``risk``. The first failure
ends the row, so a row of tests needs no correction for its length; over rules and strata the
level is divided (Bonferroni). All certified statements hold together with the given confidence,
and as the rules share the risk, so does their union. On the other quarter the certified
cutoff is picked: most bad documents beyond it, with every good one counted against it. A
stratum with too few labels certifies nothing and keeps what the hard rules keep.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.llm.common import join_small, numbered, small_batches, utf8, without_rows
from formbook.operators.durable import written

_NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters".split()
COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in _NAMES])
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS, _UPPER = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Cutoffs from 1 down to 1/1024, four to a factor of two, the lenient first.
CUTOFFS = [2.0 ** (-step / 4) for step in range(41)]
#: A rule's share, by rule.
SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_letters"),
}


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has at least twice."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == len(words):
        return 0
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _counts(raw: bytes) -> tuple[int, ...]:
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    spaces = len(raw) - sum(map(len, words))
    lines = raw.split(b"\n")
    seen, again = set(), 0
    for line in lines if len(lines) > 1 else ():
        if line.strip():
            again += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        len(words), len(raw.decode("utf-8", "replace")) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), again,
        _repeat_words(words), len(lines), upper, upper + len(raw) - len(raw.translate(None, _LOWER)),
    )


@F.pandas_udf(COUNTS)
def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counts(t) for t in texts], columns=_NAMES, dtype="int64")


def base_failed(counts: str = "_counts") -> Column:
    words, again = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < 50) | (100 * again > 50 * words)


def _share(rule: str) -> Column:
    part, whole = (F.col(f"_counts.{c}") for c in SHARES[rule])
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in logarithms."""
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    return float(min(1.0, np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified(good: np.ndarray, risk: float, level: float) -> int:
    """How many cutoffs, from the lenient end, are certified. ``good[j]`` counts the good
    holdout documents that the first ``j`` cutoffs keep and all others reject."""
    n = int(good.sum())
    for step in range(len(CUTOFFS)):
        if _binomial_cdf(int(good[: step + 1].sum()), n, risk) > level:
            return step
    return len(CUTOFFS)


def _choose(found: pd.DataFrame, risk: float, level: float, cost: float, least: float) -> dict[str, float]:
    """The cutoff of each rule for one stratum's counts (rule, holdout, good, bucket, n)."""
    cuts = {}
    for rule in SHARES:
        def histogram(holdout: bool, good: bool) -> np.ndarray:
            at = found[(found["rule"] == rule) & (found["holdout"] == holdout) & (found["good"] == good)]
            return np.bincount(at["bucket"], weights=at["n"], minlength=len(CUTOFFS) + 1)

        steps = certified(histogram(True, True), risk, level)
        gain = np.cumsum(histogram(False, False) - cost * histogram(False, True))[:steps]
        if steps and gain.max() > least * histogram(False, False).sum():
            cuts[rule] = CUTOFFS[int(gain.argmax())]  # the most lenient of equals
    return cuts


def learn_cutoffs(
    counted: DataFrame, labels: DataFrame, risk: float = 0.1, confidence: float = 0.95, cost: float = 20.0,
    least: float = 0.1,
) -> DataFrame:
    """One row per stratum: ``_stratum`` and a cutoff for each rule (null: the rule rejects nothing).

    ``counted`` has ``doc_id, _stratum, _counts``; ``labels`` has ``doc_id, quality`` (1 good, 0 bad; null
    is ignored, of several labels the best counts). A rule is used where it gains more than ``least`` of
    the bad documents, a good one beyond the cutoff counting as ``cost`` lost. Only counts per bucket leave the executors.
    """
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality IS NOT NULL")
    cutoffs = F.array(*[F.lit(c) for c in CUTOFFS])
    values = F.array(*[F.struct(F.lit(r).alias("rule"), _share(r).alias("share")) for r in SHARES])
    counts = (
        counted.filter(~base_failed())
        .join(marks, "doc_id")
        .select(
            "_stratum",
            (F.crc32(F.col("doc_id").cast("string")) % 4 != 0).alias("holdout"),
            (F.col("quality") == 1).alias("good"),
            F.inline(values),
        )
        .withColumn("bucket", F.size(F.filter(cutoffs, lambda c: F.col("share") <= c)))
        .groupBy("_stratum", "rule", "holdout", "good", "bucket")
        .agg(F.count("*").alias("n"))
    )
    strata = max(1, marks.join(counted, "doc_id").agg(F.count_distinct("_stratum")).first()[0])
    level = (1 - confidence) / (strata * len(SHARES))
    schema = "_stratum string, " + ", ".join(f"{r} double" for r in SHARES)

    def choose(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        cuts = _choose(found, risk / len(SHARES), level, cost, least)
        return pd.DataFrame([[key[0], *(cuts.get(r) for r in SHARES)]], columns=["_stratum", *SHARES])

    return counts.groupBy("_stratum").applyInPandas(choose, schema)


def _stratum(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _passes() -> Column:
    """No share exceeds its stratum's cutoff; a missing cutoff rejects nothing."""
    beyond = [F.coalesce(_share(r) > F.col(f"_cut.{r}"), F.lit(False)) for r in SHARES]
    failed = base_failed()
    for one in beyond:
        failed = failed | one
    return ~failed


def _cut(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.select("_stratum", F.struct(*SHARES).alias("_cut"))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options: float) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``.

    A null text counts as empty and fails the hard rules, as every text under 50 words does. Null
    strata form one stratum. Rows that repeat an identifier are judged one by one, and a labelled one counts in the holdout
    as often (the bounds take trials to be independent: repeat no identifier where they must hold); a null
    identifier has no label. Without labels nothing but the hard rules applies.
    """
    counted = numbered(
        docs.select("doc_id", _stratum(stratum_col).alias("_stratum"), text_counts(utf8()).alias("_counts"))
    )
    cuts = _cut(learn_cutoffs(counted, labels, **options))
    return join_small(counted, cuts, ["_stratum"], "left").select(
        "doc_id", *[F.col(f"_counts.{c}").alias(c) for c in _BASE], base_failed().alias("base_failed"), _passes().alias("kept")
    )


def good_documents(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options: float) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns. Texts are counted once: the counts are written, and verdicts are an
    expression over them."""
    def dropped(rows: DataFrame) -> DataFrame:
        counted = written(
            rows.select("_row", "_doc.doc_id", _stratum(f"_doc.{stratum_col}").alias("_stratum"), text_counts(utf8("_doc.text")).alias("_counts"))
        )
        cuts = _cut(learn_cutoffs(counted, labels, **options))
        return join_small(counted, cuts, ["_stratum"], "left").filter(~F.coalesce(_passes(), F.lit(False)))

    with small_batches(docs.sparkSession):
        return without_rows(docs, dropped)
