"""Secrets, with multipart credentials linked by an interval join.

Strong patterns are reported as found. Others are too weak alone: an account or client identifier, a
bare key-like string, a service address. A scope is a stretch of ``reach`` characters around a
part; a weak part is reported if the scope holds what it lacks: an identifier needs a secret, a secret needs
an identifier or an address, an address needs both.

Parts are found per text and become rows. The interval join asks, for every part, for the nearest
part of each other role that begins before it and the nearest after it. Sorting a document's parts once
answers both with running values, so no pair of parts is ever formed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.llm.common import numbered, utf8

#: The three base patterns, as stated; a match must have as many characters.
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
_KINDS = ("assign", "access", "hex")
#: Weak parts: kind, role, pattern. Group 1 is the part; a word before it that must be there begins the pattern.
_WEAK = (
    ("account", "identifier", re.compile(r"(?i:access[_-]?key[_-]?id|client[_-]?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})")),
    ("key", "secret", re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])([A-Za-z0-9+/]{32,}+={0,2})(?![A-Za-z0-9+/=])")),
    ("endpoint", "endpoint", re.compile(r"((?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._~:/?@%-]+)")),
)
#: The roles of strong parts.
_ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"}
_PART = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("role", T.StringType()), T.StructField("at", T.LongType()), T.StructField("end", T.LongType())]
)
_FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    + [T.StructField("base", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("parts", T.ArrayType(_PART))]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as listed, end) of the base matches, by start. A match that is too short is used up and dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """Strong and weak parts; a weak part inside a strong span is the same thing and left out."""
    starts, ends = [s[0] for s in strong], list(accumulate((s[2] for s in strong), max))
    weak = []
    for kind, role, pattern in _WEAK:
        if kind == "endpoint" and "://" not in text:
            continue
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end(1))  # strong spans that begin before it ends
            if not before or ends[before - 1] <= m.start(1):
                weak.append((kind, role, m.start(1), m.end(1)))
    # Without a weak part there is nothing to link.
    return [(_KINDS[k], _ROLES[_KINDS[k]], start, end) for start, k, end in strong] + weak if weak else []


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@F.pandas_udf(_FOUND)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        strong = base_spans(text)
        base = _written([(_KINDS[k], start, end) for start, k, end in strong])
        counts = [sum(k == kind for _, k, _ in strong) for kind in range(3)]
        rows.append((*counts, base, hashlib.sha256(base.encode()).hexdigest(), _parts(text, strong)))
    return pd.DataFrame(rows, columns=_FOUND.fieldNames())


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts (``_row, kind, role, at, end``) whose scope holds the complementary roles."""
    order = Window.partitionBy("_row").orderBy("at", "end", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def near(role: str) -> Column:
        # The furthest end of what began before, and the nearest begin of what comes after.
        end = F.max(F.when(F.col("role") == role, F.col("end"))).over(before)
        begin = F.min(F.when(F.col("role") == role, F.col("at"))).over(after)
        return F.coalesce(F.col("at") - end <= reach, F.lit(False)) | F.coalesce(begin - F.col("end") <= reach, F.lit(False))

    has = parts.withColumns({f"near_{r}": near(r) for r in ("identifier", "secret", "endpoint")})
    complete = (
        F.when(F.col("role") == "identifier", F.col("near_secret"))
        .when(F.col("role") == "secret", F.col("near_identifier") | F.col("near_endpoint"))
        .otherwise(F.col("near_identifier") & F.col("near_secret"))
    )
    return has.filter(complete & ~F.col("kind").isin(*_KINDS)).select("_row", "kind", "at", "end")


def scan(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind as listed (base kinds
    first), joined by commas. A null text counts as empty and has none. Rows that repeat or lack an identifier are
    scanned one by one. An empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), _scan(utf8(text_col)).alias("_found"))).select(
        "_row", "doc_id", "_found.*"
    )
    parts = rows.select("_row", F.inline("parts"))
    kinds = F.array(*[F.lit(k) for k in (*_KINDS, *(kind for kind, _, _ in _WEAK))])
    span = F.struct(F.col("at"), F.array_position(kinds, F.col("kind")).alias("place"), F.col("kind"), F.col("end"))
    weak = linked(parts, reach).groupBy("_row").agg(F.collect_list(span).alias("_weak"))
    # Base spans are read back from their text: they stay in any case.
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("at"),
            F.array_position(kinds, F.split_part(s, F.lit(":"), F.lit(1))).alias("place"),
            F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("end"),
        ),
    )
    every = F.array_sort(F.concat(base, F.coalesce("_weak", F.filter(base, lambda s: F.lit(False)))))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["at"], s["end"])), ",")
    return rows.join(weak, "_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans")
    )
