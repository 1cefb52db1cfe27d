"""Team codes that changed over the years."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class CodeRule:
    """``modern`` was called ``historical`` before ``season``."""

    modern: str
    historical: str
    season: int


# Franchise moves and the season each one is applied from.
DEFAULT_RULES = (
    CodeRule("LAC", "SD", 2016),
    CodeRule("LA", "STL", 2017),
    CodeRule("LV", "OAK", 2020),
)


def _as_column(season: Column | str | int) -> Column:
    if isinstance(season, Column):
        return season
    return F.col(season) if isinstance(season, str) else F.lit(season)


def _replace(code: Column, cases: Sequence[tuple[Column, str]]) -> Column:
    if not cases:
        return code
    chain = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, target in cases[1:]:
        chain = chain.when(condition, F.lit(target))
    return chain.otherwise(code)


def historical_code(
    code: str, season: Column | str | int = "season", rules: Sequence[CodeRule] = DEFAULT_RULES
) -> Column:
    """Name in use at the time; applied strictly before the rule's season, whole value only."""
    when = _as_column(season)
    value = F.col(code)
    return _replace(value, [((value == r.modern) & (when < r.season), r.historical) for r in rules])


def modern_code(
    code: str, season: Column | str | int = "season", rules: Sequence[CodeRule] = DEFAULT_RULES
) -> Column:
    """Name in use today; applied strictly after the rule's season, whole value only."""
    when = _as_column(season)
    value = F.col(code)
    return _replace(value, [((value == r.historical) & (when > r.season), r.modern) for r in rules])


def normalize_codes(
    df: DataFrame,
    columns: Sequence[str],
    to: str = "modern",
    season: Column | str | int = "season",
    rules: Sequence[CodeRule] = DEFAULT_RULES,
) -> DataFrame:
    """Rewrite code columns in place of a join: the rules fold into the projection.

    Codes are text; a numeric team key has no old name and is left alone.
    """
    builder = {"modern": modern_code, "historical": historical_code}[to]
    text = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns({c: builder(c, season, rules) for c in text}) if text else df
