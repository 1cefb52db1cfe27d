"""Week board and over/under threshold reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.expr import ratio_sql, safe_ratio
from formbook.functions.stats import (
    chi2_2df_tail,
    hit_rate,
    hit_rate_doubled,
    jarque_bera_signs,
    jarque_bera_sums,
)
from formbook.operators.bands import around
from formbook.operators.boards import board_totals
from formbook.operators.intervals import Box, count_boxes, moment_boxes

REPORT_BAND = 0.06
THRESHOLD_BAND = 0.03
OUTCOME_COUNTS = ("hits", "misses")


def week_board(sides: DataFrame, season: int, week: int) -> DataFrame:
    """One row per side of a week: what to expect, and what similar sides scored."""
    return sides.filter((F.col("season") == season) & (F.col("week") == week)).select(
        "game_id", "side", "team", "exp_att", "exp_points", "roof", "kick_pct", "historical_points"
    )


def outcome_rows(sides: DataFrame, expectation: str = "adj_exp_att", zero_fill: bool = False) -> DataFrame:
    """Every side as (season, week, exatt, pct, cash), with accuracy over attempts.

    ``zero_fill`` reads every missing value as 0, an unknown outcome included: such
    rows count as observations without profit.
    """
    rows = sides.selectExpr(
        "season", "week", f"{expectation} AS exatt", f"{ratio_sql('fg_made', 'fg_att')} AS pct", "cash"
    )
    return rows.fillna(0, ["exatt", "pct", "cash"]) if zero_fill else rows


def outcome_history(sides: DataFrame, expectation: str = "adj_exp_att", zero_fill: bool = False) -> DataFrame:
    """Decided rows as countable ``hits`` and ``misses``; with ``zero_fill`` all rows."""
    rows = outcome_rows(sides, expectation, zero_fill).dropna(subset=["exatt", "cash"])
    return rows.selectExpr("exatt", "pct", "IF(cash = 1, 1, 0) AS hits", "IF(cash = -1, 1, 0) AS misses")


def verdict(counts: DataFrame, periods: Column, flag: Column | None = None) -> DataFrame:
    """Observations, profit, hit rates, p-value and side from (n, hits, misses).

    Without a given ``flag`` the losing side is turned round: a rate below one
    half reads as "under" with the opposite profit.
    """
    n = F.coalesce("n", F.lit(0))
    hits, misses = (F.coalesce(c, F.lit(0)) for c in OUTCOME_COUNTS)
    profit = hits - misses
    published = hit_rate_doubled(n, profit)
    under = F.coalesce(published < 0.5, F.lit(False)) if flag is None else flag == "u"
    statistic = jarque_bera_signs(n, hits, misses)
    return counts.withColumns(
        {
            "weeks_per_occurrence": F.try_divide(n, periods),
            "o_u": F.when(under, "u").otherwise("o"),
            "p_value": chi2_2df_tail(statistic),
            "observations": n,
            "profit": F.when(under, -profit).otherwise(profit),
            "hit_rate_ref": F.when(under, 1 - published).otherwise(published),
            "hit_rate": F.when(under, hit_rate(misses, hits)).otherwise(hit_rate(hits, misses)),
        }
    ).drop("n", *OUTCOME_COUNTS)


def period_count(sides: DataFrame) -> DataFrame:
    """Number of different (season, week) pairs, as a one-row table."""
    return sides.select("season", "week").distinct().agg(F.count(F.lit(1)).alias("periods"))


def period_scalar(sides: DataFrame) -> Column:
    """The same number as a scalar subquery: one row by construction, whatever the input."""
    return period_count(sides).scalar()


def threshold_report(
    sides: DataFrame,
    board: DataFrame,
    spread: float = REPORT_BAND,
    expectation: str = "adj_exp_att",
    board_expectation: str = "exp_att",
    board_pct: str = "kick_pct",
    zero_fill: bool = False,
) -> DataFrame:
    """How often sides like each board row went over the line.

    The board's expectation and the history's may be different columns; the
    defaults pair the plain blend with the weighted one.
    """
    history = outcome_history(sides, expectation, zero_fill)
    probes = board.select(F.col(board_expectation).alias("threshold"), F.col(board_pct).alias("pct_threshold"))
    bands = [around("pct", "pct_threshold", spread), around("exatt", "threshold", spread)]
    found = board_totals(history, probes, ["threshold", "pct_threshold"], bands, OUTCOME_COUNTS)
    rows = board.select(
        "game_id", "side", "team", F.col(board_expectation).alias("threshold"), F.col(board_pct).alias("pct_threshold")
    ).join(found, ["threshold", "pct_threshold"], "left")
    return verdict(rows, period_scalar(sides))


def published(report: DataFrame) -> DataFrame:
    """A threshold report in the published columns; ``hitrate`` is the published figure."""
    return report.select(
        "threshold",
        F.col("weeks_per_occurrence").alias("weeksperoccurence"),
        "o_u",
        F.col("pct_threshold").alias("kickpctthresh"),
        F.col("p_value").alias("pvalue"),
        F.col("observations").cast("int").alias("observations"),
        "team",
        F.col("profit").cast("int").alias("profit"),
        F.col("hit_rate_ref").alias("hitrate"),
    )


@dataclass(frozen=True)
class Threshold:
    """One try of a threshold analysis: a band around ``exatt``, optional accuracy cuts."""

    exatt: float
    flag: str = "u"
    max_pct: float | None = None
    min_pct: float | None = None


@dataclass(frozen=True)
class Cut:
    """One-sided limits on expectation and accuracy, each optional."""

    flag: str
    min_exatt: float | None = None
    max_exatt: float | None = None
    min_pct: float | None = None
    max_pct: float | None = None


def _literal(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def threshold_sweep(
    sides: DataFrame,
    thresholds: Sequence[Threshold],
    spread: float = THRESHOLD_BAND,
    expectation: str = "exp_att",
    zero_fill: bool = False,
) -> DataFrame:
    """One row per threshold tried, all in the same pass over the sides.

    A side without accuracy counts only where no accuracy cut is asked for."""
    boxes = []
    for t in thresholds:
        labels = {
            "threshold": _literal(t.exatt),
            "o_u": f"'{t.flag}'",
            "min_pct": _literal(t.min_pct),
            "max_pct": _literal(t.max_pct),
        }
        near = (t.exatt * round(1 - spread, 12), t.exatt * round(1 + spread, 12))
        boxes.append(Box(labels, {"exatt": near, "pct": (t.min_pct, t.max_pct)}))
    found = count_boxes(outcome_rows(sides, expectation, zero_fill), boxes, ["season", "week"])
    return verdict(found, F.col("periods"), F.col("o_u")).drop("periods")


def threshold_single(
    sides: DataFrame,
    threshold: float = 1.22,
    flag: str = "u",
    spread: float = THRESHOLD_BAND,
    expectation: str = "exp_att",
    zero_fill: bool = False,
) -> DataFrame:
    """One threshold without an accuracy cut."""
    found = threshold_sweep(sides, [Threshold(threshold, flag)], spread, expectation, zero_fill)
    return found.drop("min_pct", "max_pct")


def cut_report(
    sides: DataFrame, cuts: Sequence[Cut], expectation: str = "exp_att", zero_fill: bool = False
) -> DataFrame:
    """One row per rule of thumb: everything below or above the given limits."""
    boxes = []
    for c in cuts:
        labels = {k: _literal(getattr(c, k)) for k in ("min_exatt", "max_exatt", "min_pct", "max_pct")}
        ends = {"exatt": (c.min_exatt, c.max_exatt), "pct": (c.min_pct, c.max_pct)}
        boxes.append(Box({**labels, "o_u": f"'{c.flag}'"}, ends))
    rows = outcome_rows(sides, expectation, zero_fill)
    # A side without expectation counts as a period only.
    rows = rows.withColumn("cash", F.when(F.col("exatt").isNotNull(), F.col("cash")))
    found = count_boxes(rows, boxes, ["season", "week"])
    return verdict(found, F.col("periods"), F.col("o_u")).drop("periods")


@dataclass(frozen=True)
class PointsTry:
    """One try of the points analysis: a band around ``exp_points`` and an accuracy to exceed."""

    exp_points: float = 10.25
    above_pct: float = 0.95


def points_thresholds(sides: DataFrame, tries: Sequence[PointsTry], spread: float = 0.05) -> DataFrame:
    """Points of sides near an expectation with accuracy above a cut, against everybody's: one row per try, all in the same
    pass over the sides. A try that no side meets has no outcome."""
    boxes = [
        Box(
            {"threshold": _literal(t.exp_points), "pct_threshold": _literal(t.above_pct)},
            {"exp_points": (t.exp_points * round(1 - spread, 12), t.exp_points * round(1 + spread, 12))},
            {"kick_pct": t.above_pct},
        )
        for t in tries
    ]
    found = moment_boxes(sides.select("season", "week", "exp_points", "kick_pct", "points"), boxes, ["season", "week"], "points")
    return found.select(
        "threshold",
        F.try_divide(F.col("n"), F.col("periods")).alias("weeks_per_occurrence"),
        "pct_threshold",
        chi2_2df_tail(jarque_bera_sums(F.col("n"), F.col("m2"), F.col("m3"), F.col("m4"))).alias("p_value"),
        F.col("n").alias("observations"),
        (F.col("mean") - F.col("everybody")).alias("advantage"),
        F.col("mean").alias("outcome"),
    )


def points_threshold(
    sides: DataFrame, threshold: float = 10.25, spread: float = 0.05, min_pct: float = 0.95
) -> DataFrame:
    """One try of it."""
    return points_thresholds(sides, [PointsTry(threshold, min_pct)], spread)


def low_accuracy_cut(sides: DataFrame, max_pct: float = 0.65) -> DataFrame:
    """Profit and hit rate of complete rows at or below an accuracy, and whether outcomes look normal."""
    rows = sides.select(
        "actual_fg_att",
        "xppg",
        "actual_fg_made",
        "cash",
        "fg_att",
        "fg_made",
        "adj_exp_att",
        "games",
        "points",
        # 0/0 counts as missing here: such a side has no accuracy to cut by.
        F.when(F.col("fg_att") > 0, safe_ratio("fg_made", "fg_att")).alias("pct"),
    ).dropna()
    low = rows.filter(F.col("pct") <= max_pct)
    hits, misses = F.count_if(F.col("cash") == 1), F.count_if(F.col("cash") == -1)
    counts = low.agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), misses.alias("misses"))
    profit = F.col("hits") - F.col("misses")
    statistic = jarque_bera_signs(F.col("n"), F.col("hits"), F.col("misses"))
    return counts.select(
        F.lit(float(max_pct)).alias("max_pct"),
        F.col("n").alias("observations"),
        profit.alias("profit"),
        hit_rate_doubled(F.col("n"), profit).alias("hit_rate_ref"),
        hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"),
        statistic.alias("jb"),
        chi2_2df_tail(statistic).alias("p_value"),
    )


__all__ = [
    "Cut",
    "PointsTry",
    "Threshold",
    "cut_report",
    "low_accuracy_cut",
    "outcome_history",
    "outcome_rows",
    "period_count",
    "period_scalar",
    "points_threshold",
    "points_thresholds",
    "published",
    "threshold_report",
    "threshold_single",
    "threshold_sweep",
    "verdict",
    "week_board",
]
