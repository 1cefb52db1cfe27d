"""Attempts and makes by the acting and by the conceding team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.rolling import trailing_on_spine
from formbook.operators.sides import stack_rows

# Fixed value: text of a successful attempt.
SUCCESS = "made"

ROLE_MEASURES = ("own_att", "own_made", "allowed_att", "allowed_made")


def attempts(plays: DataFrame, down: int | None = None) -> DataFrame:
    kicks = plays.filter(F.col("field_goal_attempt") > 0)
    if down is not None:
        kicks = kicks.filter(F.col("down") == down)
    return kicks


def role_rows(plays: DataFrame) -> DataFrame:
    """Each attempt twice: once for the offence, once for the defence.

    Own and allowed counts are separate columns of one table, so a single
    aggregation by team serves both roles. A row may stand for several attempts with one result:
    ``field_goal_attempt`` says how many.
    """
    tried = "CAST(field_goal_attempt AS BIGINT)"
    made = f"CASE WHEN field_goal_result = '{SUCCESS}' THEN {tried} ELSE 0L END"
    nothing = "CAST(NULL AS BIGINT)"
    return stack_rows(
        plays,
        [c for c in ("season", "week", "down") if c in plays.columns],
        {
            "team": ("posteam", "defteam"),
            "own_att": (tried, nothing),
            "own_made": (made, nothing),
            "allowed_att": (nothing, tried),
            "allowed_made": (nothing, made),
        },
    ).filter("team IS NOT NULL")


def attempts_by_role(plays: DataFrame, down: int | None = None) -> DataFrame:
    """Own and allowed attempts per (season, week, team)."""
    return (
        role_rows(attempts(plays, down))
        .groupBy("season", "week", "team")
        .agg(*[F.sum(m).alias(m) for m in ROLE_MEASURES])
    )


def rolling_allowed(plays: DataFrame, width: int, first: int, last: int, down: int | None = None) -> DataFrame:
    """Own and allowed attempts over the trailing window, for every team and target week."""
    return trailing_on_spine(attempts_by_role(plays, down), list(ROLE_MEASURES), width, first, last)
