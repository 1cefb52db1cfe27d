"""Trailing totals over integer periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.relational import group_sums
from formbook.operators.sides import schedule_sides


def trailing_sums(
    df: DataFrame,
    measures: Sequence[str],
    width: int,
    entity: str = "team",
    season: str = "season",
    period: str = "week",
    suffix: str = "",
) -> DataFrame:
    """Totals of the ``width`` periods before each row's own, restarting every season.

    ``df`` holds at most one row per (season, period, entity), so a window
    partition never exceeds the number of periods of a season however many raw
    events an entity has. The frame is by period value, not by row: gaps stay gaps. An
    empty frame gives NULL.
    """
    frame = f"PARTITION BY {season}, {entity} ORDER BY {period} RANGE BETWEEN {int(width)} PRECEDING AND 1 PRECEDING"
    kept = [c for c in df.columns if suffix or c not in measures]
    return df.selectExpr(*kept, *[f"sum({m}) OVER ({frame}) AS {m}{suffix}" for m in measures])


def period_spine(
    df: DataFrame, first: int, last: int, entity: str = "team", season: str = "season", period: str = "week"
) -> DataFrame:
    """Every target period for every entity seen in a season (a bye still gets its row)."""
    return (
        df.select(season, entity)
        .dropna()
        .distinct()
        .select(season, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(period), entity)
    )


def _row_struct(period: str, asked: str, values: Mapping[str, str]) -> str:
    """SQL of one row for the trailing window: its period, whether it is asked for, and its measures."""
    fields = {"_period": period, "_asked": asked, **values}
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def trailing_on_spine(
    facts: DataFrame,
    measures: Sequence[str],
    width: int,
    first: int,
    last: int,
    keep_empty: bool = False,
    entity: str = "team",
    season: str = "season",
    period: str = "week",
) -> DataFrame:
    """Trailing totals for each target period of each entity, byes included.

    Facts are summed to one row per period first and dealt by (season, entity); there the first row of an entity
    brings the entity's target periods along. Targets are never shuffled or aggregated: made from the few (season, entity)
    pairs before a shuffle, all of them would come from one task. An entity or a season that is NULL has no
    targets but the periods it has facts in.
    """
    keys = [season, period, entity]
    if not keep_empty:  # what has facts in later periods only has nothing in any window
        facts = facts.filter(F.col(period) <= last)
    dense = facts.groupBy(*keys).agg(*[F.expr(f"sum({m}) AS {m}") for m in measures])
    types = {f.name: f.dataType.simpleString() for f in dense.schema}
    known = f"{season} IS NOT NULL AND {entity} IS NOT NULL"
    within = f"coalesce({period} BETWEEN {int(first)} AND {int(last)}, false)"
    own = _row_struct(period, f"NOT ({known}) AND {within}", {m: m for m in measures})
    target = _row_struct(f"CAST(_p AS {types[period]})", "true", {m: f"CAST(NULL AS {types[m]})" for m in measures})
    targets = f"transform(sequence({int(first)}, {int(last)}), _p -> {target})"
    rows = dense.selectExpr(
        "*", f"{known} AND row_number() OVER (PARTITION BY {season}, {entity} ORDER BY {period}) = 1 AS _leads"
    ).selectExpr(season, entity, f"inline(IF(_leads, concat(array({own}), {targets}), array({own})))")
    rows = rows.withColumnRenamed("_period", period)
    rolled = trailing_sums(rows, measures, width, entity, season, period).filter("_asked")
    if not keep_empty:
        rolled = rolled.dropna(how="all", subset=list(measures))
    return rolled.select(*keys, *measures)


def games_by_team(schedule: DataFrame, keys: Sequence[str] = ("season", "week")) -> DataFrame:
    """Games of each team per period, home and away counted together."""
    sides = schedule_sides(schedule, keys).filter(F.col("team").isNotNull())
    return sides.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("games"))


def home_away_games(schedule: DataFrame, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Home and away frequencies side by side, 0 where a team has none of one kind.

    Counting the stacked sides conditionally gives what an outer join of two
    frequency tables gives, with one shuffle instead of three.
    """
    sides = schedule_sides(schedule, keys).filter(F.col("team").isNotNull())
    return (
        sides.groupBy(*keys, "team")
        .agg(F.count_if(F.col("side") == "home").alias("home_games"), F.count_if(F.col("side") == "away").alias("away_games"))
        .withColumn("games", F.col("home_games") + F.col("away_games"))
    )


def rolling_games(schedule: DataFrame, width: int, first: int, last: int) -> DataFrame:
    """Games played in the trailing window, for every team and target week."""
    return trailing_on_spine(games_by_team(schedule), ["games"], width, first, last)


def team_week_kicking(weekly: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Player rows summed to one row per team and week."""
    return group_sums(weekly, ["season", "week", "team"], measures)
