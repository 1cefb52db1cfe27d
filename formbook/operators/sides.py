"""One row per game <-> one row per side of a game."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOME, AWAY = "home", "away"
SIDES = (HOME, AWAY)


def stack_rows(df: DataFrame, keep: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several rows out of each input row, in one pass over it.

    ``values`` maps an output column to its source in each of the rows: names or SQL
    expressions. The input is read and computed once, which a union of projections would not do. Each column is
    an expression of its own, so Spark drops those that nobody reads, and all that was computed for them alone.
    """
    height = max(len(sources) for sources in values.values())

    def source(sources: Sequence[str]) -> str:
        cases = "".join(f" WHEN _nth = {i} THEN {sources[i]}" for i in range(height - 1))
        return f"CASE{cases} ELSE {sources[height - 1]} END" if cases else sources[0]

    rows = df.withColumn("_nth", F.explode(F.array(*[F.lit(i) for i in range(height)])))
    return rows.selectExpr(*keep, *[f"{source(sources)} AS {name}" for name, sources in values.items()])


def stack_sides(games: DataFrame, keep: Sequence[str], values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Two rows per game; ``values`` maps an output column to its (home, away) sources."""
    return stack_rows(games, keep, {"side": ("'home'", "'away'"), **values})


def schedule_sides(schedule: DataFrame, keep: Sequence[str] = ("game_id", "season", "week", "roof")) -> DataFrame:
    """Fixtures as (team, opp) rows: both orientations of every game."""
    return stack_sides(
        schedule,
        [c for c in keep if c in schedule.columns],
        {"team": ("home_team", "away_team"), "opp": ("away_team", "home_team")},
    )


def distinct_matchups(schedule: DataFrame, keep: Sequence[str] = ("season", "week")) -> DataFrame:
    """Every (team, opp) pairing once, however often the two met in the period."""
    return schedule_sides(schedule, keep).drop("side").distinct()


def sides_to_games(sides: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Back to one row per game with ``home_`` and ``away_`` columns.

    A conditional aggregate: at most two rows meet per game, and both sides'
    features reach each other without a second join.
    """
    picks = [
        F.expr(f"max(CASE WHEN side = '{side}' THEN {v} END) AS {side}_{v}") for side in SIDES for v in values
    ]
    return sides.groupBy(*keys).agg(*picks)


def add_opponent(team_rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach the opponents of the period; teams without a fixture are dropped."""
    matchups = distinct_matchups(schedule).withColumnRenamed("opp", "oppteam")
    return team_rows.join(matchups, on=["season", "week", "team"], how="inner")
