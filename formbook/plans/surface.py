"""SQL over the tables of a plan: views by their customary names, and the rules as SQL functions.

Functions are SQL expressions that Spark puts in place of a call, so a report written as a string has the plan of one written
in DataFrames. Both live as long as the session; registering again replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formbook.functions.expr import BUCKET_POINTS, over_line_sql, ratio_sql
from formbook.operators.rolling import games_by_team
from formbook.operators.sides import schedule_sides
from formbook.plans.form import game_sides
from formbook.sources.tables import FormTables


def register_functions(spark: SparkSession) -> None:
    """``safe_ratio(a, b)``, ``over_line(made)`` and ``kick_points(...)``, the points of made kicks by bucket and extra points."""
    buckets = ", ".join(f"{name} BIGINT" for name in BUCKET_POINTS)
    worth = " + ".join(f"coalesce({name}, 0) * {points}" for name, points in BUCKET_POINTS.items())
    for signature, kind, body in (
        ("safe_ratio(numerator DOUBLE, denominator DOUBLE)", "DOUBLE", ratio_sql("numerator", "denominator")),
        ("over_line(made DOUBLE)", "INT", over_line_sql("made")),
        (f"kick_points({buckets}, pat_made BIGINT)", "BIGINT", f"CAST({worth} + coalesce(pat_made, 0) AS BIGINT)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")


def register_views(tables: FormTables, games: DataFrame | None = None) -> None:
    """``weekly, schedule, plays``, ``schedule_sides`` (a row per side), ``gamesplayed`` (games of a team in a season) and,
    given the wide ``games``, ``games`` and ``sides``."""
    views = {
        "weekly": tables.weekly,
        "schedule": tables.schedule,
        "plays": tables.plays,
        "schedule_sides": schedule_sides(tables.schedule),
        "gamesplayed": games_by_team(tables.schedule, ("season",)),
    }
    if games is not None:
        views |= {"games": games, "sides": game_sides(games)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
