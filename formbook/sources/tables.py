"""Readers for weekly, schedule and play tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from formbook.operators.codes import DEFAULT_RULES, CodeRule, normalize_codes
from formbook.sources.schema import KICK_COUNTS, PLAYS, SCHEDULE, WEEKLY, conform, require_columns


@dataclass(frozen=True)
class FormTables:
    """The three inputs of every plan, all seasons stacked, ``season`` a column."""

    weekly: DataFrame
    schedule: DataFrame
    plays: DataFrame

    def for_seasons(self, seasons: Sequence[int] | tuple[int, int] | range) -> FormTables:
        return FormTables(*[in_seasons(t, seasons) for t in (self.weekly, self.schedule, self.plays)])

    def with_modern_codes(
        self, latest_season: int | None = None, rules: Sequence[CodeRule] = DEFAULT_RULES
    ) -> FormTables:
        """One code per team in all three tables, so joins between them cannot miss.

        Codes are those in use in ``latest_season`` (default: after every move).
        """
        if not rules:
            return self
        season = latest_season if latest_season is not None else max(r.season for r in rules) + 1
        return FormTables(
            normalize_codes(self.weekly, ["team"], "modern", season, rules),
            normalize_codes(self.schedule, ["home_team", "away_team"], "modern", season, rules),
            normalize_codes(self.plays, ["posteam", "defteam"], "modern", season, rules),
        )

    def with_historical_codes(self, rules: Sequence[CodeRule] = DEFAULT_RULES) -> FormTables:
        """Every team under the code it had in the row's own season, in all three tables."""
        return FormTables(
            normalize_codes(self.weekly, ["team"], "historical", "season", rules),
            normalize_codes(self.schedule, ["home_team", "away_team"], "historical", "season", rules),
            normalize_codes(self.plays, ["posteam", "defteam"], "historical", "season", rules),
        )


def in_seasons(df: DataFrame, seasons: Sequence[int] | range) -> DataFrame:
    """Keep a list of seasons, or an inclusive range; prunes ``season=`` folders."""
    wanted = sorted({int(s) for s in seasons})
    if not wanted:
        return df
    if wanted == list(range(wanted[0], wanted[-1] + 1)):
        return df.filter(F.col("season").between(wanted[0], wanted[-1]))
    return df.filter(F.col("season").isin(wanted))


def season_range(start: int, end: int) -> range:
    """Both ends included."""
    return range(int(start), int(end) + 1)


def kickers_only(weekly: DataFrame) -> DataFrame:
    """Kicking rows with the team under the name the plans use."""
    if "recent_team" in weekly.columns:
        weekly = weekly.withColumnRenamed("recent_team", "team")
    if "position" in weekly.columns:
        weekly = weekly.filter(F.col("position") == "K")
    return weekly


def single_precision(df: DataFrame) -> DataFrame:
    """Doubles as floats: half the width for wide play tables whose measures need no more."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles}) if doubles else df


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_tables(
    spark: SparkSession,
    weekly: str,
    schedule: str,
    plays: str,
    seasons: Sequence[int] | range = (),
    downcast_plays: bool = False,
) -> FormTables:
    """Three Parquet tables, checked for the columns the plans need and their types; NaN is read as missing.
    Further columns are kept."""
    play_table = conform(require_columns(read_table(spark, plays), PLAYS.fieldNames(), "plays"), PLAYS, "plays")
    kicks = require_columns(kickers_only(read_table(spark, weekly)), ["season", "week", "team", *KICK_COUNTS], "weekly")
    games = require_columns(read_table(spark, schedule), SCHEDULE.fieldNames(), "schedule")
    tables = FormTables(
        conform(kicks, WEEKLY, "weekly"),
        conform(games, SCHEDULE, "schedule"),
        single_precision(play_table) if downcast_plays else play_table,
    )
    return tables.for_seasons(seasons)


__all__ = [
    "FormTables",
    "PLAYS",
    "SCHEDULE",
    "WEEKLY",
    "in_seasons",
    "kickers_only",
    "read_table",
    "read_tables",
    "season_range",
    "single_precision",
]
