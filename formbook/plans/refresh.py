"""The data set kept up to date week by week.

Three tables lie in one folder, each in parts of a season and week: what every team did in a week
(``facts``), who plays whom (``schedule``) and the wide ``games``. When a week's rows arrive, or arrive again corrected, its facts and
schedule are replaced, and of the games only those weeks are computed whose window reaches it: the week itself and as many
after it as a window is long. All other parts are neither read nor written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.plans.form import FormSettings, games_of, team_week_facts
from formbook.sources.sinks import replace_parts
from formbook.sources.tables import FormTables

_PARTS = ("season", "week")


@dataclass(frozen=True)
class WeekStore:
    """The folder and the settings its games are computed with."""

    path: str
    settings: FormSettings = FormSettings()

    def _read(self, spark: SparkSession, name: str, season: int, first: int, last: int) -> DataFrame:
        table = spark.read.parquet(f"{self.path}/{name}")
        return table.filter((F.col("season") == season) & F.col("week").between(first, last))

    def games(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/games")

    def add_week(self, tables: FormTables, season: int, week: int) -> list[int]:
        """Take in one week of ``tables`` and return the weeks whose games were computed."""
        spark, s = tables.schedule.sparkSession, self.settings
        this_week = (F.col("season") == season) & (F.col("week") == week)
        rows = FormTables(*[t.filter(this_week) for t in (tables.weekly, tables.schedule, tables.plays)])
        replace_parts(team_week_facts(rows, s), f"{self.path}/facts", _PARTS)
        replace_parts(rows.schedule, f"{self.path}/schedule", _PARTS)
        first, last = max(week, s.min_week), min(week + s.window_weeks, s.max_week)
        if first > last:
            return []
        target = self._read(spark, "schedule", season, first, last)
        facts = self._read(spark, "facts", season, first - s.window_weeks, last)
        replace_parts(games_of(target, facts, s), f"{self.path}/games", _PARTS)
        return sorted(r["week"] for r in target.select("week").distinct().collect())
