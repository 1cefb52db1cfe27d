"""What sides with a similar expectation scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.bands import HIGHEST, Band, around, band_totals
from formbook.operators.boards import board_totals
from formbook.operators.durable import written

POINTS_BAND = 0.05


_PERIOD = "season * 100 + week"


def comparable_points(
    history: DataFrame, probes: DataFrame | None = None, spread: float = POINTS_BAND, as_of: str = "all"
) -> DataFrame:
    """Mean points of the history rows near each (exp_points, kick_pct).

    ``as_of='all'`` compares with every row, the probe's own included.
    ``'past'`` compares with earlier weeks only, so nothing leaks from the future;
    the result is then per (season, week, exp_points, kick_pct). ``probes`` other than the history itself are taken for a
    board, of which there are few.
    """
    totals = band_totals if probes is None or as_of == "past" else board_totals
    probes = history if probes is None else probes
    key = ["exp_points", "kick_pct"]
    bands = [around("kick_pct", "kick_pct", spread), around("exp_points", "exp_points", spread)]
    if as_of == "past":
        history = history.selectExpr("*", f"{_PERIOD} AS _period")
        key = ["season", "week", *key]
        bands = [Band("_period", f"-{HIGHEST}D", f"{_PERIOD} - 1"), *bands]
    elif as_of != "all":
        raise ValueError("as_of is 'all' or 'past'")
    found = totals(history, probes, key, bands, ["points"])
    return found.select(*key, (F.col("points") / F.col("n")).alias("historical_points"), F.col("n").alias("comparables"))


def add_comparables(
    sides: DataFrame, history: DataFrame | None = None, spread: float = POINTS_BAND, as_of: str = "all"
) -> DataFrame:
    """Sides with ``historical_points``; NULL where no history row is near.

    ``sides`` and ``history`` are read several times: pass written tables.
    """
    history = sides if history is None else history
    found = comparable_points(history, None if history is sides else sides, spread, as_of).drop("comparables")
    key = [c for c in found.columns if c != "historical_points"]
    return sides.join(found, on=key, how="left")


def add_comparables_to_games(games: DataFrame, history: DataFrame, spread: float = POINTS_BAND, as_of: str = "all") -> DataFrame:
    """Wide games with ``home_`` and ``away_historical_points``.

    ``history`` holds the sides; the answers per (exp_points, kick_pct), with ``as_of='past'`` per week as well, are worked out
    once and written, then looked up for either side.
    """
    found = written(comparable_points(history, spread=spread, as_of=as_of).drop("comparables"))
    shared = [c for c in ("season", "week") if c in found.columns]
    for side in ("home", "away"):
        mine = found.withColumnsRenamed({c: f"{side}_{c}" for c in found.columns if c not in shared})
        games = games.join(mine, [*shared, f"{side}_exp_points", f"{side}_kick_pct"], "left")
    return games
