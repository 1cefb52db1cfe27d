"""Team form, opponent-adjusted expectation and outcome of every game."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.functions.expr import (
    OPPONENT_WEIGHT,
    OWN_WEIGHT,
    POINTS_MODEL,
    POINTS_PER_KICK,
    bucket_points,
    linear_score_sql,
    over_line_sql,
    ratio_sql,
)
from formbook.operators.durable import written
from formbook.operators.plays import ROLE_MEASURES, attempts, role_rows
from formbook.operators.relational import numeric_columns, stack_tables
from formbook.operators.rolling import games_by_team, trailing_sums
from formbook.operators.sides import AWAY, HOME, schedule_sides, sides_to_games, stack_sides
from formbook.plans.comparables import add_comparables_to_games
from formbook.sources.schema import KICK_COUNTS
from formbook.sources.sinks import write_games
from formbook.sources.tables import FormTables, in_seasons


@dataclass(frozen=True)
class FormSettings:
    """Seasons (all when empty), target weeks with both ends included, window length in weeks.

    ``every_numeric`` sums every numeric column of the weekly table over the window, not only the five kick counts, and
    carries them into the wide data set.
    """

    seasons: tuple[int, ...] = ()
    min_week: int = 7
    max_week: int = 20
    window_weeks: int = 6
    adjusted_down: int = 4
    every_numeric: bool = False

    def between(self, first_season: int, last_season: int) -> FormSettings:
        return replace(self, seasons=tuple(range(first_season, last_season + 1)))


GAME_KEYS = ("game_id", "season", "week", "roof", "home_team", "away_team")
TRAILING = (
    "games",
    *KICK_COUNTS,
    "allowed_att_any",
    "own_att",
    "own_made",
    "allowed_att",
    "allowed_made",
)
OUTCOMES = ("actual_fg_att", "actual_fg_made", "actual_pat_made", "points")
METRICS = (
    "att_rate",
    "proj_att",
    "own_rate",
    "allowed_rate",
    "opp_any_rate",
    "opp_allowed_rate",
    "exp_att",
    "adj_exp_att",
    "xppg",
    "kick_pct",
    "exp_points",
    "regress_points",
    "cash",
)

# Column names of the wide data set as its users know them, by
# our name; {s} stands for home or away.
DOTTED_NAMES = {
    "{s}_fg_att": "{s}.fg_att",
    "{s}_fg_made": "{s}.fg_made",
    "{s}_fg_missed": "{s}.fg_missed",
    "{s}_pat_att": "{s}.pat_att",
    "{s}_pat_made": "{s}.pat_made",
    "{s}_games": "{s}gamesplayed",
    "{s}_own_att": "{s}.adjfield_goal_attempt",
    "{s}_own_made": "{s}.adjfield_goal_result",
    "{s}_allowed_att": "{s}.adjoppfield_goal_attempt",
    "{s}_allowed_made": "{s}.adjoppfield_goal_result",
    "{s}_own_rate": "adj{s}.attpg",
    "{s}_exp_att": "{s}expatt",
    "{s}_adj_exp_att": "adj{s}expatt",
    "{s}_xppg": "{s}xppg",
    "{s}_kick_pct": "{s}kick_pct",
    "{s}_exp_points": "{s}exfppg",
    "{s}_regress_points": "{s}regressfp",
    "{s}_points": "{s}fppg",
    "{s}_cash": "{s}cash",
    "{s}_actual_fg_att": "actual{s}.fg_att",
    "{s}_actual_fg_made": "actual{s}.fg_made",
    "{s}_actual_pat_made": "actual{s}.pat_made",
    "{s}_historical_points": "{s}historicalfantasy",
    "{s}_att_rate": "{s}.attpg",
    "{s}_proj_att": "{s}.projfga",
}
_ONE_SIDE_NAMES = {
    "home_allowed_rate": "adjhome.attpgagainst",
    "away_allowed_rate": "adjaway.attpgallowed",
}


# Numbers in a weekly table that name a row and are no measure.
_NAMES = ("season", "week", "team", "player_id", "game_id")


def kick_measures(tables: FormTables, settings: FormSettings) -> tuple[str, ...]:
    """The weekly columns that are summed over the window."""
    more = numeric_columns(tables.weekly, exclude=(*_NAMES, *KICK_COUNTS)) if settings.every_numeric else []
    return (*KICK_COUNTS, *more)


def _trailing(tables: FormTables, settings: FormSettings) -> tuple[str, ...]:
    return (*TRAILING, *kick_measures(tables, settings)[len(KICK_COUNTS) :])


def team_week_facts(tables: FormTables, settings: FormSettings) -> DataFrame:
    """Games, kicks, attempts and points of each team in each week.

    The three sources are stacked and summed once. Partial sums are built
    before the shuffle, so a team with a third of all plays sends one row per
    task, and after it a team has at most one row per week.
    """
    weekly = tables.weekly
    kicks = weekly.filter("team IS NOT NULL").select(
        "season",
        "week",
        "team",
        *[F.expr(f"coalesce({c}, 0) AS {c}") for c in kick_measures(tables, settings)],
        bucket_points(weekly.columns).alias("points"),
    )
    fourth = f"down = {int(settings.adjusted_down)}"
    tries = role_rows(attempts(tables.plays)).selectExpr(
        "season",
        "week",
        "team",
        "allowed_att AS allowed_att_any",
        *[f"CASE WHEN {fourth} THEN {c} END AS {c}" for c in ROLE_MEASURES],
    )
    sides = schedule_sides(tables.schedule, ("season", "week")).filter("team IS NOT NULL")
    fixtures = sides.selectExpr("season", "week", "team", "1L AS games")
    stacked = stack_tables([fixtures, kicks, tries]).filter(f"week <= {int(settings.max_week)}")
    summed = (*_trailing(tables, settings), "points")
    return stacked.groupBy("season", "week", "team").agg(*[F.expr(f"sum({c}) AS {c}") for c in summed])


def _measures(facts: DataFrame) -> tuple[str, ...]:
    """What is summed over the window: all columns of the facts but their keys and the points."""
    return tuple(c for c in facts.columns if c not in ("season", "week", "team", "points"))


def team_week_features(facts: DataFrame, settings: FormSettings) -> DataFrame:
    """Trailing totals next to the week's own outcome, for weeks the team plays."""
    outcomes = facts.selectExpr("*", *[f"{c} AS actual_{c}" for c in ("fg_att", "fg_made", "pat_made")])
    # A team that plays in the target week has a row there through its fixture.
    return trailing_sums(outcomes, _measures(facts), settings.window_weeks).filter(f"week >= {int(settings.min_week)}")


def _side_metrics(side: str, other: str) -> list[list[str]]:
    """SQL of one side's metrics, in three steps that each use the one before."""
    s, o = f"{side}_", f"{other}_"
    rates = {
        "att_rate": ratio_sql(f"{s}fg_att", f"{s}games"),
        "opp_any_rate": ratio_sql(f"{o}allowed_att_any", f"{o}games"),
        "own_rate": ratio_sql(f"{s}own_att", f"{s}games"),
        "allowed_rate": ratio_sql(f"{s}allowed_att", f"{s}games"),
        "opp_allowed_rate": ratio_sql(f"{o}allowed_att", f"{o}games"),
        "xppg": ratio_sql(f"{s}pat_made", f"{s}games"),
        "kick_pct": ratio_sql(f"{s}fg_made", f"({s}fg_made + {s}fg_missed)"),
        "cash": over_line_sql(f"{s}actual_fg_made"),
    }
    blends = {
        "proj_att": f"({s}opp_any_rate + {s}att_rate) / 2",
        "exp_att": f"({s}own_rate + {s}opp_allowed_rate) / 2",
        "adj_exp_att": f"{OWN_WEIGHT}D * {s}own_rate + {OPPONENT_WEIGHT}D * {s}opp_allowed_rate",
    }
    points = {
        "exp_points": f"{s}exp_att * {POINTS_PER_KICK}D * {s}kick_pct + {s}xppg",
        "regress_points": linear_score_sql(
            POINTS_MODEL, {c: f"{s}{c}" for c in ("xppg", "adj_exp_att", "kick_pct")}
        ),
    }
    return [[f"{sql} AS {s}{name}" for name, sql in step.items()] for step in (rates, blends, points)]


def build_games(tables: FormTables, settings: FormSettings = FormSettings()) -> DataFrame:
    """One wide row per game of the target weeks."""
    if settings.seasons:
        tables = tables.for_seasons(settings.seasons)
    target = tables.schedule.filter(F.col("week").between(settings.min_week, settings.max_week))
    return games_of(target, team_week_facts(tables, settings), settings)


def games_of(target: DataFrame, facts: DataFrame, settings: FormSettings) -> DataFrame:
    """One wide row per game of ``target`` from the facts of its weeks and of those its windows reach."""
    sides = schedule_sides(target, ("game_id", "season", "week", "roof"))
    # The opponent's figures arrive through the regrouping by game, so features
    # are computed and joined once, not once per role.
    joined = sides.join(team_week_features(facts, settings), ["season", "week", "team"], "left").selectExpr(
        "*",
        f"CASE WHEN side = '{HOME}' THEN team ELSE opp END AS home_team",
        f"CASE WHEN side = '{AWAY}' THEN team ELSE opp END AS away_team",
    )
    games = sides_to_games(joined, GAME_KEYS, (*_measures(facts), *OUTCOMES)).fillna(0, ["home_points", "away_points"])
    for home, away in zip(_side_metrics(HOME, AWAY), _side_metrics(AWAY, HOME)):
        games = games.selectExpr("*", *home, *away)
    return games


def game_sides(games: DataFrame) -> DataFrame:
    """One row per side with team, opponent, form, expectation and outcome, and whatever else both sides of the games have."""
    known = ["team", *TRAILING, *OUTCOMES, *METRICS]
    found = [c.removeprefix("home_") for c in games.columns if c.startswith("home_")]
    values = [*known, *[c for c in found if c not in known]]
    pairs = {v: (f"home_{v}", f"away_{v}") for v in values}
    return stack_sides(
        games, ["game_id", "season", "week", "roof"], {**pairs, "opp": ("away_team", "home_team")}
    )


def with_dotted_names(games: DataFrame) -> DataFrame:
    """The wide data set under its customary dotted names (backticks needed in Spark), with each side's opponent, what the
    opponent allowed and how often it played."""
    for side, other in ((HOME, AWAY), (AWAY, HOME)):
        games = games.withColumns(
            {
                f"{side}.oppteam": F.col(f"{other}_team"),
                f"{side}.oppfga": F.col(f"{other}_allowed_att_any"),
                f"{side}.OG": F.col(f"{other}_games"),
                f"{side}.oppfgapg": F.col(f"{side}_opp_any_rate"),
            }
        )
    names = {k.format(s=s): v.format(s=s) for s in (HOME, AWAY) for k, v in DOTTED_NAMES.items()}
    return games.withColumnsRenamed({**names, **_ONE_SIDE_NAMES})


def run(
    tables: FormTables,
    path: str,
    settings: FormSettings = FormSettings(),
    dotted: bool = False,
    comparables: bool | str = False,
) -> str:
    """Build the wide data set and write it as Parquet, one folder per season.

    ``comparables`` adds what sides with a similar expectation scored: in any week (``True`` or ``"all"``), or in
    earlier weeks only (``"past"``), so that nothing leaks from the future.
    """
    games = build_games(tables.with_modern_codes(), settings)
    if comparables:
        games = written(games)
        games = add_comparables_to_games(games, game_sides(games), as_of="all" if comparables is True else comparables)
    return write_games(with_dotted_names(games) if dotted else games, path)


__all__ = [
    "FormSettings",
    "build_games",
    "game_sides",
    "games_by_team",
    "games_of",
    "in_seasons",
    "run",
    "team_week_facts",
    "team_week_features",
    "with_dotted_names",
]
