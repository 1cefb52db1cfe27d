"""Registered queries: every operator run over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.functions.expr import BUCKET_POINTS, bucket_points, distance_list_points, safe_ratio
from formbook.functions.stats import chi2_2df_tail, jarque_bera, jarque_bera_signs
from formbook.operators import models, quantiles, sketches
from formbook.operators.codes import CodeRule, normalize_codes
from formbook.operators.durable import written
from formbook.operators.plays import rolling_allowed
from formbook.operators.relational import complete_rows, group_sums, numeric_columns, stack_tables
from formbook.operators.rolling import (
    games_by_team,
    home_away_games,
    period_spine,
    rolling_games,
    team_week_kicking,
    trailing_on_spine,
)
from formbook.operators.sides import add_opponent, distinct_matchups, schedule_sides, stack_sides
from formbook.plans import reports, surface
from formbook.plans.comparables import add_comparables, add_comparables_to_games, comparable_points
from formbook.plans.form import FormSettings, build_games, game_sides, kick_measures
from formbook.sources import orders
from formbook.sources.orders import OrderFolder
from formbook.sources.schema import KICK_COUNTS
from formbook.sources.tables import season_range

Query = Callable[[SparkSession, str], DataFrame]

# A season of the order tables has 53 weeks and all of them are targets.
SETTINGS = FormSettings(min_week=7, max_week=53, window_weeks=6)
BOARD_SEASON, BOARD_WEEK = 2000, 20

# The tries of the threshold analysis, and a row of tries a fiftieth apart.
SWEEP = (
    reports.Threshold(1.22),
    reports.Threshold(1.3, max_pct=0.9),
    reports.Threshold(1.5, max_pct=0.65),
    reports.Threshold(0.8, "o", min_pct=0.9),
    reports.Threshold(1.0, "o", max_pct=0.95, min_pct=0.5),
    reports.Threshold(2.6, "o"),
    *(reports.Threshold((2 * step + 1) / 100, "u" if step < 75 else "o") for step in range(30, 130)),
)
CUTS = (
    reports.Cut("u", max_exatt=1.3, max_pct=0.9),
    reports.Cut("o", min_exatt=2.7, min_pct=0.9),
    reports.Cut("o", min_exatt=2.6),
    reports.Cut("u", max_exatt=1.5, max_pct=0.65),
)

_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def games(spark: SparkSession, d: str) -> DataFrame:
    return build_games(orders.tables(OrderFolder.at(spark, d)), SETTINGS)


def sides(spark: SparkSession, d: str) -> DataFrame:
    return game_sides(games(spark, d))


def _accuracy() -> Column:
    """Trailing accuracy over attempts; missing without an attempt."""
    return F.when(F.col("fg_att") > 0, safe_ratio("fg_made", "fg_att"))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scans, projections ---------------------------------------------------------


@_query
def scan_filter_rename(spark: SparkSession, d: str) -> DataFrame:
    return orders.weekly(OrderFolder.at(spark, d)).select("season", "week", "team", "player_id", *KICK_COUNTS)


@_query
def season_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return orders.schedule(OrderFolder.at(spark, d), season_range(1996, 1998))


@_query
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    source = OrderFolder.at(spark, d)
    kicks = orders.weekly(source).select("season", "week", "team", "fg_att")
    fixtures = schedule_sides(orders.schedule(source), ("season", "week")).select(
        "season", "week", "team", F.lit(1).cast("bigint").alias("games")
    )
    return stack_tables([kicks, fixtures])


@_query
def sum_all_numeric(spark: SparkSession, d: str) -> DataFrame:
    weekly = orders.weekly(OrderFolder.at(spark, d))
    measures = numeric_columns(weekly, exclude=("season", "week", "team", "player_id", "game_id"))
    return group_sums(weekly, ["season", "team"], measures)


@_query
def safe_ratio_columns(spark: SparkSession, d: str) -> DataFrame:
    return orders.weekly(OrderFolder.at(spark, d)).select(
        "game_id",
        "team",
        safe_ratio("fg_made", "fg_att").alias("pct"),
        safe_ratio("pat_made", "pat_att").alias("pat_pct"),
    )


def _nation_codes(spark: SparkSession, d: str) -> DataFrame:
    """Orders counted by season and nation before the code is looked up: few rows reach the rules."""
    by_customer = (
        spark.read.parquet(f"{d}/orders.parquet")
        .groupBy(F.year("o_orderdate").alias("season"), F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (
        by_customer.join(customer, "c_custkey")
        .groupBy("season", "c_nationkey")
        .agg(F.sum("orders").alias("orders"))
        .join(nation, "c_nationkey")
        .select("season", F.col("n_name").alias("code"), "orders")
    )


def _recount(df: DataFrame) -> DataFrame:
    return df.groupBy("season", "code").agg(F.sum("orders").alias("orders"))


@_query
def code_normalize_backward(spark: SparkSession, d: str) -> DataFrame:
    rules = (
        CodeRule("NATION_3", "OLD_3", 1997),
        CodeRule("NATION_7", "OLD_7", 1999),
        CodeRule("NATION_11", "OLD_11", 2000),
    )
    return _recount(normalize_codes(_nation_codes(spark, d), ["code"], "historical", "season", rules))


@_query
def code_normalize_forward(spark: SparkSession, d: str) -> DataFrame:
    rules = (
        CodeRule("NEW_3", "NATION_3", 1997),
        CodeRule("NEW_7", "NATION_7", 1999),
        CodeRule("NEW_11", "NATION_11", 2000),
    )
    return _recount(normalize_codes(_nation_codes(spark, d), ["code"], "modern", "season", rules))


@_query
def null_fill(spark: SparkSession, d: str) -> DataFrame:
    return orders.weekly(OrderFolder.at(spark, d)).select("game_id", "team", "fg_made_30_39").fillna(0, ["fg_made_30_39"])


@_query
def cash_indicator(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).select("game_id", "side", "actual_fg_made", "cash")


@_query
def dropna_complete_cases(spark: SparkSession, d: str) -> DataFrame:
    used = ["exp_att", "actual_fg_att", "actual_fg_made", "fg_att", "fg_made", "cash"]
    return complete_rows(sides(spark, d).select("game_id", "side", *used), used)


# --- games, sides, opponents ------------------------------------------------------


@_query
def games_by_team_week(spark: SparkSession, d: str) -> DataFrame:
    return games_by_team(orders.schedule(OrderFolder.at(spark, d)))


@_query
def games_played_outer(spark: SparkSession, d: str) -> DataFrame:
    return home_away_games(orders.schedule(OrderFolder.at(spark, d)))


@_query
def sides_long(spark: SparkSession, d: str) -> DataFrame:
    return schedule_sides(orders.schedule(OrderFolder.at(spark, d)))


@_query
def matchups_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct_matchups(orders.schedule(OrderFolder.at(spark, d)))


@_query
def opponent_lookup(spark: SparkSession, d: str) -> DataFrame:
    source = OrderFolder.at(spark, d)
    return add_opponent(team_week_kicking(orders.weekly(source), ["fg_att"]), orders.schedule(source))


@_query
def team_week_spine(spark: SparkSession, d: str) -> DataFrame:
    fixtures = schedule_sides(orders.schedule(OrderFolder.at(spark, d)), ("season", "week"))
    return period_spine(fixtures, SETTINGS.min_week, SETTINGS.max_week)


def _wide(df: DataFrame, *names: str) -> DataFrame:
    keys = ["game_id", "season", "week", "roof", "home_team", "away_team"]
    return df.select(*keys, *[f"{s}_{n}" for n in names for s in ("home", "away")])


@_query
def side_prefix_wide(spark: SparkSession, d: str) -> DataFrame:
    roles = ("own_att", "own_made", "allowed_att", "allowed_made")
    return _wide(games(spark, d), "games", *KICK_COUNTS, *roles)


@_query
def actual_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _wide(games(spark, d), "actual_fg_att", "actual_fg_made", "actual_pat_made")


# --- trailing windows -----------------------------------------------------------------


@_query
def rolling_games_played(spark: SparkSession, d: str) -> DataFrame:
    s = SETTINGS
    return rolling_games(orders.schedule(OrderFolder.at(spark, d)), s.window_weeks, s.min_week, s.max_week)


@_query
def games_played_calendar(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("game_id", "season", "week", "home_games", "away_games")


@_query
def rolling_form(spark: SparkSession, d: str) -> DataFrame:
    s, source = SETTINGS, OrderFolder.at(spark, d)
    fixtures = games_by_team(orders.schedule(source))
    kicks = orders.weekly(source).select("season", "week", "team", *KICK_COUNTS)
    rolled = trailing_on_spine(
        stack_tables([fixtures, kicks]), ["games", *KICK_COUNTS], s.window_weeks, s.min_week, s.max_week
    )
    return rolled.withColumn("att_rate", safe_ratio("fg_att", "games"))


@_query
def rolling_every_column(spark: SparkSession, d: str) -> DataFrame:
    """Every numeric column of the weekly table over the window, for every team and target week, byes included."""
    s, found = SETTINGS, orders.tables(OrderFolder.at(spark, d))
    measures = list(kick_measures(found, replace(s, every_numeric=True)))
    fixtures = games_by_team(found.schedule)
    kicks = found.weekly.select("season", "week", "team", *measures)
    return trailing_on_spine(stack_tables([fixtures, kicks]), ["games", *measures], s.window_weeks, s.min_week, s.max_week)


@_query
def sides_every_column(spark: SparkSession, d: str) -> DataFrame:
    """The same columns in the data set, for both sides of every game."""
    found = game_sides(build_games(orders.tables(OrderFolder.at(spark, d)), replace(SETTINGS, every_numeric=True)))
    return found.select("game_id", "season", "week", "side", "team", "games", "fg_att", *BUCKET_POINTS, "exp_points")


@_query
def rolling_allowed_any(spark: SparkSession, d: str) -> DataFrame:
    s = SETTINGS
    return rolling_allowed(orders.attempts_by_game(OrderFolder.at(spark, d)), s.window_weeks, s.min_week, s.max_week)


@_query
def rolling_allowed_fourth(spark: SparkSession, d: str) -> DataFrame:
    s = SETTINGS
    return rolling_allowed(orders.attempts_by_game(OrderFolder.at(spark, d)), s.window_weeks, s.min_week, s.max_week, down=4)


@_query
def projected_attempts(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).select(
        "game_id", "season", "week", "side", "team", "opp", "att_rate", "opp_any_rate", "proj_att"
    )


# --- expectations -------------------------------------------------------------------------


@_query
def expected_metrics(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).drop("allowed_att_any", "opp_any_rate", "opp_allowed_rate", "regress_points")


@_query
def regression_score(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).select("game_id", "side", "xppg", "adj_exp_att", "kick_pct", "regress_points")


# --- points -----------------------------------------------------------------------------------


@_query
def points_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    weekly = orders.weekly(OrderFolder.at(spark, d))
    return weekly.select("game_id", "season", "week", "team", bucket_points(weekly.columns).alias("fantasy_points"))


@_query
def points_fallback(spark: SparkSession, d: str) -> DataFrame:
    weekly = orders.weekly(OrderFolder.at(spark, d)).select("game_id", "season", "week", "team", "pat_made", "fg_made")
    return weekly.select("game_id", "season", "week", "team", bucket_points(weekly.columns).alias("fantasy_points"))


@_query
def points_from_list(spark: SparkSession, d: str) -> DataFrame:
    lists = orders.weekly_lists(OrderFolder.at(spark, d))
    points = distance_list_points("fg_made_list") * F.col("times") + F.col("pat_made")
    return lists.groupBy("game_id", "season", "week", "team", "player_id").agg(F.sum(points).alias("fantasy_points"))


@_query
def actual_points(spark: SparkSession, d: str) -> DataFrame:
    weekly = orders.weekly(OrderFolder.at(spark, d))
    rows = weekly.withColumn("fantasy_points", bucket_points(weekly.columns))
    return group_sums(rows, ["season", "week", "team"], ["fantasy_points"])


# --- statistics ---------------------------------------------------------------------------------


def _weekly_quantile(spark: SparkSession, d: str, column: str, p: float) -> DataFrame:
    found = quantiles.group_quantiles(sides(spark, d), column, {"quantile": p}, ["season", "week"])
    return _rounded(found, 6, "quantile").orderBy("season", "week")


@_query
def weekly_quantile_points(spark: SparkSession, d: str) -> DataFrame:
    return _weekly_quantile(spark, d, "exp_points", 0.88)


@_query
def weekly_quantile_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _weekly_quantile(spark, d, "exp_att", 0.95)


@_query
def mean_weekly_quantile(spark: SparkSession, d: str) -> DataFrame:
    both = sides(spark, d).select(
        "season",
        "week",
        F.inline(
            F.array(
                F.struct(F.lit("points").alias("measure"), F.col("exp_points").alias("value")),
                F.struct(F.lit("attempts").alias("measure"), F.col("exp_att").alias("value")),
            )
        ),
    )
    found = quantiles.group_quantiles(both, "value", {"q88": 0.88, "q95": 0.95}, ["season", "week", "measure"])
    return found.agg(
        F.round(F.avg(F.when(F.col("measure") == "points", F.col("q88"))), 6).alias("points_quantile"),
        F.round(F.avg(F.when(F.col("measure") == "attempts", F.col("q95"))), 6).alias("attempts_quantile"),
    )


@_query
def jarque_bera_by_roof(spark: SparkSession, d: str) -> DataFrame:
    n, hits, misses = F.count("cash"), F.count_if(F.col("cash") == 1), F.count_if(F.col("cash") == -1)
    tested = (
        sides(spark, d)
        .groupBy("roof")
        .agg(
            n.alias("n_cash"),
            hits.alias("hits"),
            misses.alias("misses"),
            F.count("points").alias("n_points"),
            jarque_bera("points").alias("jb_points"),
        )
        .withColumn("jb_cash", jarque_bera_signs(F.col("n_cash"), F.col("hits"), F.col("misses")))
    )
    return tested.select(
        "roof",
        "n_cash",
        F.round("jb_cash", 4).alias("jb_cash"),
        F.round(chi2_2df_tail(F.col("jb_cash")), 9).alias("p_cash"),
        "n_points",
        F.round("jb_points", 4).alias("jb_points"),
        F.round(chi2_2df_tail(F.col("jb_points")), 9).alias("p_points"),
    )


@_query
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    measures = {
        "points": F.col("points").cast("double"),
        "exp_points": F.col("exp_points"),
        "pct": safe_ratio("fg_made", "fg_att"),
    }
    melted = sides(spark, d).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()]))
    )
    found = quantiles.five_number_summary(melted, "value", ["measure"])
    return _rounded(found, 6, "q1", "median", "mean", "q3", "sd")


@_query
def roof_levels(spark: SparkSession, d: str) -> DataFrame:
    return orders.schedule(OrderFolder.at(spark, d)).select("roof").distinct()


@_query
def late_season_by_roof(spark: SparkSession, d: str) -> DataFrame:
    late = sides(spark, d).filter(F.col("week") > 14)
    return late.groupBy("roof").agg(F.avg("actual_fg_made").alias("avg_made"))


@_query
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        sides(spark, d)
        .select(
            F.col("actual_fg_att").alias("fgatt"),
            F.col("pat_att").alias("pastpat"),
            F.col("games").alias("g"),
            safe_ratio("pat_att", "games").alias("patpg"),
        )
        .fillna(0)
    )
    return _rounded(models.correlation_matrix(rows, ["fgatt", "pastpat", "g", "patpg"]), 6, "r")


@_query
def correlation_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = sides(spark, d).select(
        F.col("actual_fg_att").alias("fgatt"),
        F.col("actual_pat_made").alias("xpmade"),
        F.col("actual_fg_made").alias("fgmade"),
        "cash",
        F.col("fg_att").alias("pastatt"),
        F.col("fg_made").alias("pastmade"),
        F.col("exp_att").alias("exatt"),
        _accuracy().alias("pct"),
    )
    return _rounded(models.correlation_matrix(complete_rows(rows), rows.columns), 6, "r")


@_query
def eval_mae_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.prediction_errors(sides(spark, d), "points", "regress_points"), 6, "mae", "rmse")


# --- thresholds and comparables -----------------------------------------------------------------


def _report_sides(spark: SparkSession, d: str) -> DataFrame:
    """The columns the reports read, written once: a report passes over them several times."""
    wanted = (
        "game_id season week side team roof exp_att adj_exp_att exp_points kick_pct fg_att fg_made cash points"
    ).split()
    return written(sides(spark, d).select(*wanted))


@_query
def threshold_single(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.threshold_single(sides(spark, d), 1.22, "u", zero_fill=True), 9, "p_value")


@_query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.threshold_sweep(sides(spark, d), SWEEP, zero_fill=True), 9, "p_value")


@_query
def cut_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.cut_report(sides(spark, d), CUTS, zero_fill=True), 9, "p_value")


@_query
def points_by_expectation(spark: SparkSession, d: str) -> DataFrame:
    known = sides(spark, d).filter("exp_points IS NOT NULL")
    rows = known.selectExpr("exp_points > 4D AS above", "CAST(points AS DOUBLE) AS points")
    return _rounded(quantiles.five_number_summary(rows, "points", ["above"]), 6, "q1", "median", "mean", "q3", "sd")


@_query
def points_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = reports.points_threshold(sides(spark, d), threshold=4.0)
    return _rounded(_rounded(found, 6, "advantage", "outcome"), 9, "p_value")


#: Thirty tries: expectations a quarter apart, each with three accuracies to exceed.
POINTS_TRIES = tuple(reports.PointsTry(2.0 + step / 4, above) for step in range(10) for above in (0.5, 0.75, 0.95))


@_query
def points_thresholds(spark: SparkSession, d: str) -> DataFrame:
    found = reports.points_thresholds(sides(spark, d), POINTS_TRIES)
    return _rounded(_rounded(found, 6, "advantage", "outcome"), 9, "p_value")


@_query
def low_accuracy_cut(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(reports.low_accuracy_cut(sides(spark, d)), 6, "jb"), 9, "p_value")


@_query
def historical_comparables(spark: SparkSession, d: str) -> DataFrame:
    used = ("game_id", "season", "week", "side", "team", "exp_points", "kick_pct", "points")
    return add_comparables(_report_sides(spark, d).select(*used))


@_query
def games_with_comparables(spark: SparkSession, d: str) -> DataFrame:
    used = [f"{s}_{c}" for s in ("home", "away") for c in ("exp_points", "kick_pct", "points")]
    wide = written(games(spark, d).select("game_id", *used))
    history = stack_sides(wide, [], {c: (f"home_{c}", f"away_{c}") for c in ("exp_points", "kick_pct", "points")})
    return add_comparables_to_games(wide, history)


@_query
def comparables_past_only(spark: SparkSession, d: str) -> DataFrame:
    return comparable_points(_report_sides(spark, d), as_of="past")


@_query
def week_board(spark: SparkSession, d: str) -> DataFrame:
    history = _report_sides(spark, d)
    week = history.filter((F.col("season") == BOARD_SEASON) & (F.col("week") == BOARD_WEEK))
    return reports.week_board(add_comparables(week, history), BOARD_SEASON, BOARD_WEEK)


@_query
def threshold_report(spark: SparkSession, d: str) -> DataFrame:
    history = _report_sides(spark, d)
    board = history.filter((F.col("season") == BOARD_SEASON) & (F.col("week") == BOARD_WEEK))
    return _rounded(reports.threshold_report(history, board, zero_fill=True), 9, "p_value")


@_query
def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    """The week's report as it is published."""
    return reports.published(threshold_report(spark, d))


@_query
def over_under_flip(spark: SparkSession, d: str) -> DataFrame:
    rows = written(sides(spark, d).select("season", "week", "team", "cash"))
    decided = rows.filter(F.col("cash").isNotNull())
    counts = decided.groupBy("team").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cash") == 1).alias("hits"),
        F.count_if(F.col("cash") == -1).alias("misses"),
    )
    return _rounded(reports.verdict(counts, reports.period_scalar(rows)), 9, "p_value")


# --- regressions -----------------------------------------------------------------------------------


@_query
def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    rows = sides(spark, d).select(
        "points", "exp_att", "actual_fg_att", "actual_fg_made", "fg_att", "fg_made", "cash", _accuracy().alias("pct")
    )
    every = ("exp_att", "actual_fg_att", "actual_fg_made", "fg_att", "fg_made", "cash", "pct")
    wanted = [
        models.Model("points", ("exp_att",)),
        models.Model("actual_fg_att", ("exp_att",), ("points", *every)),
        models.Model("actual_fg_made", ("pct:exp_att",), ("points", *every)),
    ]
    found = models.fit_models(rows, wanted).select(
        "target", F.replace("terms", F.lit(":"), F.lit("*")).alias("regressor"), "n", F.col("weights")[0].alias("slope"), "intercept", "r2"
    )
    return _rounded(found, 6, "slope", "intercept", "r2")


@_query
def ols_by_season(spark: SparkSession, d: str) -> DataFrame:
    """Three models for every season from one pass."""
    rows = sides(spark, d).select("season", "points", "exp_att", F.col("actual_fg_made").alias("made"), _accuracy().alias("pct"), "xppg")
    wanted = [models.Model("points", ("exp_att",)), models.Model("made", ("pct", "exp_att")), models.Model("points", ("pct:exp_att", "xppg"))]
    found = models.fit_models(rows, wanted, ["season"]).select(
        "season", "target", "terms", "n", "r2", "intercept", F.col("weights")[0].alias("first"), F.get("weights", F.lit(1)).alias("second")
    )
    return _rounded(found, 6, "r2", "intercept", "first", "second")


@_query
def ols_two(spark: SparkSession, d: str) -> DataFrame:
    rows = sides(spark, d).select(F.col("actual_fg_made").alias("made"), _accuracy().alias("pct"), "exp_att")
    return models.fit_linear(rows, "made", ["pct", "exp_att"]).table(rows, 6)


@_query
def ols_interaction(spark: SparkSession, d: str) -> DataFrame:
    rows = sides(spark, d).select("points", "xppg", "adj_exp_att", _accuracy().alias("pct"))
    terms = ["xppg", "adj_exp_att", "pct", "adj_exp_att:pct"]
    return models.fit_linear(rows, "points", terms).table(rows, 6)


@_query
def ols_allowed_kicked(spark: SparkSession, d: str) -> DataFrame:
    rows = sides(spark, d).select(
        "actual_fg_att", F.col("opp_allowed_rate").alias("allowed"), F.col("own_rate").alias("kicked")
    )
    return models.fit_linear(rows, "actual_fg_att", ["allowed", "kicked", "allowed:kicked"]).table(rows, 6)


HOME_TERMS = ["adj_exp_att", "kick_pct", "xppg"]


def _home(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("game_id", *[F.col(f"home_{c}").alias(c) for c in (*HOME_TERMS, "points")])


@_query
def ols_points_home(spark: SparkSession, d: str) -> DataFrame:
    rows = _home(spark, d)
    return models.fit_linear(rows, "points", HOME_TERMS, zero_fill=True).table(rows, 6)


@_query
def ols_points_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_home(spark, d))
    fit = models.fit_linear(rows, "points", HOME_TERMS, zero_fill=True)
    return rows.select("game_id", F.round(fit.score(), 6).alias("predicted"))


# --- sketches -----------------------------------------------------------------------------------------


@_query
def approximate_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of every (season, week), stored, merged to seasons; whether each quantile's rank is within three hundredths of
    all rows, against the exact ranks."""
    rows = written(sides(spark, d).select("season", "week", "exp_points"))
    asked = {"q25": 0.25, "q50": 0.5, "q88": 0.88, "q95": 0.95}
    stored = written(sketches.quantile_sketches(rows, "exp_points", ["season", "week"]))
    found = sketches.rank_errors(rows, "exp_points", sketches.merged_quantiles(stored, asked, ["season"]), asked, ["season"])
    return found.select("season", "quantile", "n", (F.col("error") <= 0.03).alias("within"))


# --- SQL text ---------------------------------------------------------------------------------------------


def _surface(spark: SparkSession, d: str) -> None:
    found = orders.tables(OrderFolder.at(spark, d))
    surface.register_functions(spark)
    surface.register_views(found, build_games(found, SETTINGS))


@_query
def sql_attempts_per_game(spark: SparkSession, d: str) -> DataFrame:
    _surface(spark, d)
    return spark.sql(
        """SELECT k.season, k.team, k.fg_att, k.points, g.games, safe_ratio(k.fg_att, g.games) AS attpg
           FROM (SELECT season, team, sum(fg_att) AS fg_att,
                        sum(kick_points(fg_made_0_19, fg_made_20_29, fg_made_30_39, fg_made_40_49, fg_made_50_59,
                                        fg_made_60_, pat_made)) AS points
                 FROM weekly GROUP BY season, team) k
           LEFT JOIN gamesplayed g ON g.season = k.season AND g.team = k.team"""
    )


@_query
def sql_opponents(spark: SparkSession, d: str) -> DataFrame:
    _surface(spark, d)
    return spark.sql(
        """WITH kickers AS (SELECT season, week, team, sum(fg_att) AS fg_att FROM weekly GROUP BY season, week, team)
           SELECT DISTINCT k.*, s.opp AS oppteam FROM kickers k
           JOIN schedule_sides s ON s.season = k.season AND s.week = k.week AND s.team = k.team
           WHERE s.opp IS NOT NULL"""
    )


@_query
def sql_late_season_by_roof(spark: SparkSession, d: str) -> DataFrame:
    _surface(spark, d)
    return spark.sql(
        """SELECT roof, avg(actual_fg_made) AS fgm, count_if(over_line(actual_fg_made) = 1) AS over
           FROM sides WHERE week > 14 GROUP BY roof"""
    )


# Functions whose name would hide an imported operator.
for _name, _public in {
    "safe_ratio_columns": "safe_ratio",
    "games_by_team_week": "games_by_team",
    "rolling_games_played": "rolling_games",
    "rolling_allowed_any": "rolling_allowed",
    "jarque_bera_by_roof": "jarque_bera",
}.items():
    _REGISTRY[_public] = _REGISTRY.pop(_name)
