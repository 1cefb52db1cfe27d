import pytest
from pyspark.sql import functions as F

from formbook.operators.plays import attempts_by_role, rolling_allowed
from formbook.operators.relational import complete_rows, group_sums, numeric_columns, prefixed, stack_tables
from formbook.operators.rolling import (
    games_by_team,
    home_away_games,
    period_spine,
    rolling_games,
    team_week_kicking,
    trailing_on_spine,
    trailing_sums,
)
from formbook.operators.sides import add_opponent, distinct_matchups, schedule_sides, sides_to_games
from tests.conftest import rows

SCHEDULE = "game_id string, season int, week int, home_team string, away_team string, roof string"
PLAYS = (
    "season int, week int, posteam string, defteam string, down int, field_goal_attempt int, field_goal_result string"
)


def test_trailing_sum_by_period_value(spark):
    facts = spark.createDataFrame(
        [(1, 1, "A", 1), (1, 3, "A", 2), (1, 8, "A", None), (1, 9, "A", None), (1, 16, "A", None), (2, 1, "A", 9), (2, 2, "A", 9)],
        "season int, week int, team string, x int",
    )
    got = rows(trailing_sums(facts, ["x"], 6, suffix="_sum").select("season", "week", "x_sum"))
    assert got == [(1, 1, None), (1, 3, 1), (1, 8, 2), (1, 9, 2), (1, 16, None), (2, 1, None), (2, 2, 9)]


def test_bye_week_still_has_a_row(spark):
    facts = spark.createDataFrame([(1, 5, "A", 4), (1, 6, "B", 1), (1, 8, "B", 1)], "season int, week int, team string, x int")
    got = rows(trailing_on_spine(facts, ["x"], 6, 7, 9))
    assert got == [(1, 7, "A", 4), (1, 7, "B", 1), (1, 8, "A", 4), (1, 8, "B", 1), (1, 9, "A", 4), (1, 9, "B", 2)]


def test_later_weeks_do_not_leak_back(spark):
    base = [(1, w, "A", w) for w in range(1, 12)]
    changed = [(s, w, t, 1000 if w >= 8 else x) for s, w, t, x in base]
    schema = "season int, week int, team string, x int"
    a, b = (
        rows(trailing_on_spine(spark.createDataFrame(d, schema), ["x"], 6, 7, 8)) for d in (base, changed)
    )
    assert a == b == [(1, 7, "A", 21), (1, 8, "A", 27)]


def test_spine(spark):
    df = spark.createDataFrame([(1, 3, "A"), (1, 4, "A"), (2, 1, None)], "season int, week int, team string")
    assert rows(period_spine(df, 7, 8)) == [(1, 7, "A"), (1, 8, "A")]


@pytest.fixture
def schedule(spark):
    games = [("g1", 1, 1, "A", "B", "o"), ("g2", 1, 2, "A", "B", "o"), ("g3", 1, 3, "B", "A", "o"), ("g4", 1, 3, "D", "C", "d")]
    return spark.createDataFrame(games, SCHEDULE)


def test_games_played_counts_both_roles(schedule):
    got = dict((r["team"], r["games"]) for r in rolling_games(schedule, 6, 4, 4).collect())
    assert got == {"A": 3, "B": 3, "C": 1, "D": 1}
    assert rows(home_away_games(schedule)) == [(1, "A", 2, 1, 3), (1, "B", 1, 2, 3), (1, "C", 0, 1, 1), (1, "D", 1, 0, 1)]
    assert (1, 3, "C", 1) in rows(games_by_team(schedule))


def test_two_sides_per_game_and_back(schedule):
    sides = schedule_sides(schedule)
    assert sides.count() == 2 * schedule.count()
    back = sides_to_games(sides, ["game_id", "season", "week", "roof"], ["team"])
    assert rows(back.selectExpr("game_id", "season", "week", "home_team", "away_team", "roof")) == rows(schedule)


def test_matchups_are_distinct(spark, schedule):
    twice = schedule.union(spark.createDataFrame([("g9", 1, 1, "A", "B", "o")], SCHEDULE))
    assert rows(distinct_matchups(twice)) == rows(distinct_matchups(schedule))


def test_opponent_drops_byes(spark, schedule):
    teams = spark.createDataFrame([(1, 3, "A", 5), (1, 3, "X", 1)], "season int, week int, team string, x int")
    assert rows(add_opponent(teams, schedule)) == [(1, 3, "A", 5, "B")]


def test_two_kickers_one_team_week(spark):
    weekly = spark.createDataFrame(
        [(1, 1, "A", 1.0, 2.0), (1, 1, "A", 2.0, 0.0), (1, 1, None, 9.0, 9.0), (1, 2, "A", None, None)],
        "season int, week int, team string, fg_made double, pat_made double",
    )
    got = rows(team_week_kicking(weekly, ["fg_made", "pat_made"]))
    assert got == [(1, 1, "A", 3.0, 2.0), (1, 2, "A", 0.0, 0.0)]


def test_numeric_columns_and_sums(spark):
    df = spark.createDataFrame([(1, "A", 2, 0.5, "x"), (1, "A", 3, None, "y")], "week int, team string, a int, b double, c string")
    assert numeric_columns(df, {"week"}) == ["a", "b"]
    assert rows(group_sums(df, ["team"], ["a", "b"])) == [("A", 5, 0.5)]


def test_attempts_by_role(spark):
    plays = spark.createDataFrame(
        [
            (1, 1, "A", "B", 4, 1, "made"),
            (1, 1, "A", "B", 3, 1, "missed"),
            (1, 1, "B", "A", 4, 1, "blocked"),
            (1, 1, "B", "A", 4, 0, None),
            (1, 1, "B", "A", 4, None, None),
            (1, 1, "B", None, 4, 1, "made"),
        ],
        PLAYS,
    )
    assert rows(attempts_by_role(plays)) == [(1, 1, "A", 2, 1, 1, 0), (1, 1, "B", 2, 1, 2, 1)]
    fourth = rows(attempts_by_role(plays, down=4))
    assert fourth == [(1, 1, "A", 1, 1, 1, 0), (1, 1, "B", 2, 1, 1, 1)]
    assert rows(rolling_allowed(plays, 6, 2, 2)) == [(1, 2, "A", 2, 1, 1, 0), (1, 2, "B", 2, 1, 2, 1)]


def test_own_attempts_equal_allowed_attempts(spark, folder):
    from formbook.sources import orders

    plays = orders.plays(orders.OrderFolder.at(spark, folder))
    own, allowed, made, conceded = (
        attempts_by_role(plays)
        .agg(F.sum("own_att"), F.sum("allowed_att"), F.sum("own_made"), F.sum("allowed_made"))
        .first()
    )
    assert own == allowed > 0 and made == conceded > 0


def test_small_relational_tools(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(3, 4)], "k int, y int")
    assert rows(stack_tables([a, b])) == [(1, 2, None), (3, None, 4)]
    assert prefixed(a, "home_", keep=["k"]).columns == ["k", "home_x"]
    assert rows(complete_rows(stack_tables([a, b]), ["x"])) == [(1, 2, None)]


def test_trailing_totals_under_other_names(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 7), (1, 4, "b", 1)], "year int, month int, shop string, sold long")
    found = trailing_on_spine(df, ["sold"], 2, 2, 4, entity="shop", season="year", period="month")
    assert rows(found, "shop", "month") == [(1, 2, "a", 5), (1, 3, "a", 12), (1, 4, "a", 7)]


def test_targets_come_after_the_aggregation(spark):
    """Targets made before an aggregation come from the few tasks that hold the distinct pairs, and stay in their memory."""
    facts = spark.range(100).selectExpr("1 AS season", "CAST(id % 10 AS INT) AS week", "id % 7 AS team", "id AS x")
    plan = trailing_on_spine(facts, ["x"], 6, 7, 53)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Aggregate")


def test_trailing_totals_of_unknown_and_late_entities(spark):
    """NULL names have rows for the periods of their facts only; who appears after the last target is kept where empty rows are."""
    found = [(1, 2, "A", 1), (1, 2, "A", 4), (1, 9, "B", 2), (1, None, "C", 3), (1, 2, None, 5), (1, 3, None, 6), (None, 3, "A", 7), (None, 4, "A", 8)]
    facts = spark.createDataFrame(found, "season int, week int, team string, x long")
    named = [(1, 3, "A", 5), (1, 4, "A", 5)]
    unnamed = [(1, 3, None, 5), (None, 4, "A", 7)]
    assert set(rows(trailing_on_spine(facts, ["x"], 2, 3, 4))) == {*named, *unnamed}
    empty = [(1, w, t, None) for w in (3, 4) for t in "BC"] + [(None, 3, "A", None)]
    assert set(rows(trailing_on_spine(facts, ["x"], 2, 3, 4, keep_empty=True))) == {*named, *unnamed, *empty}
