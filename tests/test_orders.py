import datetime

import pytest
from pyspark.sql import functions as F

from formbook import queries
from formbook.plans.form import FormSettings, build_games
from formbook.functions.expr import BUCKET_POINTS
from formbook.operators.plays import attempts_by_role
from formbook.sources import orders
from formbook.sources.orders import OrderFolder
from tests.conftest import rows

LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string"
)
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
DAY = datetime.datetime(2000, 1, 3)


def line(key, number, supplier, quantity=10.0, discount=0.0, flag="R", tax=0.0):
    return (key, 1, supplier, number, quantity, 1.0, discount, tax, flag, "O")


def source(spark, lines):
    keys = sorted({x[0] for x in lines})
    return OrderFolder(
        spark.createDataFrame(lines, LINES), spark.createDataFrame([(k, 7, "O", 20_000.0, DAY, "x") for k in keys], ORDERS)
    )


@pytest.mark.parametrize("quantity, bucket", [(1.0, "fg_made_0_19"), (1200.0, "fg_made_60_"), (None, "fg_made_0_19")])
def test_every_made_kick_has_a_bucket(spark, quantity, bucket):
    found = orders.weekly(source(spark, [line(1, 1, 5, quantity), line(1, 2, 6, flag="N")])).filter("team = 5").first()
    assert (found.fg_att, found.fg_made, found[bucket]) == (1, 1, 1)
    assert [c for c in BUCKET_POINTS if found[c]] == [bucket]


@pytest.mark.parametrize("bad", [line(1, 40_000, 6), line(1, -1, 6), line(1, 2, 1 << 48), line(1, 2, -3)])
def test_what_does_not_fit_is_an_error(spark, bad):
    with pytest.raises(Exception, match="out of range"):
        orders.schedule(source(spark, [line(1, 1, 5), bad])).collect()


def test_points_of_a_very_long_game(spark):
    lines = [line(1, 2 * i + 1, 5, float(i % 60 + 1)) for i in range(500)] + [line(1, 1000, 6, flag="N")]
    yards = [i % 60 + 1 + 18 for i in range(500)]
    want = sum(3 if y < 40 else 4 if y < 50 else 5 for y in yards)
    lists = orders.weekly_lists(source(spark, lines))
    points = queries.distance_list_points("fg_made_list") * F.col("times") + F.col("pat_made")
    found = {r.team: r.points for r in lists.groupBy("team").agg(F.sum(points).alias("points")).collect()}
    assert found == {5: want, 6: 1}
    assert max(len(r.fg_made_list.split(";")) for r in lists.collect()) <= 60


def test_folded_attempts_equal_single_plays(spark, folder):
    data = OrderFolder.at(spark, folder)
    for down in (None, 4):
        folded = attempts_by_role(orders.attempts_by_game(data), down)
        assert rows(folded) == rows(attempts_by_role(orders.plays(data), down))


@pytest.mark.parametrize("name", ["points_by_bucket", "points_from_list", "rolling_allowed_fourth"])
def test_lines_are_folded_before_they_meet_their_game(spark, folder, name):
    """Between a scan of lines and the first join above it there is an aggregation."""
    plan = queries.registered()[name](spark, folder)._jdf.queryExecution().optimizedPlan()

    def below(node, folded):
        kind = node.nodeName()
        if kind == "Join":
            folded = False
        if kind == "Aggregate":
            folded = True
        if "l_orderkey" in node.output().mkString(",") and kind in ("LogicalRelation", "Relation"):
            assert folded, name
            return 1
        children = node.children()
        return sum(below(children.apply(i), folded) for i in range(children.size()))

    assert below(plan, False)


def test_lines_are_read_once_for_all_three_tables(spark, folder):
    """The plan of the data set has no scan of lines: one table of games was made from them."""
    found = orders.tables(orders.OrderFolder.at(spark, folder))
    plan = build_games(found, FormSettings(min_week=7, max_week=53))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan parquet") == 4


@pytest.mark.parametrize("seasons", [(), range(1996, 1998)])
def test_folded_tables_equal_those_made_one_by_one(spark, folder, seasons):
    data = orders.OrderFolder.at(spark, folder)
    found = orders.tables(data, seasons)
    plays = found.plays.groupBy("game_id", "posteam", "defteam", "down", "field_goal_result").agg(F.sum("field_goal_attempt").alias("n"))
    alone = orders.attempts_by_game(data, seasons).groupBy("game_id", "posteam", "defteam", "down", "field_goal_result").agg(F.sum("field_goal_attempt").alias("n"))
    for left, right in ((found.schedule, orders.schedule(data, seasons)), (plays, alone), (found.weekly, orders.weekly(data, seasons))):
        assert rows(left, *left.columns) == rows(right.select(left.columns), *left.columns) and left.count() > 0
    assert not seasons or {r["season"] for r in found.schedule.select("season").distinct().collect()} == set(seasons)


def test_lines_without_number_or_discount(spark):
    """A line without a number counts for the away side, an attempt of unknown discount as missed, in every table."""
    data = source(spark, [line(1, 1, 5), line(1, 2, 6), line(1, 6, 7, flag="R")])
    lines = data.lines.withColumn("l_discount", F.when(F.col("l_linenumber") == 6, None).otherwise(F.col("l_discount")))
    data = orders.OrderFolder(lines, data.orders)
    made = orders.tables(data).plays.filter("down = 3").collect()
    assert [(r["field_goal_attempt"], r["field_goal_result"]) for r in made] == [(1, "missed")]
