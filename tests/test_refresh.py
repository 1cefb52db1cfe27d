"""The stored data set, kept up to date week by week, and its seasons."""

from pyspark.sql import functions as F

from formbook.plans.form import FormSettings, build_games
from formbook.plans.refresh import WeekStore
from formbook.sources import orders
from formbook.sources.sinks import read_games, write_games
from formbook.sources.tables import FormTables
from tests.conftest import rows

SETTINGS = FormSettings(min_week=3, max_week=9, window_weeks=3)


def some_weeks(spark, folder):
    found = orders.tables(orders.OrderFolder.at(spark, folder), range(1995, 1996))
    return FormTables(*[t.filter("week BETWEEN 1 AND 9").cache() for t in (found.weekly, found.schedule, found.plays)])


def same(left, right):
    assert set(left.columns) == set(right.columns)
    names = sorted(left.columns)
    return rows(left.select(names), "game_id") == rows(right.select(names), "game_id")


def test_week_by_week_equals_one_run(spark, folder, tmp_path):
    tables, store = some_weeks(spark, folder), WeekStore(str(tmp_path / "store"), SETTINGS)
    for week in range(1, 10):
        computed = store.add_week(tables, 1995, week)
        assert computed == ([week] if week >= 3 else [])
    assert same(store.games(spark), build_games(tables, SETTINGS))


def test_a_corrected_week_reaches_the_windows_after_it(spark, folder, tmp_path):
    tables, store = some_weeks(spark, folder), WeekStore(str(tmp_path / "store"), SETTINGS)
    for week in range(1, 10):
        store.add_week(tables, 1995, week)
    before = {r["game_id"]: r for r in store.games(spark).collect()}
    doubled = tables.weekly.withColumn("fg_att", F.when(F.col("week") == 4, 2 * F.col("fg_att")).otherwise(F.col("fg_att")))
    corrected = FormTables(doubled, tables.schedule, tables.plays)
    assert store.add_week(corrected, 1995, 4) == [4, 5, 6, 7]
    assert same(store.games(spark), build_games(corrected, SETTINGS))
    after = {r["game_id"]: r for r in store.games(spark).collect()}
    changed = {after[g]["week"] for g in after if after[g] != before[g]}
    assert changed <= {4, 5, 6, 7} and len(changed) > 1


def test_other_seasons_survive_a_rerun(spark, tmp_path):
    path = str(tmp_path / "games")
    made = lambda season, n: spark.range(n).selectExpr("id", f"{season} AS season", "CAST(id % 5 AS INT) AS week")
    write_games(made(2020, 10).union(made(2021, 20)), path)
    write_games(made(2021, 7), path)
    assert rows(read_games(spark, path).groupBy("season").count(), "season") == [(2020, 10), (2021, 7)]


def test_a_filtered_table_of_periods_prunes_seasons(spark, tmp_path):
    path = str(tmp_path / "games")
    write_games(spark.range(400).selectExpr("id", "CAST(2000 + id % 20 AS INT) AS season", "CAST(id % 5 AS INT) AS week"), path)
    periods = spark.createDataFrame([(2003, "new"), (2004, "old")], "season int, era string").filter("era = 'new'")
    periods.write.parquet(str(tmp_path / "periods"))
    found = read_games(spark, path, spark.read.parquet(str(tmp_path / "periods")).filter("era = 'new'"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.count() == 20 and {r["season"] for r in found.collect()} == {2003}
