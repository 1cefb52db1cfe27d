import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from formbook.operators.durable import written
from formbook.operators.sides import stack_sides
from formbook.plans.comparables import add_comparables, add_comparables_to_games, comparable_points
from formbook.plans.form import FormSettings, build_games, game_sides, run, with_dotted_names
from formbook.plans.reports import (
    Cut,
    Threshold,
    cut_report,
    low_accuracy_cut,
    threshold_report,
    threshold_single,
    threshold_sweep,
)
from formbook.sources.schema import PLAYS, SCHEDULE, WEEKLY, require_columns
from formbook.sources.sinks import read_report_csv, write_csv, write_report_csv
from formbook.sources.tables import FormTables, in_seasons, kickers_only, read_tables, season_range, single_precision
from tests.conftest import rows


def weekly_row(season, week, team, att, made, pat_att=0, pat_made=0, player="p"):
    b = [None] * 6
    b[2] = float(made)
    return (season, week, team, player, "K", float(att), float(made), float(att - made), float(pat_att), float(pat_made), *b, None)


@pytest.fixture(scope="module")
def tables(spark):
    """H at home to W in week 7 after six weeks against fillers: H kicked 12 and allowed 6, W 3 and 18."""
    schedule, weekly, plays = [("g7", 2021, 7, "H", "W", "dome")], [], []
    for week in range(1, 7):
        schedule += [(f"h{week}", 2021, week, "H", "F", "dome"), (f"w{week}", 2021, week, "G", "W", "outdoors")]
        weekly += [weekly_row(2021, week, "H", 2, 1, 3, 3), weekly_row(2021, week, "W", 1, 1, 2, 1)]
        plays += [(2021, week, "H", "F", 4, 1, "made")] * 2 + [(2021, week, "F", "H", 4, 1, "missed")]
        plays += [(2021, week, "G", "W", 4, 1, "made")] * 3 + [(2021, week, "W", "G", 3, 1, "made")]
        if week % 2:
            plays.append((2021, week, "W", "G", 4, 1, "made"))
    weekly += [weekly_row(2021, 7, "H", 2, 2, 1, 1), weekly_row(2021, 7, "H", 1, 0, 0, 0, "q")]
    return FormTables(
        spark.createDataFrame(weekly, WEEKLY), spark.createDataFrame(schedule, SCHEDULE), spark.createDataFrame(plays, PLAYS)
    )


def test_side_orientation(tables):
    r = build_games(tables, FormSettings()).collect()
    assert len(r) == 1  # two kickers in one week do not double the game
    g = r[0]
    assert (g["home_team"], g["away_team"], g["roof"]) == ("H", "W", "dome")
    assert (g["home_games"], g["away_games"]) == (6, 6)
    assert (g["home_own_att"], g["home_allowed_att"], g["away_own_att"], g["away_allowed_att"]) == (12, 6, 3, 18)
    assert g["home_exp_att"] == pytest.approx(2.5) and g["away_exp_att"] == pytest.approx(0.75)
    assert g["home_adj_exp_att"] == pytest.approx(2.65) and g["away_adj_exp_att"] == pytest.approx(0.825)
    assert g["home_kick_pct"] == pytest.approx(0.5) and g["home_xppg"] == pytest.approx(3.0)
    assert g["home_exp_points"] == pytest.approx(2.5 * 3.8 * 0.5 + 3)
    assert (g["home_actual_fg_att"], g["home_actual_fg_made"], g["home_cash"]) == (3, 2, 1)
    assert g["home_points"] == 7 and g["away_points"] == 0
    assert g["away_actual_fg_made"] is None and g["away_cash"] is None
    # all downs: W allowed 3 a game, H attempted 2 a game
    assert g["home_proj_att"] == pytest.approx((3 + 2) / 2)


def test_sides_and_dotted_names(tables):
    games = build_games(tables)
    sides = game_sides(games)
    assert sides.count() == 2 * games.count()
    away = sides.filter("side = 'away'").first()
    assert (away["team"], away["opp"], away["exp_att"]) == ("W", "H", pytest.approx(0.75))
    named = with_dotted_names(games)
    assert {"home.fg_att", "homeexpatt", "adjhomeexpatt", "actualaway.fg_made", "adjaway.attpgallowed", "homecash"} <= set(
        named.columns
    )
    assert len(set(named.columns)) == len(named.columns)


def test_weeks_are_bounded(tables):
    assert build_games(tables, FormSettings(min_week=8)).count() == 0
    assert build_games(tables, FormSettings(min_week=1, max_week=6)).count() == 12
    assert build_games(tables, FormSettings().between(2005, 2020)).count() == 0


def test_run_writes_seasons_and_modern_codes(spark, tables, tmp_path):
    old = FormTables(*[t.replace({"H": "SD"}) for t in (tables.weekly, tables.schedule, tables.plays)])
    path = run(old, str(tmp_path / "games"), dotted=True)
    back = spark.read.parquet(path)
    assert (tmp_path / "games" / "season=2021").is_dir()
    r = back.first()
    assert r["home_team"] == "LAC" and r["homegamesplayed"] == 6 and r["homeexpatt"] == pytest.approx(2.5)
    path = run(tables, str(tmp_path / "more"), dotted=True, comparables=True)
    r = spark.read.parquet(path).first()
    assert r["homehistoricalfantasy"] == 7 and r["awayhistoricalfantasy"] == 0


def test_readers(spark, tables, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("weekly", "schedule", "plays")}
    raw = tables.weekly.withColumnRenamed("team", "recent_team")
    raw.unionByName(raw.limit(1).selectExpr(*[c if c != "position" else "'P' AS position" for c in raw.columns])).write.parquet(
        paths["weekly"]
    )
    tables.schedule.write.partitionBy("season").parquet(paths["schedule"])
    tables.plays.write.parquet(paths["plays"])
    back = read_tables(spark, **paths, seasons=season_range(2020, 2022), downcast_plays=True)
    assert rows(build_games(back), "game_id") == rows(build_games(tables), "game_id")
    assert dict(single_precision(spark.range(1).selectExpr("1.5D AS a", "1 AS b")).dtypes) == {"a": "float", "b": "int"}
    assert kickers_only(spark.read.parquet(paths["weekly"])).count() == tables.weekly.count()
    assert in_seasons(tables.schedule, [2019, 2021]).count() == tables.schedule.count()
    with pytest.raises(ValueError, match="roof"):
        require_columns(tables.schedule.drop("roof"), SCHEDULE.fieldNames(), "schedule")


def test_season_filter_prunes_folders(spark, tables, tmp_path):
    path = str(tmp_path / "s")
    tables.schedule.write.partitionBy("season").parquet(path)
    plan = in_seasons(spark.read.parquet(path), season_range(2020, 2022))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


SIDES = (
    "game_id string, season int, week int, side string, team string, exp_att double, adj_exp_att double, "
    "exp_points double, kick_pct double, xppg double, fg_att bigint, fg_made bigint, actual_fg_att bigint, "
    "actual_fg_made bigint, games bigint, cash int, points bigint, roof string"
)


def side(i, week, exatt, pct10, cash, points=5, exp_points=4.0):
    made = {1: 2, -1: 1, None: None}[cash]
    return (f"g{i}", 2020, week, "home", f"T{i}", exatt, exatt, exp_points, pct10 / 10 if pct10 is not None else None, 1.0, 10, pct10, made, made, 6, cash, points, "x")


@pytest.fixture(scope="module")
def sides(spark):
    data = [
        side(1, 7, 1.5, 9, 1, 6), side(2, 7, 1.5, 9, -1, 2), side(3, 8, 1.55, 9, 1, 9), side(4, 8, 1.42, 9, None, 0),
        side(5, 9, 1.6, 9, 1), side(6, 9, 1.5, 5, -1), side(7, 9, None, 9, 1, 7, None), side(8, 10, 1.5, 9, None),
    ]
    return written(spark.createDataFrame(data, SIDES))


def test_threshold_report_zero_rows(sides):
    board = sides.filter("week = 10")
    strict = threshold_report(sides, board).first()
    assert (strict["observations"], strict["profit"], strict["o_u"]) == (3, 1, "o")
    filled = threshold_report(sides, board, zero_fill=True).first()
    assert (filled["observations"], filled["profit"]) == (5, 1)
    assert filled["weeks_per_occurrence"] == pytest.approx(5 / 4)
    assert filled["hit_rate_ref"] == pytest.approx(0.5 + 1 / 5) and filled["hit_rate"] == pytest.approx(2 / 3)


def test_sweep_equals_single(sides):
    for fill in (False, True):
        one = threshold_single(sides, 1.5, "u", zero_fill=fill)
        many = threshold_sweep(sides, [Threshold(1.5), Threshold(1.6, "o"), Threshold(9.0)], zero_fill=fill)
        got = {r["threshold"]: r for r in many.collect()}
        for c in one.columns:
            assert got[1.5][c] == one.first()[c]
        assert (got[9.0]["observations"], got[9.0]["hit_rate"], got[9.0]["p_value"]) == (0, None, None)
        assert got[1.6]["o_u"] == "o"


def test_sweep_accuracy_cuts(sides):
    tries = [Threshold(1.5, "o", max_pct=0.6), Threshold(1.5, "o", min_pct=0.6)]
    got = {(r["min_pct"], r["max_pct"]): r["observations"] for r in threshold_sweep(sides, tries).collect()}
    assert got == {(None, 0.6): 1, (0.6, None): 2}


@pytest.mark.parametrize("zero_fill", [False, True])
@pytest.mark.parametrize("count", [1, 32, 33, 200])
def test_sweep_of_any_length_equals_brute_force(spark, count, zero_fill):
    rng = random.Random(count)
    pick = lambda *values: rng.choice([None, *values])
    data = [
        (rng.choice([2000, 2001]), rng.randint(1, 5), pick(1.0, 1.2, 1.25, 2.0), pick(0.0, 2.0, 4.0), pick(0.0, 1.0, 2.0, 3.0), pick(1, -1))
        for _ in range(150)
    ]
    schema = "season int, week int, exp_att double, fg_att double, fg_made double, cash int"
    tries = [
        Threshold(rng.choice([1.0, 1.2, 1.25, 1.9, 7.0]), rng.choice("uo"), pick(0.5, 0.9, 1.5), pick(0.25, 0.5)) for _ in range(count)
    ]
    tries[0] = Threshold(1.2, "u", 0.9)
    want = Counter()
    for t in tries:
        n = hits = misses = 0
        for _, _, exatt, att, made, cash in data:
            pct = None if att is None else 0.0 if att == 0 else None if made is None else made / att
            if zero_fill:
                exatt, pct, cash = exatt or 0, pct or 0, cash or 0
            if exatt is None or cash is None or not t.exatt * 0.97 <= exatt <= t.exatt * 1.03:
                continue
            if (t.max_pct is not None or t.min_pct is not None) and pct is None:
                continue
            if (t.max_pct is not None and pct > t.max_pct) or (t.min_pct is not None and pct < t.min_pct):
                continue
            n, hits, misses = n + 1, hits + (cash == 1), misses + (cash == -1)
        want[t.exatt, t.flag, t.min_pct, t.max_pct, n, (misses - hits) if t.flag == "u" else hits - misses] += 1
    periods = len({r[:2] for r in data})
    found = threshold_sweep(spark.createDataFrame(data, schema), tries, zero_fill=zero_fill).collect()
    assert Counter((r.threshold, r.o_u, r.min_pct, r.max_pct, r.observations, r.profit) for r in found) == want
    assert all(r.weeks_per_occurrence == pytest.approx(r.observations / periods) for r in found)


def test_sweep_over_no_sides(sides):
    found = threshold_sweep(sides.limit(0), [Threshold(1.5), Threshold(2.0)]).collect()
    assert [r.observations for r in found] == [0, 0]


def test_cut_report(sides):
    found = cut_report(sides, [Cut("u", max_exatt=1.5, max_pct=0.6), Cut("o", min_exatt=1.55), Cut("o")])
    got = {(r["min_exatt"], r["max_exatt"]): (r["observations"], r["profit"]) for r in found.collect()}
    assert got == {(None, 1.5): (1, 1), (1.55, None): (2, 2), (None, None): (5, 1)}


def test_low_accuracy_cut(sides):
    r = low_accuracy_cut(sides).first()
    assert (r["observations"], r["profit"], r["hit_rate"]) == (1, -1, 0.0)


def test_comparables_all_and_past(sides):
    got = {r["game_id"]: r["historical_points"] for r in add_comparables(sides).collect()}
    near = [6, 2, 9, 0, 5, 5]
    assert got["g1"] == pytest.approx(sum(near) / 6) and got["g7"] is None and got["g6"] == 5
    past = comparable_points(sides, as_of="past").filter("kick_pct = 0.9")
    assert {r["week"]: r["historical_points"] for r in past.collect()} == pytest.approx({8: 4.0, 9: 17 / 4, 10: 22 / 5})
    with pytest.raises(ValueError):
        comparable_points(sides, as_of="tomorrow")


def test_report_layout(spark, tmp_path):
    data = [(1.5, 0.8148, "o", 0.9286, 1.29e-8, 220, "JAX", 2, 0.5091), (1.2833, 0.4185, "o", 1.0, None, 113, 'N"YG', 2, 0.5177)]
    names = "threshold weeksperoccurence o_u kickpctthresh pvalue observations team profit hitrate".split()
    report = spark.createDataFrame(data, "threshold double, weeksperoccurence double, o_u string, kickpctthresh double, pvalue double, observations int, team string, profit int, hitrate double")
    path = write_report_csv(report.coalesce(1), str(tmp_path / "report"), ["observations"])
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "report").glob("part-*")))
    lines = text.split(b"\r\n")
    assert lines[0] == ('"",' + ",".join(f'"{n}"' for n in names)).encode()
    assert lines[1].startswith(b'"1",1.2833,') and b'"N""YG"' in lines[1] and b",NA," in lines[1]
    back = read_report_csv(spark, path).orderBy("row")
    assert [r["team"] for r in back.collect()][1] == "JAX" and back.filter("pvalue IS NULL").count() == 1
    empty = write_report_csv(report.limit(0).coalesce(1), str(tmp_path / "empty"), ["observations"])
    assert b"".join(p.read_bytes() for p in (tmp_path / "empty").glob("part-*")).startswith(lines[0] + b"\r\n")
    assert read_report_csv(spark, empty).count() == 0
    many = write_report_csv(spark.range(100).selectExpr("id AS n", "'a,b' AS t").repartition(5), str(tmp_path / "many"), ["n"])
    found = spark.read.option("header", True).csv(many).collect()
    assert sorted((int(r[0]), int(r[1]), r[2]) for r in found) == [(i + 1, i, "a,b") for i in range(100)]
    out = write_csv(report, str(tmp_path / "plain"))
    assert spark.read.option("header", True).csv(out).columns == names


def test_read_tables_checks_types_and_reads_nan_as_missing(spark, tables, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("weekly", "schedule", "plays")}
    nan = F.when(F.col("week") == 1, F.lit(float("nan"))).otherwise(F.col("fg_att"))
    tables.weekly.withColumn("fg_att", nan).withColumn("week", F.col("week").cast("long")).write.parquet(paths["weekly"])
    tables.schedule.write.parquet(paths["schedule"])
    tables.plays.write.parquet(paths["plays"])
    found = read_tables(spark, **paths)
    assert found.weekly.schema["week"].dataType.simpleString() == "int"
    assert {r.fg_att for r in found.weekly.filter("week = 1").collect()} == {None}
    assert found.weekly.filter("isnan(fg_att)").count() == 0
    tables.plays.withColumn("down", F.lit("fourth")).write.mode("overwrite").parquet(paths["plays"])
    with pytest.raises(ValueError, match="down"):
        read_tables(spark, **paths)


def test_dotted_export_names_the_opponent_and_what_it_allowed(tables):
    r = with_dotted_names(build_games(tables, FormSettings())).first()
    assert (r["home.oppteam"], r["away.oppteam"]) == ("W", "H")
    assert (r["home.oppfga"], r["away.oppfga"], r["home.OG"], r["away.OG"]) == (18, 6, 6, 6)
    assert (r["home.oppfgapg"], r["home.projfga"]) == (3.0, (3.0 + r["home.attpg"]) / 2)


def test_wide_comparables_of_earlier_weeks_only(spark):
    """Brute force: for either side of every game, the mean points of all sides of earlier weeks within five per cent."""
    rng = random.Random(12)
    games = [(f"g{i}", 2020, 1 + i // 6, *[rng.choice([1.0, 1.02, 2.0, 2.05]) for _ in range(2)], *[rng.choice([0.8, 0.82]) for _ in range(2)], i, i + 100) for i in range(30)]
    wide = spark.createDataFrame(games, "game_id string, season int, week int, home_exp_points double, away_exp_points double, home_kick_pct double, away_kick_pct double, home_points int, away_points int")
    history = stack_sides(wide, ["season", "week"], {c: (f"home_{c}", f"away_{c}") for c in ("exp_points", "kick_pct", "points")})
    rows_ = [(g[2], g[3 + s], g[5 + s], g[7 + s]) for g in games for s in (0, 1)]
    near = lambda x, y: y * 0.95 <= x <= y * 1.05
    for r in add_comparables_to_games(wide, history, as_of="past").collect():
        for side in ("home", "away"):
            met = [p for w, e, k, p in rows_ if w < r["week"] and near(e, r[f"{side}_exp_points"]) and near(k, r[f"{side}_kick_pct"])]
            assert r[f"{side}_historical_points"] == (pytest.approx(sum(met) / len(met)) if met else None)


def test_a_table_set_under_the_codes_of_its_time(spark):
    made = lambda team: FormTables(
        spark.createDataFrame([(s, team) for s in (2010, 2022)], "season int, team string"),
        spark.createDataFrame([(s, team, "KC") for s in (2010, 2022)], "season int, home_team string, away_team string"),
        spark.createDataFrame([(s, "KC", team) for s in (2010, 2022)], "season int, posteam string, defteam string"),
    )
    back = made("LV").with_historical_codes()
    assert rows(back.weekly, "season") == [(2010, "OAK"), (2022, "LV")]
    assert rows(back.schedule, "season") == [(2010, "OAK", "KC"), (2022, "LV", "KC")]
    assert rows(back.plays, "season") == [(2010, "KC", "OAK"), (2022, "KC", "LV")]
    assert rows(back.with_modern_codes().weekly, "season") == [(2010, "LV"), (2022, "LV")]
