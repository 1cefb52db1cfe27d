import math

import pytest
from pyspark.sql import functions as F

from formbook.functions.expr import (
    POINTS_MODEL,
    bucket_points,
    distance_list_points,
    linear_score,
    over_line,
    relative_band,
    safe_ratio,
)
from formbook.functions.stats import chi2_2df_tail, hit_rate, hit_rate_doubled, jarque_bera, jarque_bera_signs
from formbook.operators.codes import historical_code, modern_code, normalize_codes
from tests.conftest import rows


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 2.0, None), (4, None, 2.0), (5, 1.0, 4.0)], "i int, a double, b double")
    assert rows(df.select("i", safe_ratio("a", "b").alias("r"))) == [(1, 0.0), (2, 0.0), (3, None), (4, None), (5, 0.25)]


def test_over_line_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, None)], "i int, made double")
    assert rows(df.select("i", over_line("made").alias("c"))) == [(1, 1), (2, -1), (3, None)]


def test_bucket_points_and_fallback(spark):
    full = spark.createDataFrame(
        [(1, 1, 1, 1, None, 1, 1, 1)],
        "pat_made int, fg_made_0_19 int, fg_made_20_29 int, fg_made_30_39 int, fg_made_40_49 int, "
        "fg_made_50_59 int, fg_made_60_ int, fg_made int",
    )
    assert full.select(bucket_points(full.columns)).first()[0] == 1 + 3 + 3 + 3 + 0 + 5 + 5
    short = full.select("pat_made", "fg_made")
    assert short.select(bucket_points(short.columns)).first()[0] == 1 + 3


@pytest.mark.parametrize(
    "text, points", [("23;45;52;61", 17), ("38", 3), ("", 0), (None, 0), ("NA;40", 4), ("19;29", 6)]
)
def test_distance_list_points(spark, text, points):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(distance_list_points("t")).first()[0] == points


def test_distance_list_limit(spark):
    df = spark.createDataFrame([(";".join(["33"] * 10),)], "t string")
    assert df.select(distance_list_points("t"), distance_list_points("t", 8)).first() == (30, 24)


def test_linear_score_product_term(spark):
    df = spark.createDataFrame([(2.0, 1.5, 0.8)], "xppg double, adj_exp_att double, kick_pct double")
    expected = 3.9676 + 0.40388 * 2 + 1.1195 * 1.5 + 2.24413 * 0.8 - 0.66712 * 1.5 * 0.8
    assert df.select(linear_score(POINTS_MODEL)).first()[0] == pytest.approx(expected, abs=1e-12)


def test_band_ends_are_inside(spark):
    df = spark.createDataFrame([(3.79,), (3.8,), (4.0,), (4.2,), (4.21,)], "x double")
    assert [r[0] for r in rows(df.filter(relative_band("x", 4.0, 0.05)))] == [3.8, 4.0, 4.2]


def test_codes_are_whole_values_with_strict_bounds(spark):
    seasons = [(2015, "LAC"), (2015, "LA"), (2015, "LV"), (2016, "LAC"), (2016, "LA"), (2020, "LV")]
    df = spark.createDataFrame(seasons, "season int, team string")
    got = [r[0] for r in df.select(historical_code("team")).collect()]
    assert got == ["SD", "STL", "OAK", "LAC", "STL", "LV"]
    seasons = [(2022, "SD"), (2022, "STL"), (2022, "OAK"), (2017, "STL"), (2022, "KC"), (2022, None)]
    df = spark.createDataFrame(seasons, "season int, team string")
    assert [r[0] for r in df.select(modern_code("team")).collect()] == ["LAC", "LA", "LV", "STL", "KC", None]


def test_numeric_keys_are_not_codes(spark):
    df = spark.createDataFrame([(2015, 7)], "season int, team int")
    assert normalize_codes(df, ["team"]).collect() == df.collect()


def test_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, -1, -1, -1, 0, 1)], "v double")
    skew, excess = df.select(F.skewness("v"), F.kurtosis("v")).first()
    assert skew == pytest.approx(0) and excess == pytest.approx(-1.8333333)
    counted = df.agg(F.count("v").alias("n"), F.count_if(F.col("v") > 0).alias("h"), F.count_if(F.col("v") < 0).alias("m"))
    a = df.agg(jarque_bera("v")).first()[0]
    b = counted.select(jarque_bera_signs(F.col("n"), F.col("h"), F.col("m"))).first()[0]
    assert a == pytest.approx(b, rel=1e-12) and a == pytest.approx(7 / 6 * 1.8333333**2 / 4, rel=1e-6)


def test_statistics_of_nothing_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0), (3, 3, 0), (2, 0, 0)], "n int, h int, m int")
    n, h, m = F.col("n"), F.col("h"), F.col("m")
    got = df.select(jarque_bera_signs(n, h, m), hit_rate(h, m), hit_rate_doubled(n, h - m)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (None, 1.0, 1.5), (None, None, 0.5)]


# Published weekly report: hits and misses recovered from its counts, zeros from its p-value.
GOLDEN = [
    ("JAX", 110, 108, 2, "o", 2, 0.509091, 0.504587, 1.290664052e-08),
    ("NYG", 57, 55, 1, "o", 2, 0.517699, 0.508929, 8.847587151e-05),
    ("DAL", 53, 49, 1, "o", 4, 0.538835, 0.519608, 2.035766117e-04),
    ("KC", 111, 109, 3, "o", 2, 0.508969, 0.504545, 1.094056252e-08),
    ("PHI", 101, 107, 3, "u", 6, 0.528436, 0.514423, 2.974250834e-08),
    ("BUF", 35, 51, 2, "u", 16, 0.681818, 0.593023, 7.475892414e-04),
]


def test_published_report_rows(spark):
    from formbook.plans.reports import verdict

    data = [(t, h + m + z, h, m) for t, h, m, z, *_ in GOLDEN]
    df = spark.createDataFrame(data, "team string, n bigint, hits bigint, misses bigint")
    got = {r["team"]: r for r in verdict(df, F.lit(270)).collect()}
    for team, h, m, z, flag, profit, ref, rate, p in GOLDEN:
        r = got[team]
        assert (r["o_u"], r["profit"], r["observations"]) == (flag, profit, h + m + z)
        assert r["hit_rate_ref"] == pytest.approx(ref, abs=1e-6)
        assert r["hit_rate"] == pytest.approx(rate, abs=1e-6)
        assert r["p_value"] == pytest.approx(p, rel=1e-8)
        assert r["weeks_per_occurrence"] == pytest.approx((h + m + z) / 270)


def test_tail(spark):
    assert spark.range(1).select(chi2_2df_tail(F.lit(2.0))).first()[0] == pytest.approx(math.exp(-1))
