import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.operators.bands import HIGHEST, Band, around, band_totals
from formbook.operators.boards import board_totals
from formbook.operators.cumulative import in_blocks, running_totals
from formbook.operators.quantiles import five_number_summary, group_quantiles


def brute(history, probes, boxes):
    """boxes(probe) -> [(lo, hi)] per dimension; history rows are (x1, .., xd, m)."""
    out = {}
    for p in probes:
        limits = boxes(p)
        if any(lo is None or hi is None for lo, hi in limits):
            continue
        inside = [
            h for h in history if all(v is not None and lo <= v <= hi for v, (lo, hi) in zip(h[:-1], limits))
        ]
        if inside:
            out[p] = (len(inside), sum(h[-1] or 0 for h in inside))
    return out


def found(df, key):
    return {tuple(r[k] for k in key): (r["n"], r["m"]) for r in df.collect()}


def shares(df):
    counts = [r["count"] for r in df.groupBy("_block").count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("shape", ["close", "one value", "spread", "two groups"])
def test_no_block_holds_more_than_its_share(spark, shape):
    """Eight blocks: none has a quarter of the rows, however the values lie."""
    sql = {"close": "1.7e9D + id * 60D", "one value": "1D", "spread": "exp(id / 200D)", "two groups": "CAST(id % 7 AS DOUBLE)"}[shape]
    df = spark.range(100_000).selectExpr(f"{sql} AS v", "id", "IF(id % 10 = 0, 'a', 'b') AS g")
    cut = in_blocks(df, "v", ["g"] if shape == "two groups" else [])
    assert cut.select("_block").distinct().count() > 4 and shares(cut) < 0.25
    ends = cut.groupBy(*(["g"] if shape == "two groups" else []), "_block").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    ends = sorted((r["_block"], r["lo"], r["hi"]) for r in ends if shape != "two groups")
    assert all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))


def test_infinite_and_missing_values_have_their_place(spark):
    values = [None, float("-inf"), -1e308, 0.0, 0.0, 5e-324, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v, i, 1) for i, v in enumerate(values)], "v double, i int, m long").repartition(4)
    got = {r["i"]: (r["m_run"], r["m_all"]) for r in running_totals(df, "v", ["m"]).collect()}
    assert {got[3][0], got[4][0]} <= {4, 5} and all(got[i] == (i + 1, 9) for i in (0, 1, 2, 5, 6, 7, 8))


def test_running_totals_over_close_values(spark):
    """Every row's total is right where rows of one group lie in many blocks."""
    df = spark.range(20_000).selectExpr("1.7e9D + id * 60D AS v", "id AS m", "IF(id % 3 = 0, 'a', 'b') AS g")
    found = running_totals(df, "v", ["m"], ["g"])
    want = df.selectExpr("v", "sum(m) OVER (PARTITION BY g ORDER BY v) AS want", "sum(m) OVER (PARTITION BY g) AS want_all")
    assert found.join(want, "v").filter("m_run != want OR m_all != want_all").count() == 0 and found.count() == 20_000


def test_running_totals_match_a_plain_scan(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.uniform(0, 10), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double, i int, m bigint")
    got = {r["i"]: (r["m_run"], r["m_all"]) for r in running_totals(df, "v", ["m"], ["g"]).collect()}
    for g, v, i, _ in data:
        same = [r for r in data if r[0] == g]
        assert got[i] == (sum(r[3] for r in same if r[1] <= v), sum(r[3] for r in same))


@pytest.mark.parametrize("seed, shape", [(1, "spread"), (2, "hot"), (3, "grid"), (4, "one")])
def test_two_dimensions_against_brute_force(spark, seed, shape):
    rng = random.Random(seed)

    def value(dim):
        if shape == "one":
            return 1.0
        if shape == "hot" and rng.random() < 0.4:
            return 1.0
        if shape == "grid":
            return rng.randint(0, 6) / 4
        return rng.choice([0.0, rng.uniform(0.5, 1.0), rng.uniform(0.1, 6.0)]) if dim else rng.randint(0, 9) / rng.randint(1, 9)

    history = [
        (value(0), value(1) if rng.random() > 0.1 else None, rng.randint(0, 20)) for _ in range(300)
    ]
    probes = list({(value(0), value(1)) for _ in range(120)}) + [(None, 1.0), (-1.0, 1.0), (50.0, 1.0)]
    h = spark.createDataFrame(history, "a double, b double, m bigint")
    p = spark.createDataFrame(probes, "pa double, pb double")
    got = band_totals(h, p, ["pa", "pb"], [around("a", "pa", 0.05), around("b", "pb", 0.05)], ["m"])
    want = brute(
        history,
        [q for q in probes if None not in q],
        lambda q: [(q[0] * 0.95, q[0] * 1.05), (q[1] * 0.95, q[1] * 1.05)],
    )
    assert found(got, ["pa", "pb"]) == want


def test_one_and_three_dimensions_with_open_ends(spark):
    rng = random.Random(9)
    history = [(float(rng.randint(1, 30)), rng.randint(0, 8) / 8, rng.uniform(0, 3), 1 + i % 4) for i in range(250)]
    h = spark.createDataFrame(history, "t double, a double, b double, m bigint")
    probes = list({(float(rng.randint(1, 30)), rng.randint(0, 8) / 8, round(rng.uniform(0, 3), 2)) for _ in range(60)})
    p = spark.createDataFrame(probes, "pt double, pa double, pb double")
    bands = [Band("t", f"-{HIGHEST}D", "pt - 1"), around("a", "pa", 0.2), around("b", "pb", 0.1)]
    got = band_totals(h, p, ["pt", "pa", "pb"], bands, ["m"])
    want = brute(
        history, probes, lambda q: [(-HIGHEST, q[0] - 1), (q[1] * 0.8, q[1] * 1.2), (q[2] * 0.9, q[2] * 1.1)]
    )
    assert found(got, ["pt", "pa", "pb"]) == want
    one = band_totals(h, p.select("pb").distinct(), ["pb"], [around("b", "pb", 0.1)], ["m"])
    want = brute([x[2:] for x in history], [(q[2],) for q in probes], lambda q: [(q[0] * 0.9, q[0] * 1.1)])
    assert found(one, ["pb"]) == want


def test_no_pairs_in_the_plan(spark):
    h = spark.range(50).selectExpr("id / 10D AS a", "id / 7D AS b", "id AS m")
    got = band_totals(h, h, ["a", "b"], [around("a", "a", 0.05), around("b", "b", 0.05)], ["m"])
    plan = got._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert bad not in plan


def test_quantiles_match_numpy(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([round(rng.uniform(-2, 8), 1), 1.0, None])) for g in (1, 2, 3) for _ in range(rng.randint(1, 200))]
    data += [(4, 2.5), (5, None)]
    df = spark.createDataFrame(data, "g int, v double")
    ps = {"p0": 0.0, "p25": 0.25, "p88": 0.88, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in group_quantiles(df, "v", ps, ["g"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for g, row in got.items():
        values = [v for k, v in data if k == g and v is not None]
        for name, p in ps.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_interpolated_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 6)], "v double")
    assert group_quantiles(df, "v", {"q": 0.88}).first()["q"] == pytest.approx(4.52)


def test_summary_of_large_offsets(spark):
    values = [1e9 + d for d in (0, 1, 1, 2, 6)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = five_number_summary(df, "v").first()
    assert (r["n"], r["min"], r["median"], r["max"]) == (5, 1e9, 1e9 + 1, 1e9 + 6)
    assert r["sd"] == pytest.approx(np.std(values, ddof=1), rel=1e-9)
    assert r["mean"] == pytest.approx(np.mean(values))


def test_hot_value_is_folded_before_the_shuffle(spark):
    """A value shared by a third of the rows meets the first shuffle as one row per task."""
    df = spark.range(0, 30000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 1D ELSE id / 1e4D END AS v")
    got = group_quantiles(df, "v", {"q": 0.5}).first()["q"]
    assert got == pytest.approx(np.quantile([1.0 if i % 3 == 0 else i / 1e4 for i in range(30000)], 0.5))
    assert df.agg(F.count_if(F.col("v") == 1)).first()[0] >= 10000


@pytest.mark.parametrize("most_cells", [4_000_000, 10])
@pytest.mark.parametrize("shape", ["spread", "grid", "one"])
def test_a_board_by_prefix_sums_equals_brute_force(spark, shape, most_cells):
    """Ends that touch values, boxes that share ends, empty and impossible boxes, missing and infinite values."""
    rng = random.Random(len(shape))
    value = {"spread": lambda: rng.uniform(0, 3), "grid": lambda: rng.randint(0, 8) / 4, "one": lambda: 1.0}[shape]
    odd = [(None, 1.0, 2), (1.0, None, 2), (float("inf"), 1.0, 3), (1.0, float("-inf"), 4), (0.0, 0.0, None)]
    history = [(value(), value(), rng.randint(-3, 9)) for _ in range(400)] + odd
    probes = [(value(), value()) for _ in range(25)] + [(99.0, 1.0), (None, 1.0), (float("inf"), 1.0), (0.0, 0.0), (-1.0, 1.0)]
    want = brute(history, probes, lambda p: [(None, None) if v is None else (v * 0.9, v * 1.1) for v in p])
    bands = [around("x", "px", 0.1), around("y", "py", 0.1)]
    df = spark.createDataFrame(history, "x double, y double, m long").repartition(3)
    board = spark.createDataFrame(probes + probes[:5], "px double, py double")
    assert found(board_totals(df, board, ["px", "py"], bands, ["m"], most_cells), ["px", "py"]) == want
    assert board_totals(df, board.limit(0), ["px", "py"], bands, ["m"], most_cells).count() == 0
    assert board_totals(df.limit(0), board, ["px", "py"], bands, ["m"], most_cells).count() == 0


def test_a_board_report_reads_its_history_once(spark):
    df = spark.range(100).selectExpr("id / 10D AS x", "id / 7D AS y", "id AS m")
    board = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "px double, py double")
    plan = board_totals(df, board, ["px", "py"], [around("x", "px", 0.1), around("y", "py", 0.1)], ["m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 100") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most_cells", [1_000_000, 0])
@pytest.mark.parametrize("shape", ["spread", "grid", "one"])
def test_three_dimensions_by_a_sweep_equal_brute_force(spark, shape, most_cells):
    """Many steps and blocks; ends that touch values, equal ends, empty boxes, missing values, a total that is not one of doubles."""
    rng = random.Random(len(shape))
    value = {"spread": lambda: rng.uniform(0, 3), "grid": lambda: rng.randint(0, 8) / 4, "one": lambda: 1.0}[shape]
    odd = [(None, 1.0, 1.0, 2), (1.0, 1.0, None, 2), (1.0, 1.0, 1.0, 2**60 + 1), (0.0, 0.0, 0.0, None)]
    history = [(float(rng.randint(1, 30)), rng.randint(0, 8) / 8, value(), rng.randint(-3, 9)) for _ in range(2500)] + odd
    probes = list({(float(rng.randint(0, 32)), rng.randint(0, 8) / 8, value()) for _ in range(400)})
    probes += [(None, 1.0, 1.0), (2.0, 1.0, 99.0), (0.0, 1.0, 1.0), (40.0, 1.0, 1.0), (3.0, -1.0, 1.0)]
    bands = [Band("t", f"-{HIGHEST}D", "pt - 1"), around("a", "pa", 0.2), around("b", "pb", 0.1)]
    h = spark.createDataFrame(history, "t double, a double, b double, m bigint").repartition(3)
    p = spark.createDataFrame(probes, "pt double, pa double, pb double")
    want = brute(
        history,
        [q for q in probes if None not in q],
        lambda q: [(-HIGHEST, q[0] - 1), (q[1] * 0.8, q[1] * 1.2), (q[2] * 0.9, q[2] * 1.1)],
    )
    assert found(band_totals(h, p, ["pt", "pa", "pb"], bands, ["m"], most_cells), ["pt", "pa", "pb"]) == want


def test_a_sweep_moves_each_point_and_end_once(spark, monkeypatch):
    """Rows dealt along the last dimension: one per point and two per box, not one per range of ranks."""
    from formbook.operators import cumulative, sweeps

    sent = []

    def counted(df, *args, **more):
        dealt = in_blocks(df, *args, **more)
        sent.append(dealt.count())
        return dealt

    monkeypatch.setattr(cumulative, "in_blocks", counted)
    monkeypatch.setattr(sweeps, "in_blocks", counted)
    h = spark.range(4000).selectExpr("id % 40 AS t", "id % 37 / 37D AS a", "id / 7D AS b", "id AS m")
    bands = [Band("t", f"-{HIGHEST}D", "t - 1"), around("a", "a", 0.2), around("b", "b", 0.1)]
    assert band_totals(h, h, ["t", "a", "b"], bands, ["m"]).count() > 3000
    assert max(sent) <= 3 * 4000
