import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook import queries
from formbook.operators import models
from formbook.operators.models import Model, correlation_matrix, fit_linear, fit_models, prediction_errors, simple_fit


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 3, (200, 2))
    y = 1.5 + 2 * x[:, 0] - x[:, 1] + 0.7 * x[:, 0] * x[:, 1] + rng.normal(0, 0.1, 200)
    return spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), x, y


def test_interaction_matches_lstsq(data):
    df, x, y = data
    design = np.column_stack([np.ones(len(y)), x[:, 0], x[:, 1], x[:, 0] * x[:, 1]])
    want, res, *_ = np.linalg.lstsq(design, y, rcond=None)
    fit = fit_linear(df, "y", ["a", "b", "a:b"])
    assert [fit.intercept, *fit.weights.values()] == pytest.approx(want.tolist(), abs=1e-8)
    assert fit.r2 == pytest.approx(1 - res[0] / np.sum((y - y.mean()) ** 2), abs=1e-8)
    scored = df.select(fit.score().alias("p"), "y")
    assert np.array(scored.select("p").collect()).ravel() == pytest.approx(design @ want, abs=1e-8)
    errors = prediction_errors(scored, "y", "p").first()
    assert errors["rmse"] == pytest.approx(np.sqrt(np.mean((y - design @ want) ** 2)))
    assert errors["mae"] == pytest.approx(np.mean(np.abs(y - design @ want)))


def test_nulls_are_dropped_or_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (None, 9.0)], "x double, y double")
    assert fit_linear(df, "y", ["x"]).weights["x"] == pytest.approx(1.5)
    zero = fit_linear(df, "y", ["x"], zero_fill=True)
    want = np.polyfit([1, 2, 3, 0], [2, 3, 5, 9], 1)
    assert (zero.weights["x"], zero.intercept) == pytest.approx(tuple(want))
    assert df.select(zero.score().alias("p")).filter("p IS NULL").count() == 0


def test_simple_fit(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 5)], "x int, y int")
    r = simple_fit(df, "y", "x").first()
    assert (r["slope"], r["intercept"], r["r2"]) == pytest.approx((1.5, 1 / 3, 0.9642857), abs=1e-6)
    assert r["n"] == 3


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (3, 5, 2)], "x int, y int, z int")
    got = {(r["row"], r["col"]): r["r"] for r in correlation_matrix(df, ["x", "y", "z"]).collect()}
    want = np.corrcoef(np.array([(1, 2, 5), (2, 3, 1), (3, 5, 2)]).T)
    assert got[("x", "y")] == pytest.approx(0.981981, abs=1e-6)
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            assert got[(a, b)] == pytest.approx(want[i, j])


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        fit_linear(spark.range(0).select(F.col("id").alias("x"), F.col("id").alias("y")), "y", ["x"])


def _brute_fit(rows, target, terms):
    """Coefficients, r2 and n by numpy from complete rows (dicts)."""
    value = lambda r, t: np.prod([r[c] for c in t.split(":")])
    y = np.array([r[target] for r in rows])
    design = np.column_stack([np.ones(len(rows)), *[[value(r, t) for r in rows] for t in terms]])
    found = np.linalg.lstsq(design, y, rcond=None)[0]
    return found, 1 - np.sum((y - design @ found) ** 2) / np.sum((y - y.mean()) ** 2), len(rows)


def test_many_models_and_groups_in_one_pass(spark):
    """Each model under its own mask of missing values, for every group, far from zero so that plain sums would lose digits."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        a, b, c = rng.uniform(0, 1, 3) + 1e6 * (i % 3 == 2)
        y = 3 + 2 * a - b + 0.5 * a * c + rng.normal(0, 0.1)
        cells = {"g": "xyz"[i % 3], **{k: float(v) for k, v in {"a": a, "b": b, "c": c, "y": y, "z": a - 2 * b}.items()}}
        for name in "abcyz":
            if rng.random() < 0.05:
                cells[name] = None
        rows.append(cells)
    rows.append(dict.fromkeys("abcyz", None) | {"g": "empty"})
    df = spark.createDataFrame([tuple(r[k] for k in "gabcyz") for r in rows], "g string, a double, b double, c double, y double, z double").repartition(5)
    wanted = [Model("y", ("a",)), Model("y", ("a", "b", "a:c")), Model("z", ("b", "a"), needs=("c", "y"))]
    found = {(r["g"], r["target"], r["terms"]): r for r in fit_models(df, wanted, ["g"]).collect()}
    assert len(found) == 12
    for model in wanted:
        used = {c for t in model.terms for c in t.split(":")} | {model.target, *model.needs}
        for g in "xyz":
            complete = [r for r in rows if r["g"] == g and all(r[c] is not None for c in used)]
            got = found[g, model.target, ",".join(model.terms)]
            if g == "z" and len(model.terms) == 3:
                continue  # products of values near a million: numpy's own answer is not precise either
            want, r2, n = _brute_fit([{k: v for k, v in r.items() if k != "g"} for r in complete], model.target, model.terms)
            assert got["n"] == n and got["r2"] == pytest.approx(r2, abs=1e-6)
            assert got["weights"] == pytest.approx(list(want[1:]), rel=1e-4, abs=1e-4)
        nothing = found["empty", model.target, ",".join(model.terms)]
        assert nothing["n"] == 0 and nothing["intercept"] is None and set(nothing["weights"]) == {None}


def test_a_term_that_repeats_another_has_no_weight(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x, 5.0, 3.0 * x + 1) for x in range(9)], "a double, b double, one double, y double")
    fit = fit_models(df, [Model("y", ("a", "b", "one"))]).first()
    assert fit["weights"] == pytest.approx([3, 0, 0], abs=1e-9) and (fit["intercept"], fit["r2"]) == (pytest.approx(1), pytest.approx(1))


def test_models_of_all_groups_read_the_table_once(spark, folder):
    plan = queries.registered()["ols_by_season"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4  # target games, fixtures, kicks and attempts of one table of games
    assert "lineitem" not in plan


def test_many_correlations_are_split_over_rows(spark):
    """Pairs count only where both are known; no aggregation holds more correlations than the JVM compiles together."""
    rng = np.random.default_rng(4)
    data = rng.normal(1e6, 1.0, (300, 8)) + rng.normal(0, 1, (300, 1))
    known = rng.random((300, 8)) > 0.1
    names = list("abcdefgh")
    df = spark.createDataFrame([tuple(float(v) if k else None for v, k in zip(r, m)) for r, m in zip(data, known)], ", ".join(f"{n} double" for n in names))
    found = models.correlation_matrix(df, names)
    got = {(r["row"], r["col"]): r["r"] for r in found.collect()}
    assert len(got) == 64
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = known[:, i] & known[:, j]
            assert got[a, b] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert max(line.count("corr(") for line in plan.splitlines()) <= models.PAIRS_TOGETHER
    assert models.correlation_matrix(df.limit(0), names).count() == 64
    assert [tuple(r) for r in models.correlation_matrix(df, ["a"]).collect()] == [("a", "a", 1.0)]


def test_a_stacked_column_that_nobody_reads_is_not_computed(spark):
    from formbook.operators.sides import stack_sides

    games = spark.range(5).selectExpr("id AS game_id", "id AS home_a", "-id AS away_a", "exp(id) AS home_b", "exp(-id) AS away_b")
    sides = stack_sides(games, ["game_id"], {"a": ("home_a", "away_a"), "b": ("home_b", "away_b")})
    assert sorted(tuple(r) for r in sides.collect())[:2] == [(0, "away", 0, 1.0), (0, "home", 0, 1.0)]
    assert "EXP" not in sides.select("a")._jdf.queryExecution().executedPlan().toString().upper().replace("EXPLODE", "")
