"""Small linear regressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.expr import linear_score
from formbook.operators.sides import stack_rows


@dataclass(frozen=True)
class LinearFit:
    """Intercept and one weight per term; ``a:b`` is the product of two columns."""

    target: str
    intercept: float
    weights: dict[str, float]
    r2: float
    n: int
    zero_fill: bool = False

    def score(self) -> Column:
        """The prediction as an expression, so scoring stays inside the scan's own stage."""
        plain = {c for term in self.weights for c in term.split(":")}
        columns = {c: f"coalesce({c}, 0D)" for c in plain} if self.zero_fill else None
        return linear_score({"intercept": self.intercept, **self.weights}, columns)

    def table(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        """One row per coefficient."""
        rows = [("intercept", self.intercept), *self.weights.items()]
        rows = [(t, float(c) if digits is None else round(float(c), digits)) for t, c in rows]
        return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def fit_linear(df: DataFrame, target: str, terms: Sequence[str], zero_fill: bool = False) -> LinearFit:
    """Ordinary least squares from the covariances of terms and target.

    One aggregation over the data returns one row of moments; only the k-by-k system is
    solved on the driver. Rows with a NULL are left out, or their NULLs read as 0
    with ``zero_fill``.
    """
    plain = sorted({c for term in terms for c in term.split(":")})
    data = df.selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" for c in dict.fromkeys([*plain, target])])
    data = data.fillna(0.0) if zero_fill else data.dropna()
    sql = [" * ".join(term.split(":")) for term in terms] + [target]
    k = len(terms)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    moments = data.agg(
        F.expr("count(1) AS n"),
        *[F.expr(f"avg({x}) AS m{i}") for i, x in enumerate(sql)],
        *[F.expr(f"covar_pop({sql[i]}, {sql[j]}) AS c{i}_{j}") for i, j in pairs],
    ).first()
    if not moments["n"]:
        raise ValueError("no complete row to fit")
    cov = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = moments[f"c{i}_{j}"]
    means = np.array([moments[f"m{i}"] for i in range(k + 1)])
    weights = np.linalg.lstsq(cov[:k, :k], cov[:k, k], rcond=None)[0]
    r2 = float(weights @ cov[:k, k] / cov[k, k]) if cov[k, k] > 0 else 1.0
    intercept = float(means[k] - weights @ means[:k])
    return LinearFit(target, intercept, dict(zip(terms, map(float, weights))), r2, int(moments["n"]), zero_fill)


@dataclass(frozen=True)
class Model:
    """A regression to fit along with others: ``a:b`` is the product of two columns; rows with a NULL in a column
    of it, or in one of ``needs``, are left out of this model only."""

    target: str
    terms: tuple[str, ...]
    needs: tuple[str, ...] = ()

    def values(self) -> list[Column]:
        """Terms and target, NULL in rows that the model leaves out."""
        plain = dict.fromkeys([c for term in self.terms for c in term.split(":")] + [self.target, *self.needs])
        known = F.lit(True)
        for c in plain:
            known = known & F.col(f"`{c}`").isNotNull()

        def value(term: str) -> Column:
            factors = [F.col(f"`{c}`").cast("double") for c in term.split(":")]
            return F.when(known, reduce(lambda a, b: a * b, factors))

        return [value(t) for t in (*self.terms, self.target)]


def _solved(m: int, model: Model, moments: DataFrame, group: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Gauss-Jordan elimination of one model's normal equations as column expressions, one step per term. A term that does
    not vary beside the ones before it has weight 0."""
    k, at = len(model.terms), lambda i, j: f"c{m}_{min(i, j)}_{max(i, j)}"
    kept = [*group, *rest, f"n{m}", *[f"m{m}_{i}" for i in range(k + 1)], *[at(i, k) for i in range(k + 1)], *[at(i, i) for i in range(k)]]
    kept = list(dict.fromkeys(kept))
    rows = moments.select(*kept, *[F.col(at(i, j)).alias(f"a{i}_{j}") for i in range(k) for j in range(k + 1)])
    for p in range(k):
        pivot = F.col(f"a{p}_{p}")
        varies = pivot > F.col(at(p, p)) * 1e-12
        row = {j: F.when(varies, F.col(f"a{p}_{j}") / pivot).otherwise(F.lit(0.0)) for j in range(p + 1, k + 1)}
        rows = rows.select(
            *kept,
            *[(row[j] if i == p else F.col(f"a{i}_{j}") - F.when(varies, F.col(f"a{i}_{p}") * row[j]).otherwise(0.0)).alias(f"a{i}_{j}") for i in range(k) for j in range(p + 1, k + 1)],
        )
    weights = [F.when(F.col(f"n{m}") > 0, F.col(f"a{i}_{k}")) for i in range(k)]
    intercept = F.col(f"m{m}_{k}")
    explained = F.lit(0.0)
    for i, w in enumerate(weights):
        intercept, explained = intercept - w * F.col(f"m{m}_{i}"), explained + w * F.col(at(i, k))
    fit = F.struct(
        F.lit(model.target).alias("target"),
        F.lit(",".join(model.terms)).alias("terms"),
        F.col(f"n{m}").alias("n"),
        F.when(F.col(at(k, k)) > 0, explained / F.col(at(k, k))).when(F.col(f"n{m}") > 0, F.lit(1.0)).alias("r2"),
        intercept.alias("intercept"),
        F.array(*weights).alias("weights"),
    )
    return rows.select(*group, *rest, fit.alias(f"_fit{m}"))


def fit_models(df: DataFrame, models: Sequence[Model], group: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares of several models for every group, in one pass over ``df``.

    One aggregation holds counts, means and cross products of all models, each under its own mask; Spark merges them in a
    stable way, so a group may be of any size. The systems are solved where the moments are: one row per group, no
    row of a group reaches the driver. Returns ``group, target, terms, n, r2, intercept, weights`` (in the order
    of the terms; NULL without a row), a row per group and model.
    """
    values = {f"v{m}_{i}": v for m, model in enumerate(models) for i, v in enumerate(model.values())}
    rows = df.select(*group, *[v.alias(name) for name, v in values.items()])
    sums = []
    for m, model in enumerate(models):
        names = [f"v{m}_{i}" for i in range(len(model.terms) + 1)]
        sums += [F.count(names[-1]).alias(f"n{m}"), *[F.avg(v).alias(f"m{m}_{i}") for i, v in enumerate(names)]]
        sums += [F.covar_pop(v, names[j]).alias(f"c{m}_{i}_{j}") for i, v in enumerate(names) for j in range(i, len(names))]
    solved, rest = rows.groupBy(*group).agg(*sums), []
    for m, model in enumerate(models):
        later = [c for c in solved.columns if c not in group and c not in rest and not c[1:].split("_")[0] == str(m)]
        solved = _solved(m, model, solved, group, [*rest, *later])
        rest.append(f"_fit{m}")
    return solved.select(*group, F.inline(F.array(*rest)))


def simple_fit(df: DataFrame, target: str, regressor: str) -> DataFrame:
    """Slope, intercept and R-squared of one regressor, in one aggregation."""
    y, x = F.col(f"`{target}`").cast("double"), F.col(f"`{regressor}`").cast("double")
    return df.agg(
        F.lit(target).alias("target"),
        F.lit(regressor).alias("regressor"),
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def prediction_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error and root mean squared error."""
    miss = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"))


#: Correlations in one aggregation. The code Spark makes for many more most likely outgrows what the JVM compiles:
#: on 8 million rows 14 took 2.6 s and 28 took 22 s.
PAIRS_TOGETHER = 7


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as (row, col, r); one pass over the data.

    A row enters once for every ``PAIRS_TOGETHER`` pairs, as a group of its own.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = [pairs[i : i + PAIRS_TOGETHER] for i in range(0, len(pairs), PAIRS_TOGETHER)]
    values = {"_part": [str(p) for p in range(len(parts))]}
    for i in range(min(PAIRS_TOGETHER, len(pairs))):
        for place in (0, 1):
            values[f"_{'xy'[place]}{i}"] = [
                f"CAST(`{part[i][place]}` AS DOUBLE)" if i < len(part) else "CAST(NULL AS DOUBLE)" for part in parts
            ]
    stacked = stack_rows(df, [], values) if pairs else df.selectExpr("0 AS _part")
    found = stacked.groupBy("_part").agg(*[F.corr(f"_x{i}", f"_y{i}").alias(f"r{i}") for i in range(len(values) // 2)] or [F.count("*")])
    one = found.agg(
        F.count("*").alias("parts"),
        *[F.max(F.when(F.col("_part") == p, F.col(f"r{i}"))).alias(f"{a}|{b}") for p, part in enumerate(parts) for i, (a, b) in enumerate(part)],
    )

    def cell(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0)
        name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
        return F.col(f"`{name}`")

    cells = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), cell(a, b).alias("r")) for a in columns for b in columns
    ]
    return one.select(F.inline(F.array(*cells)))
