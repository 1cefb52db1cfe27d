"""Scalar rules shared by every plan.

A missing value is SQL NULL throughout. NaN is never produced, because Spark
orders it above every number and treats it as equal to itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual market line on made kicks, points per made kick used
# in the expectation, the two blend weights and the fitted points model.
OVER_LINE = 1.5
POINTS_PER_KICK = 3.8
OWN_WEIGHT = 0.35
OPPONENT_WEIGHT = 0.65
POINTS_MODEL = {
    "intercept": 3.96760,
    "xppg": 0.40388,
    "adj_exp_att": 1.11950,
    "kick_pct": 2.24413,
    "adj_exp_att:kick_pct": -0.66712,
}

# Points of a made kick by distance bucket.
BUCKET_POINTS = {
    "fg_made_0_19": 3,
    "fg_made_20_29": 3,
    "fg_made_30_39": 3,
    "fg_made_40_49": 4,
    "fg_made_50_59": 5,
    "fg_made_60_": 5,
}
FLAT_POINTS = 3


def ratio_sql(numerator: str, denominator: str) -> str:
    """SQL text of :func:`safe_ratio`, for use inside larger expressions."""
    den = f"CAST({denominator} AS DOUBLE)"
    # try_divide: a shared sub-expression may be evaluated ahead of the CASE that guards it.
    return f"(CASE WHEN {den} = 0 THEN 0D ELSE try_divide(CAST({numerator} AS DOUBLE), {den}) END)"


def safe_ratio(numerator: str, denominator: str) -> Column:
    """``numerator / denominator``; 0 when the denominator is 0, NULL when it is NULL.

    Arguments are column names or SQL expressions.
    """
    return F.expr(ratio_sql(numerator, denominator))


def over_line_sql(made: str, line: float = OVER_LINE) -> str:
    return f"(CASE WHEN {made} > {line}D THEN 1 WHEN {made} <= {line}D THEN -1 END)"


def over_line(made: str, line: float = OVER_LINE) -> Column:
    """+1 above the line, -1 at or below it, NULL while the outcome is unknown."""
    return F.expr(over_line_sql(made, line))


def bucket_points(available: Sequence[str], extra: str = "pat_made", made: str = "fg_made") -> Column:
    """Points of a kicking row.

    With all six distance buckets present each bucket has its own value;
    otherwise every made kick counts the same.
    """
    if set(BUCKET_POINTS) <= set(available):
        worth = BUCKET_POINTS
    else:
        worth = {made: FLAT_POINTS}
    terms = [f"coalesce({name}, 0) * {value}" for name, value in worth.items()]
    return F.expr(" + ".join([f"coalesce({extra}, 0)", *terms]))


def distance_list_points(text: str, max_kicks: int | None = None) -> Column:
    """Points of a ``;``-separated list of made distances, without extra points.

    The tens digit decides: below 40 yards 3, from 40 to 49 4, from 50 on 5.
    Text that is not a number adds nothing. ``max_kicks=8`` counts only the
    first eight entries, as a fixed eight-column split would.
    """
    parts = f"split({text}, ';')"
    if max_kicks is not None:
        parts = f"slice({parts}, 1, {int(max_kicks)})"
    tens = f"transform({parts}, kick -> try_cast(left(kick, length(kick) - 1) AS INT))"
    worth = "CASE WHEN tens IN (1, 2) THEN 3 WHEN tens >= 6 THEN 5 ELSE coalesce(tens, 0) END"
    return F.expr(f"coalesce(aggregate({tens}, 0, (total, tens) -> total + {worth}), 0)")


def linear_score_sql(coefficients: Mapping[str, float], columns: Mapping[str, str] | None = None) -> str:
    """Intercept plus weighted terms; ``a:b`` is the product of two terms."""
    columns = columns or {}
    score = f"{float(coefficients.get('intercept', 0.0))!r}D"
    for name, weight in coefficients.items():
        if name == "intercept":
            continue
        factors = "".join(f" * {columns.get(f, f)}" for f in name.split(":"))
        score += f" + {float(weight)!r}D{factors}"
    return f"({score})"


def linear_score(coefficients: Mapping[str, float], columns: Mapping[str, str] | None = None) -> Column:
    return F.expr(linear_score_sql(coefficients, columns))


def relative_band(value: str, threshold: float, spread: float) -> Column:
    """Within ``spread`` of the threshold on either side, both ends included."""
    return F.col(value).between(threshold * round(1 - spread, 12), threshold * round(1 + spread, 12))
