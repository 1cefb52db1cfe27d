"""Aggregate expressions: usable in any ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jarque_bera(values: Column | str) -> Column:
    """Jarque-Bera statistic of a numeric column, NULLs skipped.

    Spark's ``skewness`` and ``kurtosis`` are population moments and the
    latter is already in excess of 3, which is what the statistic needs.
    NULL when the values do not vary.
    """
    values = F.col(values) if isinstance(values, str) else values
    values = values.cast("double")
    spread = F.stddev_pop(values)
    return F.when(
        spread > 0,
        F.count(values) / F.lit(6.0) * (F.pow(F.skewness(values), 2) + F.pow(F.kurtosis(values), 2) / 4),
    )


def jarque_bera_sums(n: Column, m2: Column, m3: Column, m4: Column) -> Column:
    """The same statistic from a count and sums of powers of the distance from the mean. NULL when the values do not vary."""
    size, floor = n.cast("double"), F.lit(0.0)
    var = F.try_divide(m2, size)
    skew2 = F.try_divide(F.try_divide(m3, size) * F.try_divide(m3, size), var * var * var)
    excess = F.try_divide(F.try_divide(m4, size), var * var) - 3
    return F.when((n > 0) & (m2 > floor), size / 6 * (skew2 + excess * excess / 4))


def jarque_bera_signs(n: Column, hits: Column, misses: Column) -> Column:
    """The same statistic for +1 / -1 / 0 outcomes, from their counts alone.

    Every odd power of such an outcome is the outcome and every even power is
    0 or 1, so counts carry all four moments and stay exact however many rows
    were added up, in whatever order.
    """
    # try_divide throughout: common sub-expressions may be computed before the guard below.
    size = n.cast("double")
    mean = F.try_divide(hits - misses, size)
    even = F.try_divide(hits + misses, size)
    var = even - mean * mean
    third = mean - 3 * mean * even + 2 * mean * mean * mean
    fourth = even - 4 * mean * mean + 6 * mean * mean * even - 3 * mean * mean * mean * mean
    skew2 = F.try_divide(third * third, var * var * var)
    excess = F.try_divide(fourth, var * var) - 3
    return F.when((n > 0) & (var > 0), size / 6 * (skew2 + excess * excess / 4))


def chi2_2df_tail(statistic: Column) -> Column:
    """Upper tail of a chi-square with two degrees of freedom."""
    return F.exp(-statistic / 2)


def hit_rate_doubled(n: Column, profit: Column) -> Column:
    """0.5 + profit/n: the published figure, which counts the edge twice."""
    return F.try_divide(n / F.lit(2.0) + profit, n.cast("double"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of hits among decided rows."""
    return F.try_divide(hits.cast("double"), (hits + misses).cast("double"))
