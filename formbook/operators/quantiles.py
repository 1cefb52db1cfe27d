"""Exact quantiles and summaries for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.operators.cumulative import running_totals


def _ranked(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Distinct values with their counts and running counts; copies are folded before any sort."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_sum", F.col("_value") * F.col("_n"))
    )
    return running_totals(counts, "_value", ["_n", "_sum"], group)


def _quantile(p: float) -> Column:
    """Linear interpolation between the two order statistics around (n-1)*p."""
    position = (F.col("_n_all") - 1) * F.lit(float(p))
    low = F.floor(position)
    high = F.least(low + 1, F.col("_n_all") - 1)
    first = F.col("_n_run") - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("_n_run")), F.col("_value")))

    return at(low) + F.max(position - low) * (at(high) - at(low))


def group_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles per group, NULLs skipped.

    The built-in ``percentile`` gathers a group's values in one buffer; this
    keeps them spread over blocks, so one period may hold any share of the rows.
    """
    picks = [_quantile(p).alias(name) for name, p in quantiles.items()]
    return _ranked(df, value, group).groupBy(*group).agg(*picks)


def five_number_summary(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean, maximum, sample standard deviation and row count."""
    centre = F.col("_sum_all") / F.col("_n_all")
    miss = F.col("_value") - centre
    n = F.sum("_n")
    return (
        _ranked(df, value, group)
        .groupBy(*group)
        .agg(
            n.alias("n"),
            F.min("_value").alias("min"),
            _quantile(0.25).alias("q1"),
            _quantile(0.50).alias("median"),
            F.max(centre).alias("mean"),
            _quantile(0.75).alias("q3"),
            F.max("_value").alias("max"),
            F.when(n > 1, F.sqrt(F.sum(miss * miss * F.col("_n")) / (n - 1))).alias("sd"),
        )
    )
