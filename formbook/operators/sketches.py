"""Approximate quantiles from mergeable sketches.

A sketch of a few kilobytes stands for the values of one group of any size. Sketches are stored, and those of
several groups (the weeks of a period, say) merge into one without looking at the values again. The price is
an error in rank, about 1.3 % of the rows at the default size; exact answers are in ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a sketch's largest level: the error in rank falls in proportion.
SKETCH_SIZE = 200


def quantile_sketches(df: DataFrame, value: str, group: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``group`` and ``sketch``; NULLs are skipped, a group without a value has no row."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged_quantiles(
    sketches: DataFrame, quantiles: Mapping[str, float], group: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """``group``, ``n`` and a value for each of ``quantiles``, from sketches of finer groups."""
    merged = sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in quantiles.items()]
    return merged.select(*group, F.kll_sketch_get_n_double("sketch").alias("n"), *picks)


def rank_errors(df: DataFrame, value: str, estimates: DataFrame, quantiles: Mapping[str, float], group: Sequence[str]) -> DataFrame:
    """``group, quantile, n, error``: by how much of all rows each estimate misses the rank it was asked for.

    Equal values share a range of ranks; an estimate inside it misses by nothing."""
    asked = estimates.select(
        *group, F.inline(F.array(*[F.struct(F.lit(name).alias("quantile"), F.lit(float(p)).alias("p"), F.col(name).alias("estimate")) for name, p in quantiles.items()]))
    )
    known = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    counted = known.groupBy(*group, "_v").agg(F.count("*").alias("_n"))  # copies are folded before they meet the estimates
    ranks = (
        counted.join(asked, list(group))
        .groupBy(*group, "quantile", "p")
        .agg(
            F.sum("_n").alias("n"),
            F.sum(F.when(F.col("_v") < F.col("estimate"), F.col("_n")).otherwise(0)).alias("_below"),
            F.sum(F.when(F.col("_v") <= F.col("estimate"), F.col("_n")).otherwise(0)).alias("_upto"),
        )
    )
    miss = F.greatest(F.col("_below") / F.col("n") - F.col("p"), F.col("p") - F.col("_upto") / F.col("n"), F.lit(0.0))
    return ranks.select(*group, "quantile", "n", miss.alias("error"))
