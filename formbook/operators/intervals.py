"""Counts for a list of interval conditions, however long, in one pass over the rows.

The ends of all conditions cut each column into points and gaps. Every row is placed by a
balanced comparison, log(ends) deep, and rows are folded to one per cell before
conditions are looked at, so work on rows does not grow with the number of conditions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.durable import written


@dataclass(frozen=True)
class Box:
    """What to call a condition (column name to SQL literal), the closed ends per column (None is open), and values that
    columns must exceed."""

    labels: Mapping[str, str]
    ends: Mapping[str, tuple[float | None, float | None]]
    above: Mapping[str, float] = field(default_factory=dict)


def place_sql(column: str, ends: Sequence[float]) -> str:
    """2k + 1 at the k-th of the rising ``ends``, 2k in the gap before it; NULL for NULL."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return f"IF({column} = {ends[low]!r}D, {2 * low + 1}, {2 * low})" if low < len(ends) else f"{2 * low}"
        middle = (low + high) // 2
        return f"IF({column} <= {ends[middle]!r}D, {tree(low, middle)}, {tree(middle + 1, high)})"

    return f"IF({column} IS NULL, NULL, {tree(0, len(ends))})"


def _code(ends: Sequence[float], value: float | None) -> str:
    return "CAST(NULL AS INT)" if value is None else str(2 * bisect_left(ends, value) + 1)


def _all_ends(boxes: Sequence[Box]) -> dict[str, list[float]]:
    """The rising ends of all conditions, per column."""
    columns = sorted({c for b in boxes for c in (*b.ends, *b.above)})
    asked = {c: [v for b in boxes for v in (*b.ends.get(c, ()), b.above.get(c)) if v is not None] for c in columns}
    return {c: sorted({float(v) for v in values}) for c, values in asked.items()}


def _inside(boxes: Sequence[Box], ends: Mapping[str, Sequence[float]]) -> str:
    """SQL of the numbers of the boxes that a cell with codes ``_<column>`` is in."""
    limits = []
    for i, box in enumerate(boxes):
        codes = []
        for c, cuts in ends.items():
            low, high = (_code(cuts, v) for v in box.ends.get(c, (None, None)))
            if c in box.above:
                beyond = f"{_code(cuts, box.above[c])} + 1"
                low = beyond if low.startswith("CAST") else f"greatest({low}, {beyond})"
            codes.append(f"'{c}_low', {low}, '{c}_high', {high}")
        limits.append(f"named_struct('box', {i}, {', '.join(codes)})")
    tests = " AND ".join(f"(b.{c}_low IS NULL OR _{c} >= b.{c}_low) AND (b.{c}_high IS NULL OR _{c} <= b.{c}_high)" for c in ends)
    return f"transform(filter(array({', '.join(limits)}), b -> {tests}), b -> b.box)"


def _named(boxes: Sequence[Box], spark) -> DataFrame:
    """``_box`` and its labels, one row per box."""
    rows = ", ".join(f"named_struct('_box', {i}, " + ", ".join(f"'{k}', {v}" for k, v in b.labels.items()) + ")" for i, b in enumerate(boxes))
    return spark.range(1).selectExpr(f"inline(array({rows}))")


def count_boxes(rows: DataFrame, boxes: Sequence[Box], period: Sequence[str], outcome: str = "cash") -> DataFrame:
    """The labels, ``n, hits, misses`` and ``periods`` of each box.

    ``n`` counts rows of the box whose outcome is known, hits and misses those with 1 and -1; a missing value passes
    no end. ``periods`` is the number of different ``period`` values of all rows.
    """
    ends = _all_ends(boxes)
    columns = list(ends)
    cells = (
        rows.selectExpr(*period, outcome, *[f"{place_sql(c, ends[c])} AS _{c}" for c in columns])
        .groupBy(*period, *[f"_{c}" for c in columns])
        .agg(
            F.count(outcome).alias("n"),
            F.count_if(F.col(outcome) == 1).alias("hits"),
            F.count_if(F.col(outcome) == -1).alias("misses"),
        )
    )
    inside = _inside(boxes, ends)
    # Box -1 holds every row. Boxes without a row are entered once more, with nothing.
    spark, sums = rows.sparkSession, ("n", "hits", "misses")
    nothing = spark.range(-1, len(boxes)).selectExpr("CAST(id AS INT) AS _box", *[f"0L AS {c}" for c in (*sums, "_periods")])
    counted = (
        cells.selectExpr(*period, "n", "hits", "misses", f"explode(concat({inside}, array(-1))) AS _box")
        .groupBy("_box")
        .agg(*[F.sum(c).alias(c) for c in sums], F.count_distinct(*period).alias("_periods"))
        .unionByName(nothing)
        .groupBy("_box")
        .agg(*[F.sum(c).alias(c) for c in (*sums, "_periods")])
        .withColumn("periods", F.max(F.when(F.col("_box") == -1, F.col("_periods"))).over(Window.partitionBy()))
    )
    return _named(boxes, spark).join(counted.drop("_periods"), "_box").drop("_box")


def moment_boxes(rows: DataFrame, boxes: Sequence[Box], period: Sequence[str], value: str) -> DataFrame:
    """The labels, ``n, mean, m2, m3, m4`` of ``value`` in each box, and ``everybody`` (its mean over all rows) and ``periods``.

    ``m2`` to ``m4`` are sums of powers of the distance from the box's mean. A cell has those around its own
    mean; they are moved to the box's mean before they are added, so no large sums are subtracted from each other. Cells are
    written, because a box's mean comes before its sums.
    """
    ends = _all_ends(boxes)
    v = F.col(value).cast("double")
    n, var = F.count(v).alias("n"), F.coalesce(F.var_pop(v), F.lit(0.0))
    skew, excess = F.coalesce(F.skewness(v), F.lit(0.0)), F.coalesce(F.kurtosis(v), F.lit(-3.0))
    placed = rows.select(*period, value, *[F.expr(place_sql(c, cuts)).alias(f"_{c}") for c, cuts in ends.items()])
    sums = placed.groupBy(*period, *[f"_{c}" for c in ends]).agg(
        n, F.avg(v).alias("mean"), (F.count(v) * var).alias("m2"), F.when(var > 0, F.count(v) * skew * F.pow(var, 1.5)).otherwise(0.0).alias("m3"),
        F.when(var > 0, F.count(v) * (excess + 3) * var * var).otherwise(0.0).alias("m4"),
    )
    cells = written(sums.selectExpr(*period, "n", "mean", "m2", "m3", "m4", f"explode(concat({_inside(boxes, ends)}, array(-1))) AS _box"))
    spark = rows.sparkSession
    centres = cells.groupBy("_box").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"), F.count_distinct(*period).alias("_periods"))
    centres = written(centres)
    moved = cells.filter("_box >= 0 AND n > 0").join(F.broadcast(centres), "_box").withColumn("d", F.col("mean") - F.col("_mean"))
    added = moved.groupBy("_box").agg(
        F.sum("n").alias("n"),
        F.max("_mean").alias("mean"),
        F.expr("sum(m2 + n * d * d) AS m2"),
        F.expr("sum(m3 + 3 * d * m2 + n * d * d * d) AS m3"),
        F.expr("sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d) AS m4"),
    )
    everybody = centres.filter("_box = -1")
    return (
        _named(boxes, spark)
        .join(added, "_box", "left")
        .drop("_box")
        .withColumns({"n": F.coalesce("n", F.lit(0)), "everybody": everybody.select("_mean").scalar(), "periods": F.coalesce(everybody.select("_periods").scalar(), F.lit(0))})
    )
