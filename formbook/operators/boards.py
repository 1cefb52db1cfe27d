"""Totals of all history rows inside the boxes of a board of few probes.

The ends of the board's boxes cut both dimensions. Every history row falls into one cell between cuts, found by a
binary search; rows are folded to one per cell, and a two-dimensional prefix sum over the cells answers
a box by its four corners. History is read and shuffled once, nothing is written, and no pair of row and box is formed. The
table of cells grows with the square of the board, so beyond a measured number of cells ``band_totals`` answers
instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.operators.bands import Band, band_totals

#: Cells up to which a board is answered by prefix sums.
MOST_CELLS = 4_000_000


def _cuts(boxes: DataFrame, low: str, high: str) -> DataFrame:
    """One row: the different cuts in order. A low end cuts below its value, a high end above it."""
    ends = F.array(F.struct(F.col(low).alias("at"), F.lit(0).alias("closed")), F.struct(F.col(high).alias("at"), F.lit(1).alias("closed")))
    return boxes.select(F.explode(ends).alias("cut")).agg(F.sort_array(F.collect_set("cut")).alias("cuts"))


def _cell(value: str, cuts: str) -> Column:
    """How many of the cuts lie below ``value``, by halving."""
    return F.expr(
        f"aggregate(sequence(0, length(bin(size({cuts})))), named_struct('lo', 0, 'hi', size({cuts})), "
        "(span, step) -> CASE WHEN span.lo >= span.hi THEN span "
        f"WHEN {value} > {cuts}[(span.lo + span.hi) div 2].at "
        f"OR ({value} = {cuts}[(span.lo + span.hi) div 2].at AND {cuts}[(span.lo + span.hi) div 2].closed = 0) "
        "THEN named_struct('lo', CAST((span.lo + span.hi) div 2 + 1 AS INT), 'hi', span.hi) "
        "ELSE named_struct('lo', span.lo, 'hi', CAST((span.lo + span.hi) div 2 AS INT)) END).lo"
    )


def board_totals(
    history: DataFrame,
    probes: DataFrame,
    key: Sequence[str],
    bands: Sequence[Band],
    measures: Sequence[str],
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """What ``band_totals`` returns, for two bands and probes of which there are few."""
    first, second = bands
    totals = ["n", *measures]
    keys = [f"_k{i}" for i in range(len(key))]
    ends = [("_x_lo", "_x_hi"), ("_y_lo", "_y_hi")]
    boxes = probes.selectExpr(
        *[f"{k} AS {alias}" for k, alias in zip(key, keys)],
        *[f"CAST({sql} AS DOUBLE) AS {name}" for band, names in zip(bands, ends) for sql, name in zip((band.low, band.high), names)],
    ).filter("_x_lo <= _x_hi AND _y_lo <= _y_hi").distinct()
    counted = boxes.agg(*[F.count_distinct(c).alias(c) for names in ends for c in names]).first()
    across, down = (sum(counted[c] for c in names) + 1 for names in ends)  # cells per dimension
    if across * down > most_cells:
        return band_totals(history, probes, key, bands, measures)
    cuts = {"_x_cuts": _cuts(boxes, *ends[0]).scalar(), "_y_cuts": _cuts(boxes, *ends[1]).scalar()}

    points = (
        history.selectExpr(f"CAST({first.column} AS DOUBLE) AS _x", f"CAST({second.column} AS DOUBLE) AS _y", *[f"CAST({m} AS BIGINT) AS {m}" for m in measures])
        .dropna(subset=["_x", "_y"])
        .groupBy("_x", "_y")
        .agg(F.expr("count(1) AS n"), *[F.expr(f"coalesce(sum({m}), 0L) AS {m}") for m in measures])
    )
    cells = points.withColumns(cuts).select(_cell("_x", "_x_cuts").alias("_i"), _cell("_y", "_y_cuts").alias("_j"), *totals)
    grid = history.sparkSession.range(across * down).selectExpr(f"CAST(id div {down} AS INT) AS _i", f"CAST(id % {down} AS INT) AS _j", *[f"0L AS {t}" for t in totals])
    dense = cells.union(grid).groupBy("_i", "_j").agg(*[F.sum(t).alias(t) for t in totals])
    for along, other in (("_i", "_j"), ("_j", "_i")):
        upto = f"OVER (PARTITION BY {other} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        dense = dense.selectExpr("_i", "_j", *[f"sum({t}) {upto} AS {t}" for t in totals])

    def place(end: str, closed: int, cuts_: str) -> str:
        return f"CAST(array_position({cuts_}, named_struct('at', {end}, 'closed', {closed})) - 1 AS INT)"

    corners = ", ".join(
        f"named_struct('_i', {place(x, i, '_x_cuts')}, '_j', {place(y, j, '_y_cuts')}, '_sign', {1 if i == j else -1}L)"
        for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1])
    )
    asked = boxes.withColumns(cuts).selectExpr(*keys, f"inline(array({corners}))")
    return (
        asked.join(dense, ["_i", "_j"])
        .groupBy(*keys)
        .agg(*[F.expr(f"sum(_sign * {t}) AS {t}") for t in totals])
        .filter("n > 0")
        .withColumnsRenamed(dict(zip(keys, key)))
    )
