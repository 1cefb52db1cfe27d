"""Totals of all history rows inside a box around each probe.

The textbook form, a join on ``h.x BETWEEN p.lo AND p.hi`` in two dimensions,
produces every matching pair: quadratic in the history. Here no pair is ever
formed. All dimensions but the last are ranked, and every history row is
entered in the ranges of 1, 2, 4, 8 ... consecutive ranks that hold it. Any
interval of ranks is the union of at most two such ranges per size, so a probe asks
only a handful of ranges, and within a range the last dimension is
answered by the difference of two running totals. The work is
n log n whatever the distribution, and a value shared by a third of
the rows is folded to one row before anything is shuffled by value.

With three dimensions and more, where the ranks of all but the last make a grid of bounded size, one sweep along the last
answers instead (``sweeps.py``), with the same result: every point and end then travels once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.cumulative import running_totals
from formbook.operators.durable import written
from formbook.operators.sides import stack_rows
from formbook.operators.sweeps import MOST_CELLS, swept_totals

HIGHEST = 1.7e308


@dataclass(frozen=True)
class Band:
    """One dimension of the box: a history column and the probe's two inclusive ends (SQL)."""

    column: str
    low: str
    high: str


def around(column: str, threshold: str, spread: float) -> Band:
    """``threshold`` plus or minus a relative ``spread``."""
    value = f"CAST({threshold} AS DOUBLE)"
    return Band(column, f"{value} * {round(1 - spread, 12)}D", f"{value} * {round(1 + spread, 12)}D")


def _both_ends(df: DataFrame, low: str, high: str, keep: Sequence[str] = ()) -> DataFrame:
    return stack_rows(df, list(keep), {"_at": (low, high), "_closed": ("false", "true")})


def _lookup(points: DataFrame, asked: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals of ``points`` below each asked ``_at`` (``_closed``: up to and including it)."""
    group = list(group)
    extra = [f for f in asked.schema if f.name not in {*group, "_at", "_closed"}]
    stacked = points.selectExpr(
        *group,
        "_at",
        "1 AS _tie",
        *measures,
        *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in extra],
    ).unionByName(
        asked.selectExpr(
            *group,
            "_at",
            "CASE WHEN _closed THEN 2 ELSE 0 END AS _tie",
            *[f"0L AS {m}" for m in measures],
            *[f.name for f in extra],
        )
    )
    return (
        running_totals(stacked, "_at", measures, group, tie="_tie")
        .filter("_tie != 1")
        .selectExpr(
            *group,
            "_at",
            "_tie = 2 AS _closed",
            *[f.name for f in extra],
            *[f"{m}_{part}" for m in measures for part in ("run", "all")],
        )
    )


def _ranks(values: DataFrame, ends: DataFrame) -> DataFrame:
    """Rank of every distinct value and band end ``_at``: the count of distinct values below it.

    For an upper end (``_closed``) the values equal to it count as well. The table
    holds distinct values of one column only and is written out, so the joins
    with it know its size: broadcast when small, shuffled otherwise.
    """
    asked = (
        values.selectExpr("_at", "false AS _closed")
        .unionByName(_both_ends(ends, "_lo", "_hi"))
        .distinct()
    )
    found = _lookup(values.selectExpr("_at", "1L AS _one"), asked, [], ["_one"])
    return written(found.selectExpr("_at", "_closed", "_one_run AS _rank", "_one_all AS _size"))


# Exponents 0, 1, 2 ... of the range sizes that can fit into all ranks.
_DEPTHS = "explode(sequence(0, length(bin(_size)) - 1)) AS _depth"


def _range_number(first: str) -> str:
    """One number for a range of 2**_depth ranks; ``first`` counts ranges of that size."""
    return f"shiftleft(CAST(_depth AS BIGINT), 48) | {first}"


def _span_ranges(ends: DataFrame, ranks: DataFrame) -> DataFrame:
    """The ranges that together make up each band's interval of ranks."""
    start = ranks.filter("NOT _closed").selectExpr("_at AS _lo", "_rank AS _from", "_size")
    stop = ranks.filter("_closed").selectExpr("_at AS _hi", "_rank AS _to")
    return (
        ends.join(start, "_lo")
        .join(stop, "_hi")
        .selectExpr("_lo", "_hi", "_from", "_to", _DEPTHS)
        .selectExpr(
            "_lo", "_hi", "_depth", "-shiftright(-_from, _depth) AS _first", "shiftright(_to, _depth) AS _last"
        )
        .filter("_first < _last")
        .selectExpr(
            "_lo",
            "_hi",
            "_depth",
            "explode(array_compact(array("
            "CASE WHEN _first % 2 = 1 THEN _first END, CASE WHEN _last % 2 = 1 THEN _last - 1 END))) AS _nth",
        )
        .selectExpr("_lo", "_hi", f"{_range_number('_nth')} AS _range")
    )


def _value_ranges(ranks: DataFrame, spans: DataFrame) -> DataFrame:
    """The ranges that hold each value, as far as any band asks for them."""
    holding = (
        ranks.filter("NOT _closed")
        .selectExpr("_at", "_rank", _DEPTHS)
        .selectExpr("_at", f"{_range_number('shiftright(_rank, _depth)')} AS _range")
    )
    return holding.join(spans.select("_range").distinct(), "_range", "left_semi")


def _ranked_boxes(boxes: DataFrame, place: int, ranks: DataFrame, low: str, high: str) -> DataFrame:
    """Boxes with the interval of ranks of one dimension, those that reach none left out."""
    start = ranks.filter("NOT _closed").selectExpr(f"_at AS {low}", f"_rank AS _from{place}")
    stop = ranks.filter("_closed").selectExpr(f"_at AS {high}", f"_rank AS _to{place}")
    return boxes.join(start, low).join(stop, high).filter(f"_from{place} < _to{place}").drop(low, high)


def band_totals(
    history: DataFrame,
    probes: DataFrame,
    key: Sequence[str],
    bands: Sequence[Band],
    measures: Sequence[str],
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per probe key with at least one history row in its box.

    Adds the count ``n`` and the total of every measure. ``key`` must determine
    the bands. Measures are integers, so totals and their differences are exact.
    A NULL in a band column or a band end matches nothing. Both inputs
    are read more than once: pass written tables or cheap plans. With three bands or more, up to ``most_cells``
    combinations of ranks are swept as a grid.
    """
    measures = list(measures)
    columns = [b.column for b in bands]
    totals = ["n", *measures]
    ends = {b.column: (f"_{b.column}_lo", f"_{b.column}_hi") for b in bands}
    keys = [f"_k{i}" for i in range(len(key))]

    complete = history.selectExpr(
        *[f"CAST({c} AS DOUBLE) AS {c}" for c in columns], *[f"CAST({m} AS BIGINT) AS {m}" for m in measures]
    ).dropna(subset=columns)
    boxes = probes.selectExpr(
        *[f"{k} AS {alias}" for k, alias in zip(key, keys)],
        *[f"CAST({sql} AS DOUBLE) AS {name}" for b in bands for sql, name in zip((b.low, b.high), ends[b.column])],
    ).filter(" AND ".join(f"{low} <= {high}" for low, high in ends.values()))

    # Copies are folded first: a box or a point shared by many rows travels once.
    entered = complete.groupBy(*columns).agg(
        F.expr("count(1) AS n"), *[F.expr(f"coalesce(sum({m}), 0L) AS {m}") for m in measures]
    )
    wanted = boxes.distinct()
    asked, ranks = [], []
    for band in bands[:-1]:
        low, high = ends[band.column]
        asked.append(boxes.selectExpr(f"{low} AS _lo", f"{high} AS _hi").distinct())
        ranks.append(_ranks(complete.selectExpr(f"{band.column} AS _at").distinct(), asked[-1]))
    last = bands[-1].column
    low, high = ends[last]

    if len(ranks) > 1:
        sizes = [r.agg(F.max("_size")).first()[0] or 0 for r in ranks]
        if 0 < prod(sizes) <= most_cells:
            for place, (band, rank) in enumerate(zip(bands, ranks)):
                cell = rank.filter("NOT _closed").selectExpr(f"_at AS {band.column}", f"_rank AS _from{place}")
                entered = entered.join(cell, band.column).drop(band.column)
                wanted = _ranked_boxes(wanted, place, rank, *ends[band.column])
            entered, wanted = entered.withColumnRenamed(last, "_at"), wanted.withColumnsRenamed({low: "_lo", high: "_hi"})
            found = swept_totals(entered, wanted, sizes, keys, totals)
            return found.filter("n > 0").withColumnsRenamed(dict(zip(keys, key)))

    group: list[str] = []
    for index, band in enumerate(bands[:-1]):
        spans = _span_ranges(asked[index], ranks[index])
        place = f"_range{index}"
        holding = _value_ranges(ranks[index], spans).withColumnsRenamed({"_at": band.column, "_range": place})
        entered = entered.join(holding, band.column).drop(band.column)
        wanted = wanted.join(
            spans.withColumnsRenamed(dict(zip(("_lo", "_hi"), ends[band.column])) | {"_range": place}), [*ends[band.column]]
        ).drop(*ends[band.column])
        group.append(place)

    entered = entered.groupBy(*group, F.col(last).alias("_at")).agg(*[F.expr(f"sum({t}) AS {t}") for t in totals])
    found = _lookup(entered, _both_ends(wanted, low, high, [*keys, *group]), group, totals)
    return (
        found.groupBy(*keys)
        .agg(*[F.expr(f"sum(CASE WHEN _closed THEN {t}_run ELSE -{t}_run END) AS {t}") for t in totals])
        .filter("n > 0")
        .withColumnsRenamed(dict(zip(keys, key)))
    )
