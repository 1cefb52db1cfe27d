"""Totals of all history rows inside boxes of several dimensions, by one sweep along the last.

The ranks of all dimensions but the last make a grid of cells. History points and both ends of every box are sorted
by the last dimension together and dealt by ranges of it, so a point and an end travel once, where ranges of
ranks (``bands.py``) enter them a logarithm of times per dimension. A task passes over its range in short steps and
holds no more than the grid's totals so far: an end is answered by the corners of the grid's prefix sums, and by
comparison with the points of its own step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.cumulative import in_blocks
from formbook.operators.sides import stack_rows

#: Cells up to which a grid is swept; a task holds a few numbers per cell and measure.
MOST_CELLS = 1_000_000


def _answering(
    sizes: Sequence[int], totals: Sequence[str], keys: Sequence[str]
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does: both ends of every box with the totals below them, those of low ends negative.

    Rows come in order, block by block. The function and its helpers are nested, so they travel with the plan and workers need not
    have this package.
    """
    step = max(256, 4 * int(np.prod(sizes) ** 0.5))
    axes = range(len(sizes))

    def prefix_sums(grid: np.ndarray) -> np.ndarray:
        """Totals of all cells before each corner; the first axis holds the measures."""
        sums = np.zeros((len(totals), *[n + 1 for n in sizes]), np.int64)
        inner = sums[(slice(None), *[slice(1, None) for _ in axes])]
        np.cumsum(grid, axis=1, out=inner)
        for axis in axes[1:]:
            np.cumsum(inner, axis=axis + 1, out=inner)
        return sums

    def passed(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = np.zeros((len(low), len(totals)), np.int64)
        for ends in product((0, 1), repeat=len(sizes)):
            corner = tuple((high if end else low)[:, i] for i, end in enumerate(ends))
            found += (-1) ** (len(ends) - sum(ends)) * prefix[(slice(None), *corner)].T
        return found

    def near(points: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        below = points[None, :] < ends[:, None]
        for i in axes:
            cell = low[points, i][None, :]
            below &= (cell >= low[ends, i][:, None]) & (cell < high[ends, i][:, None])
        return below.astype(np.int64) @ values[points]

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grid, prefix = None, None, None
        for batch in batches:
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in keys}
            low, high = (np.stack([column[f"_{end}{i}"] for i in axes], axis=1) for end in ("from", "to"))
            values = np.stack([column[t] for t in totals], axis=1)
            sign, blocks = column["_sign"], column["_block"]
            found = np.zeros_like(values)
            cuts = sorted({*range(0, len(sign), step), *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(sign)})
            for start, stop in zip(cuts, cuts[1:]):
                if blocks[start] != block:
                    block, grid, prefix = blocks[start], np.zeros((len(totals), *sizes), np.int64), None
                here = np.arange(start, stop)
                points, ends = here[sign[start:stop] == 0], here[sign[start:stop] != 0]
                if len(ends):
                    prefix = prefix_sums(grid) if prefix is None else prefix
                    answer = passed(prefix, low[ends], high[ends]) + near(points, ends, low, high, values)
                    found[ends] = answer * sign[ends][:, None]
                if len(points):
                    for i in range(len(totals)):
                        np.add.at(grid[i], tuple(low[points].T), values[points, i])
                    prefix = None
            asked = sign != 0
            own = [batch.column(k).filter(pa.array(asked)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array(found[asked, i]) for i in range(len(totals))]], names=[*keys, *totals]
            )

    return answered


def swept_totals(
    points: DataFrame, boxes: DataFrame, sizes: Sequence[int], keys: Sequence[str], totals: Sequence[str]
) -> DataFrame:
    """Totals of the points inside each box, a row per key.

    ``points`` has its ranks as ``_from0``, ``_from1`` ..., the last dimension as ``_at``, and ``totals``; ``boxes`` has the
    ranks it reaches from and up to as ``_from0``, ``_to0`` ..., both ends of the last dimension as ``_lo`` and ``_hi``, and the
    keys. ``sizes`` are the numbers of ranks.
    """
    low, high = [f"_from{i}" for i in range(len(sizes))], [f"_to{i}" for i in range(len(sizes))]
    types = {f.name: f.dataType.simpleString() for f in boxes.schema}
    nothing = [f"CAST(NULL AS {types[k]}) AS {k}" for k in keys]
    ends = stack_rows(boxes, [*keys, *low, *high], {"_at": ("_lo", "_hi"), "_tie": ("0", "2"), "_sign": ("-1", "1")})
    stacked = points.selectExpr(
        *nothing, *low, *[f"CAST(0 AS BIGINT) AS {c}" for c in high], "_at", "1 AS _tie", "0 AS _sign", *totals
    ).unionByName(ends.selectExpr("*", *[f"CAST(0 AS BIGINT) AS {t}" for t in totals]))
    dealt = in_blocks(stacked, "_at", tie="_tie")
    last = dealt.agg(F.max("_block")).first()[0] or 0
    # What lies in a cell before a block enters it as one more row in front. A cell's total stands until the next block that adds to it.
    following = "PARTITION BY " + ", ".join(low) + " ORDER BY _block"
    fronts = (
        dealt.filter("_sign = 0")
        .groupBy(*low, "_block")
        .agg(*[F.expr(f"sum({t}) AS {t}") for t in totals])
        .selectExpr(
            *low,
            "_block + 1 AS _next",
            f"lead(_block, 1, {last}) OVER ({following}) AS _until",
            *[f"sum({t}) OVER ({following} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {t}" for t in totals],
        )
        .filter("_next <= _until")
        .selectExpr(*low, *totals, "explode(sequence(_next, _until)) AS _block")
        .selectExpr(
            *nothing,
            *low,
            *[f"CAST(0 AS BIGINT) AS {c}" for c in high],
            "CAST(NULL AS DOUBLE) AS _at",
            "1 AS _tie",
            "0 AS _sign",
            *totals,
            "_block",
            "0 AS _place",
        )
    )
    inputs = ["_block", "_sign", *low, *high, *totals, *keys]
    found = (
        dealt.selectExpr("*", "1 AS _place")
        .unionByName(fronts)
        .repartition("_block")
        .sortWithinPartitions("_block", "_place", "_at", "_tie")
        .select(*inputs)
        .mapInArrow(
            _answering(tuple(sizes), tuple(totals), tuple(keys)),
            ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{t} long" for t in totals]]),
        )
    )
    return found.groupBy(*keys).agg(*[F.expr(f"sum({t}) AS {t}") for t in totals])
