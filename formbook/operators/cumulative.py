"""Running totals that no single task has to carry.

A window ordered by value over one group sorts that whole group in one task. Here all rows are
dealt by ranges of (group, value) whose ends Spark takes from a sample of the rows themselves, so
ranges hold about as many rows each however close, far or alike the values are. Each range is summed up
on its own and starts from the total of the group's ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.durable import written


def in_blocks(df: DataFrame, value: str, group: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """``df`` written once, dealt by ranges of group, value and tie; ``_block`` numbers the ranges in their order.

    Rows alike in all three are ordered by a hash of the row, so a value that a third of all rows
    share is cut as well. The hash depends on the row alone: a task that runs again deals alike.
    """
    order = [*group, value, *([tie] if tie else []), F.xxhash64(*df.columns)]
    return written(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    group: Sequence[str] = (),
    tie: str | None = None,
) -> DataFrame:
    """Add ``<m>_run`` (total up to and including the row) and ``<m>_all`` (group total).

    Rows are ordered by ``value`` then ``tie`` within ``group``: NULL first, then minus infinity, numbers, infinity
    and NaN, as Spark sorts them. Only the last window sees rows, a block at a time; the others run over block
    totals, of which a group has as many as there are ranges at most. What lies below a block enters
    it as one more row in front, so no join is needed.
    """
    group = list(group)
    block = [*group, "_block"]
    keyed = in_blocks(df, value, group, tie)
    whole = f"PARTITION BY {', '.join(group)}" if group else ""
    below = f"{whole} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    fronts = (
        keyed.groupBy(*block)
        .agg(*[F.expr(f"sum({m}) AS _{m}") for m in measures])
        .selectExpr(
            *block,
            "0 AS _place",
            *[f"coalesce(sum(_{m}) OVER ({below}), 0) AS {m}" for m in measures],
            *[f"sum(_{m}) OVER ({whole}) AS {m}_all" for m in measures],
        )
    )
    order = f"_place, {value}" if tie is None else f"_place, {value}, {tie}"
    frame = f"PARTITION BY {', '.join(block)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return (
        keyed.selectExpr("*", "1 AS _place")
        .unionByName(fronts, allowMissingColumns=True)
        .selectExpr(
            *df.columns,
            "_place",
            *[f"sum({m}) OVER ({frame}) AS {m}_run" for m in measures],
            *[f"max({m}_all) OVER ({frame}) AS {m}_all" for m in measures],
        )
        .filter("_place = 1")
        .drop("_place")
    )
