"""Result writers and the reader of the published report layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from formbook.operators.durable import written
from formbook.sources.schema import THRESHOLD_REPORT


def replace_parts(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    """Write ``df`` in folders by its part columns; parts that ``df`` has no row of stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path


def write_games(games: DataFrame, path: str, partition_by: Sequence[str] = ("season",)) -> str:
    """Parquet in one folder per season; seasons that are not in ``games`` stay. Rows of a season are not forced through
    one task."""
    return replace_parts(games, path, partition_by)


def read_games(spark: SparkSession, path: str, periods: DataFrame | None = None) -> DataFrame:
    """The stored data set; with ``periods``, only what joins it on the part columns it has. Folders that no row of a filtered
    ``periods`` names are skipped when the join runs, though the plan does not know them."""
    games = spark.read.parquet(path)
    if periods is None:
        return games
    return games.join(periods, [c for c in ("season", "week") if c in periods.columns], "left_semi")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report_csv(report: DataFrame, path: str, order_by: Sequence[str]) -> str:
    """The published layout: quoted names and texts, row number first, CRLF line ends.

    Row numbers come from per-partition counts, so the sorted report stays distributed.
    Every part file starts with the header, which an empty report has too.
    """
    rows = numbered_rows(report, order_by)
    texts = {"_row", *[f.name for f in report.schema if isinstance(f.dataType, StringType)]}

    def cell(name: str) -> Column:
        text = F.col(name).cast("string")
        if name in texts:
            text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(text, F.lit("NA"))

    header = ",".join(f'"{n}"' for n in ["", *report.columns])
    line = F.concat_ws(",", *[cell(c) for c in ["_row", *report.columns]])
    # The writer adds header and line ends; a line is one column to it, and it has no quotes of its own.
    (
        rows.select(line.alias(header))
        .write.mode("overwrite")
        .options(header=True, sep="\u0001", quote="", escapeQuotes=False, lineSep="\r\n", ignoreLeadingWhiteSpace=False)
        .csv(path)
    )
    return path


def numbered_rows(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``df`` in order with ``_row`` from 1. Sorted ranges count on their own; only one number per range is gathered."""
    placed = written(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("_row", F.col("_before") + inside + 1)
        .drop("_at", "_part", "_before")
        .orderBy("_row")
    )


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(THRESHOLD_REPORT)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .csv(path)
    )
