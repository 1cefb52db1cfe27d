"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formbook.operators.durable import fresh_folder, scratch, written

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def utf8(text: str = "text") -> Column:
    """The text's bytes; null is empty. What Python workers take, since their byte
    functions know only ASCII white space and case."""
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def nullable(rows: list[tuple], schema: str, *whole: str) -> pd.DataFrame:
    """``rows`` as a frame for Spark; the columns ``whole`` hold 64-bit integers and nulls and never become floats."""
    names = [c.split()[0] for c in schema.split(", ")]
    found = pd.DataFrame(rows, columns=names)
    return found.assign(**{n: pd.array([r[names.index(n)] for r in rows], dtype="Int64") for n in whole})


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once, with a number ``_row`` of its own for every row: identifiers may be
    null or repeated. Written, because the number would change when a lost task runs again."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()))


def located(docs: DataFrame) -> DataFrame | None:
    """``docs`` as ``_doc`` with a number ``_row`` made of a row's file and its place there, which needs no copy of the texts;
    None where ``docs`` is anything but the plain scan of a table."""
    if "_metadata" in docs.columns or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        placed = docs.select(F.struct("*").alias("_doc"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:  # a format that does not number its rows
        return None
    files = written(placed.select("_file").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("_file")).cast("long")))
    return placed.join(F.broadcast(files), "_file").select("_doc", F.shiftleft("_nth", 40).bitwiseOR(F.col("_index")).alias("_row"))


def without_rows(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame], limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``_row`` is in ``dropped(rows)``, all columns.

    ``rows`` has ``_row`` and the document as ``_doc``: the table itself where ``docs`` is one, else the one copy that is written.
    What ``dropped`` writes is deleted when it is done. Only numbers of dropped rows travel; up to ``limit`` of them are sent to all executors."""
    rows = located(docs)
    if rows is None:
        rows = numbered(docs.select(F.struct("*").alias("_doc")))
    with scratch(docs.sparkSession) as keep:
        gone = keep(dropped(rows).select("_row"))
    if gone.count() <= limit:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What is written inside the block reaches Python in batches of so many rows: whole texts are wide, and a batch is held several
    times, by the JVM, by Arrow and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_by(df: DataFrame, column: str) -> DataFrame:
    """``df`` written once with a folder per value of ``column``, so that a filter on it reads no other."""
    path = fresh_folder(df.sparkSession)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Join a table that is expected to be small. It is written and counted, and sent to all
    executors up to ``limit`` rows; beyond, both sides are shuffled and large keys split at run time."""
    small = written(small)
    if small.count() <= limit:
        small = F.broadcast(small)
    return rows.join(small, on, how)
