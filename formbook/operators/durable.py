"""Cutting a plan that several later steps read.

The intermediate table is written as Parquet into a folder that all executors share:
columnar, pruned on re-read, and still there when the executor that produced a part of it is
gone. Folders go when the driver ends, or earlier when the ``scratch`` block they were made in does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders made in the innermost open ``scratch`` block; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("formbook_scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, its warehouse, which executors share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_folder(spark: SparkSession, kind: str = "formbook") -> str:
    """A new folder's path under the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block are deleted at its end, so a long job holds no more than its current step needs.
    The block's value writes a table that stays (or goes with the surrounding block)."""
    outer, made = _made.get(), []

    def keep(df: DataFrame) -> DataFrame:
        inside = _made.set(outer)
        try:
            return written(df)
        finally:
            _made.reset(inside)

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of it."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
