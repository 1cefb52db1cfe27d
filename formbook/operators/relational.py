"""Small table operators: column choice, prefixes, stacking, complete rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def prefixed(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Put ``prefix`` in front of every column name except those in ``keep``."""
    keep = set(keep)
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the rows without any NULL in the given columns."""
    return df.dropna(how="any", subset=list(columns) if columns is not None else None)


def group_sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
    """Sum measures per key: NULL keys are dropped, NULL inputs count as 0."""
    measures = list(measures) if measures is not None else numeric_columns(df, keys)
    types = {f.name: f.dataType for f in df.schema}

    def total(name: str):
        value = F.sum(name)
        if isinstance(types[name], IntegralType):
            value = value.cast("bigint")
        return F.coalesce(value, F.lit(0)).alias(name)

    return df.dropna(how="any", subset=list(keys)).groupBy(*keys).agg(*[total(m) for m in measures])
