"""Input schemas. Columns are always addressed by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, NumericType, StringType, StructField, StructType

KICK_COUNTS = ("fg_att", "fg_made", "fg_missed", "pat_att", "pat_made")

WEEKLY = StructType(
    [
        StructField("season", IntegerType(), False),
        StructField("week", IntegerType(), False),
        StructField("team", StringType()),
        StructField("player_id", StringType()),
        StructField("position", StringType()),
        *[StructField(c, DoubleType()) for c in KICK_COUNTS],
        StructField("fg_made_0_19", DoubleType()),
        StructField("fg_made_20_29", DoubleType()),
        StructField("fg_made_30_39", DoubleType()),
        StructField("fg_made_40_49", DoubleType()),
        StructField("fg_made_50_59", DoubleType()),
        StructField("fg_made_60_", DoubleType()),
        StructField("fg_made_list", StringType()),
    ]
)

SCHEDULE = StructType(
    [
        StructField("game_id", StringType(), False),
        StructField("season", IntegerType(), False),
        StructField("week", IntegerType(), False),
        StructField("home_team", StringType()),
        StructField("away_team", StringType()),
        StructField("roof", StringType()),
    ]
)

PLAYS = StructType(
    [
        StructField("season", IntegerType(), False),
        StructField("week", IntegerType(), False),
        StructField("posteam", StringType()),
        StructField("defteam", StringType()),
        StructField("down", IntegerType()),
        StructField("field_goal_attempt", IntegerType()),
        StructField("field_goal_result", StringType()),
    ]
)

# The published weekly report; its first column is an unnamed row number.
THRESHOLD_REPORT = StructType(
    [
        StructField("row", IntegerType()),
        StructField("threshold", DoubleType()),
        StructField("weeksperoccurence", DoubleType()),
        StructField("o_u", StringType()),
        StructField("kickpctthresh", DoubleType()),
        StructField("pvalue", DoubleType()),
        StructField("observations", IntegerType()),
        StructField("team", StringType()),
        StructField("profit", IntegerType()),
        StructField("hitrate", DoubleType()),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str], table: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """Declared numbers in their declared type, NaN as NULL in every column; a declared number that is none is an error."""
    wrong = [
        f"{f.name} ({df.schema[f.name].dataType.simpleString()})"
        for f in schema
        if f.name in df.columns and isinstance(f.dataType, NumericType) and not isinstance(df.schema[f.name].dataType, NumericType)
    ]
    if wrong:
        raise ValueError(f"{table} has text where numbers belong: {', '.join(wrong)}")
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
    numbers = {f.name: f.dataType for f in schema if f.name in df.columns and isinstance(f.dataType, NumericType)}
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in numbers.items()})
