"""The three input tables derived from an order / line-item data set.

A game is an order. Its home team is the supplier of the first line, its away
team the supplier of the last; lines are ordered by number, then supplier, and
an order with one and the same supplier at both ends is no game. Odd lines are
plays of the home team, even lines of the away team. A line that was
returned or accepted back is a field goal attempt, any other line an extra point.
The customer is the kicker.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.functions.expr import BUCKET_POINTS
from formbook.operators.durable import written
from formbook.operators.sides import stack_sides
from formbook.sources.tables import FormTables, kickers_only

# Line number and supplier packed into one long, so that first and last line
# are a plain minimum and maximum: both are combined before the shuffle and an
# order of any size costs one row per task. A window or a struct minimum
# would sort all lines of an order together. What does not fit is an error, not another team.
_SUPPLIER_BITS = 48
_SUPPLIER_MASK = (1 << _SUPPLIER_BITS) - 1
_LAST_LINE = (1 << (63 - _SUPPLIER_BITS)) - 1

# Upper ends of the distance buckets; the last one is open.
_BUCKET_LIMITS = dict(zip(BUCKET_POINTS, (19, 29, 39, 49, 59)))


_LINE_ORDER = (
    f"IF(l_linenumber NOT BETWEEN 0 AND {_LAST_LINE} OR l_suppkey NOT BETWEEN 0 AND {_SUPPLIER_MASK}, "
    "raise_error(concat('line number or supplier out of range: ', l_linenumber, ', ', l_suppkey)), "
    f"shiftleft(CAST(l_linenumber AS BIGINT), {_SUPPLIER_BITS}) | l_suppkey)"
)
_ATTEMPT = "l_returnflag IN ('R', 'A')"
_MADE = f"{_ATTEMPT} AND l_discount <= 0.08D"
_EXTRA_POINT = f"NOT {_ATTEMPT} AND l_tax <= 0.07D"
_HOME_LINE = "l_linenumber % 2 = 1"
_DISTANCE = "CAST(l_quantity AS INT) + 18"


@dataclass(frozen=True)
class OrderFolder:
    """Line items and orders, each opened once for all tables derived from them."""

    lines: DataFrame
    orders: DataFrame

    @staticmethod
    def at(spark: SparkSession, folder: str) -> OrderFolder:
        return OrderFolder(spark.read.parquet(f"{folder}/lineitem.parquet"), spark.read.parquet(f"{folder}/orders.parquet"))


def _orders(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    orders = source.orders
    if seasons:
        # A range on the stored date reaches the Parquet footers; year(date) would not.
        wanted = ", ".join(str(int(s)) for s in seasons)
        orders = orders.filter(
            f"o_orderdate >= TIMESTAMP_NTZ'{min(seasons)}-01-01' AND o_orderdate < TIMESTAMP_NTZ'{max(seasons) + 1}-01-01'"
        ).filter(f"year(o_orderdate) IN ({wanted})")
    return orders.selectExpr(
        "o_orderkey AS game_id",
        "year(o_orderdate) AS season",
        "CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS INT) AS week",
        "o_orderpriority AS roof",
        "o_custkey AS player_id",
        "CASE WHEN o_totalprice < 10000 THEN 'P' ELSE 'K' END AS position",
    )


def _lines(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    """The lines; of the given seasons' orders only, before anything is summed."""
    if not seasons:
        return source.lines
    return source.lines.join(_orders(source, seasons).select(F.col("game_id").alias("l_orderkey")), "l_orderkey", "left_semi")


def _games(lines: DataFrame, *more: str) -> DataFrame:
    ends = lines.groupBy(F.col("l_orderkey").alias("game_id")).agg(
        *[F.expr(e) for e in (f"min({_LINE_ORDER}) AS _first", f"max({_LINE_ORDER}) AS _last", *more)]
    )
    kept = [c for c in ends.columns if c not in ("_first", "_last")]
    return ends.selectExpr(
        *kept, f"_first & {_SUPPLIER_MASK}L AS home_team", f"_last & {_SUPPLIER_MASK}L AS away_team"
    ).filter("home_team != away_team")


def schedule(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    return _schedule_of(_games(_lines(source, seasons)).join(_orders(source, seasons), "game_id"))


def _schedule_of(games: DataFrame) -> DataFrame:
    return games.select("game_id", "season", "week", "home_team", "away_team", "roof")


def plays(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    lines = source.lines.withColumnRenamed("l_orderkey", "game_id")
    return lines.join(schedule(source, seasons), "game_id").selectExpr(
        "game_id",
        "season",
        "week",
        f"CASE WHEN {_HOME_LINE} THEN home_team ELSE away_team END AS posteam",
        f"CASE WHEN {_HOME_LINE} THEN away_team ELSE home_team END AS defteam",
        "CASE WHEN l_linenumber <= 5 THEN 4 ELSE 3 END AS down",
        f"CASE WHEN {_ATTEMPT} THEN 1 ELSE 0 END AS field_goal_attempt",
        f"CASE WHEN {_MADE} THEN 'made' WHEN {_ATTEMPT} THEN 'missed' END AS field_goal_result",
    )


# What a line is: a made kick by distance bucket, a missed one, a good or a failed extra point.
_KINDS = (*BUCKET_POINTS, "fg_missed", "pat_made", "pat_missed")


def _kind() -> str:
    bucket = "CASE " + " ".join(
        f"WHEN {_DISTANCE} <= {limit} THEN {_KINDS.index(name)}" for name, limit in _BUCKET_LIMITS.items()
    )
    first, last = _KINDS.index(next(iter(BUCKET_POINTS))), _KINDS.index(list(BUCKET_POINTS)[-1])
    # A made kick of unknown distance counts as one of the shortest.
    bucket += f" WHEN {_DISTANCE} IS NULL THEN {first} ELSE {last} END"
    missed, good, failed = (_KINDS.index(k) for k in ("fg_missed", "pat_made", "pat_missed"))
    return (
        f"CASE WHEN {_ATTEMPT} THEN CASE WHEN l_discount <= 0.08D THEN {bucket} ELSE {missed} END "
        f"WHEN l_tax <= 0.07D THEN {good} ELSE {failed} END"
    )


# What an attempt is to the role tables: side, down and result, numbered.
_TRIES = [(prefix, down, result) for prefix in ("home", "away") for down in (4, 3) for result in ("made", "missed")]
_TRY = (
    f"IF({_ATTEMPT}, IF({_HOME_LINE}, 0, 4) + IF(l_linenumber <= 5, 0, 2) + IF(l_discount <= 0.08D, 0, 1), NULL)"
)


def _folded(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    """One row per game with season, week, both teams and, for either side, lines of each kind and attempts of each
    down and result: all that the three input tables are made of, from one aggregation over the lines.

    Each line is classified once, before the aggregation only compares small numbers.
    """
    lines = _lines(source, seasons).selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", f"IF({_HOME_LINE}, 0, {len(_KINDS)}) + {_kind()} AS kind", f"{_TRY} AS try"
    )
    kinds = [
        f"count_if(kind = {offset + i}) AS {prefix}_{name}"
        for prefix, offset in (("home", 0), ("away", len(_KINDS)))
        for i, name in enumerate(_KINDS)
    ]
    tries = [f"count_if(try = {i}) AS {prefix}_down{down}_{result}" for i, (prefix, down, result) in enumerate(_TRIES)]
    return _games(lines, *kinds, *tries).join(_orders(source, seasons), "game_id")


def _weekly_of(games: DataFrame) -> DataFrame:
    buckets = " + ".join(BUCKET_POINTS)
    return (
        stack_sides(
            games,
            ["game_id", "season", "week", "player_id", "position"],
            {
                "recent_team": ("home_team", "away_team"),
                **{name: (f"home_{name}", f"away_{name}") for name in _KINDS},
            },
        )
        .selectExpr(
            "game_id",
            "season",
            "week",
            "player_id",
            "position",
            "recent_team",
            f"{buckets} + fg_missed AS fg_att",
            f"{buckets} AS fg_made",
            "fg_missed",
            "pat_made + pat_missed AS pat_att",
            "pat_made",
            *[f"nullif({name}, 0) AS {name}" for name in BUCKET_POINTS],
        )
        .filter("fg_att + pat_att > 0")
    )


def _attempts_of(games: DataFrame) -> DataFrame:
    rows = [
        f"named_struct('posteam', {side}_team, 'defteam', {other}_team, 'down', {down}, "
        f"'field_goal_attempt', {side}_down{down}_{result}, 'field_goal_result', '{result}')"
        for side, down, result in _TRIES
        for other in [{"home": "away", "away": "home"}[side]]
    ]
    return games.selectExpr("game_id", "season", "week", f"inline(array({', '.join(rows)}))").filter("field_goal_attempt > 0")


def attempts_by_game(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    """Attempts as a play table with one row per game, side, down and result; ``field_goal_attempt`` counts them.

    Lines are counted and their game's ends found in one aggregation, so a large order costs a row per task.
    """
    return _attempts_of(_folded(source, seasons))


def all_weekly(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    """One row per player appearance, every position; one aggregation over the lines."""
    return _weekly_of(_folded(source, seasons))


def weekly(source: OrderFolder, seasons: Sequence[int] | range = ()) -> DataFrame:
    return kickers_only(all_weekly(source, seasons))


def weekly_lists(source: OrderFolder) -> DataFrame:
    """Kicking rows with made distances as text, shortest first: each distance in ``fg_made_list`` was made ``times``
    times. One row per game, team, player and ``times``; extra points have a row with an empty list.

    Kicks are counted by distance before they meet their game, so a game of any size costs one row per
    distance and task, and the range of distances bounds every list.
    """
    counts = (
        source.lines.selectExpr(
            "l_orderkey AS game_id",
            f"{_HOME_LINE} AS at_home",
            f"CASE WHEN {_MADE} THEN {_DISTANCE} END AS distance",
            f"CASE WHEN {_EXTRA_POINT} THEN 1 ELSE 0 END AS pat",
        )
        .groupBy("game_id", "at_home", "distance")
        .agg(F.count("distance").alias("times"), F.sum("pat").alias("pat"))
    )
    games = _games(source.lines).join(_orders(source), "game_id").filter("position = 'K'")
    return (
        counts.join(games, "game_id")
        .selectExpr(
            "game_id", "season", "week", "IF(at_home, home_team, away_team) AS team", "player_id", "times", "distance", "pat"
        )
        .groupBy("game_id", "season", "week", "team", "player_id", "times")
        .agg(
            F.expr("array_join(CAST(sort_array(collect_list(distance)) AS ARRAY<STRING>), ';') AS fg_made_list"),
            F.sum("pat").alias("pat_made"),
        )
    )


def tables(source: OrderFolder, seasons: Sequence[int] | range = ()) -> FormTables:
    """The three tables as views of one table of games, which is written: lines are read and summed once, however often a
    plan turns to weekly rows, schedule and attempts."""
    games = written(_folded(source, seasons))
    return FormTables(kickers_only(_weekly_of(games)), _schedule_of(games), _attempts_of(games))
