"""Plain SQL for the registered queries, written independently of the Spark plans.

Trailing sums are self joins here rather than windows, home and away are found by
numbering lines rather than by packed minima, band joins compare every pair.
"""

from __future__ import annotations

_LINES = """
WITH numbered AS (
  SELECT l_orderkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS from_first,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS from_last
  FROM lineitem),
ends AS (
  SELECT l_orderkey AS game_id,
         max(CASE WHEN from_first = 1 THEN l_suppkey END) AS home_team,
         max(CASE WHEN from_last = 1 THEN l_suppkey END) AS away_team
  FROM numbered GROUP BY l_orderkey),
fixtures AS (
  SELECT game_id, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS INTEGER) AS week,
         home_team, away_team, o_orderpriority AS roof, o_custkey AS player_id,
         CASE WHEN o_totalprice < 10000 THEN 'P' ELSE 'K' END AS position
  FROM ends JOIN orders ON o_orderkey = game_id WHERE home_team <> away_team),
schedule AS (SELECT game_id, season, week, home_team, away_team, roof FROM fixtures),
lines AS (
  SELECT f.*, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
         CASE WHEN l_linenumber % 2 = 1 THEN home_team ELSE away_team END AS posteam,
         CASE WHEN l_linenumber % 2 = 1 THEN away_team ELSE home_team END AS defteam,
         CASE WHEN l_linenumber <= 5 THEN 4 ELSE 3 END AS down,
         CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END AS att,
         CASE WHEN l_returnflag IN ('R', 'A') AND l_discount <= 0.08e0 THEN 1 ELSE 0 END AS made,
         CASE WHEN l_returnflag NOT IN ('R', 'A') AND l_tax <= 0.07e0 THEN 1 ELSE 0 END AS pat,
         CAST(l_quantity AS INTEGER) + 18 AS yards
  FROM lineitem JOIN fixtures f ON l_orderkey = game_id),
all_weekly AS (
  SELECT game_id, season, week, player_id, position, posteam AS team,
         CAST(sum(att) AS BIGINT) AS fg_att, CAST(sum(made) AS BIGINT) AS fg_made,
         CAST(sum(att - made) AS BIGINT) AS fg_missed,
         CAST(sum(1 - att) AS BIGINT) AS pat_att, CAST(sum(pat) AS BIGINT) AS pat_made,
         CAST(sum(CASE WHEN made = 1 AND yards < 40 THEN 3 WHEN made = 1 AND yards < 50 THEN 4
                       WHEN made = 1 THEN 5 ELSE pat END) AS BIGINT) AS points
  FROM lines GROUP BY ALL),
weekly AS (SELECT * FROM all_weekly WHERE position = 'K'),
side_rows AS (
  SELECT game_id, season, week, roof, 'home' AS side, home_team AS team, away_team AS opp FROM schedule
  UNION ALL
  SELECT game_id, season, week, roof, 'away', away_team, home_team FROM schedule)
"""

_FORM = (
    _LINES
    + """,
kick_week AS (
  SELECT season, week, team, sum(fg_att) AS fg_att, sum(fg_made) AS fg_made, sum(fg_missed) AS fg_missed,
         sum(pat_att) AS pat_att, sum(pat_made) AS pat_made, sum(points) AS points
  FROM weekly GROUP BY season, week, team),
try_rows AS (
  SELECT season, week, posteam AS team, down, 1 AS own, made FROM lines WHERE att = 1
  UNION ALL
  SELECT season, week, defteam, down, 0, made FROM lines WHERE att = 1),
try_week AS (
  SELECT season, week, team,
         sum(CASE WHEN own = 0 THEN 1 END) AS allowed_att_any,
         sum(CASE WHEN own = 1 AND down = 4 THEN 1 END) AS own_att,
         sum(CASE WHEN own = 1 AND down = 4 THEN made END) AS own_made,
         sum(CASE WHEN own = 0 AND down = 4 THEN 1 END) AS allowed_att,
         sum(CASE WHEN own = 0 AND down = 4 THEN made END) AS allowed_made
  FROM try_rows GROUP BY season, week, team),
fix_week AS (SELECT season, week, team, count(*) AS games FROM side_rows GROUP BY season, week, team),
target AS (SELECT DISTINCT season, week, team FROM side_rows WHERE week BETWEEN 7 AND 53),
f_games AS (
  SELECT t.season, t.week, t.team, sum(f.games) AS games
  FROM target t LEFT JOIN fix_week f
    ON f.season = t.season AND f.team = t.team AND f.week BETWEEN t.week - 6 AND t.week - 1
  GROUP BY t.season, t.week, t.team),
f_kick AS (
  SELECT t.season, t.week, t.team, sum(f.fg_att) AS fg_att, sum(f.fg_made) AS fg_made,
         sum(f.fg_missed) AS fg_missed, sum(f.pat_att) AS pat_att, sum(f.pat_made) AS pat_made
  FROM target t LEFT JOIN kick_week f
    ON f.season = t.season AND f.team = t.team AND f.week BETWEEN t.week - 6 AND t.week - 1
  GROUP BY t.season, t.week, t.team),
f_try AS (
  SELECT t.season, t.week, t.team, sum(f.allowed_att_any) AS allowed_att_any, sum(f.own_att) AS own_att,
         sum(f.own_made) AS own_made, sum(f.allowed_att) AS allowed_att, sum(f.allowed_made) AS allowed_made
  FROM target t LEFT JOIN try_week f
    ON f.season = t.season AND f.team = t.team AND f.week BETWEEN t.week - 6 AND t.week - 1
  GROUP BY t.season, t.week, t.team),
form AS (
  SELECT s.*, CAST(g.games AS BIGINT) AS games,
         CAST(k.fg_att AS BIGINT) AS fg_att, CAST(k.fg_made AS BIGINT) AS fg_made,
         CAST(k.fg_missed AS BIGINT) AS fg_missed, CAST(k.pat_att AS BIGINT) AS pat_att,
         CAST(k.pat_made AS BIGINT) AS pat_made,
         CAST(r.allowed_att_any AS BIGINT) AS allowed_att_any,
         CAST(r.own_att AS BIGINT) AS own_att, CAST(r.own_made AS BIGINT) AS own_made,
         CAST(r.allowed_att AS BIGINT) AS allowed_att, CAST(r.allowed_made AS BIGINT) AS allowed_made,
         CAST(a.fg_att AS BIGINT) AS actual_fg_att, CAST(a.fg_made AS BIGINT) AS actual_fg_made,
         CAST(a.pat_made AS BIGINT) AS actual_pat_made,
         CAST(coalesce(a.points, 0) AS BIGINT) AS points
  FROM side_rows s
  JOIN f_games g USING (season, week, team)
  JOIN f_kick k USING (season, week, team)
  JOIN f_try r USING (season, week, team)
  LEFT JOIN kick_week a USING (season, week, team)),
rates AS (
  SELECT m.*,
         CASE WHEN m.games = 0 THEN 0e0 ELSE m.fg_att / CAST(m.games AS DOUBLE) END AS att_rate,
         CASE WHEN o.games = 0 THEN 0e0 ELSE o.allowed_att_any / CAST(o.games AS DOUBLE) END AS opp_any_rate,
         CASE WHEN m.games = 0 THEN 0e0 ELSE m.own_att / CAST(m.games AS DOUBLE) END AS own_rate,
         CASE WHEN m.games = 0 THEN 0e0 ELSE m.allowed_att / CAST(m.games AS DOUBLE) END AS allowed_rate,
         CASE WHEN o.games = 0 THEN 0e0 ELSE o.allowed_att / CAST(o.games AS DOUBLE) END AS opp_allowed_rate,
         CASE WHEN m.games = 0 THEN 0e0 ELSE m.pat_made / CAST(m.games AS DOUBLE) END AS xppg,
         CASE WHEN m.fg_made + m.fg_missed = 0 THEN 0e0
              ELSE m.fg_made / CAST(m.fg_made + m.fg_missed AS DOUBLE) END AS kick_pct,
         CASE WHEN m.fg_att = 0 THEN 0e0 ELSE m.fg_made / CAST(m.fg_att AS DOUBLE) END AS pct,
         CASE WHEN m.actual_fg_made > 1.5e0 THEN 1 WHEN m.actual_fg_made <= 1.5e0 THEN -1 END AS cash
  FROM form m JOIN form o ON o.game_id = m.game_id AND o.side <> m.side),
blends AS (
  SELECT *, (opp_any_rate + att_rate) / 2e0 AS proj_att,
         (own_rate + opp_allowed_rate) / 2e0 AS exp_att,
         0.35e0 * own_rate + 0.65e0 * opp_allowed_rate AS adj_exp_att
  FROM rates),
sides AS (
  SELECT *, exp_att * 3.8e0 * kick_pct + xppg AS exp_points,
         3.9676e0 + 0.40388e0 * xppg + 1.1195e0 * adj_exp_att + 2.24413e0 * kick_pct
           - 0.66712e0 * adj_exp_att * kick_pct AS regress_points
  FROM blends)
"""
)

_SPINE = (
    _LINES
    + """,
weeks AS (SELECT CAST(range AS INTEGER) AS week FROM range(7, 54))
"""
)

_SIDE_COLUMNS = (
    "games, fg_att, fg_made, fg_missed, pat_att, pat_made, own_att, own_made, allowed_att, allowed_made, "
    "actual_fg_att, actual_fg_made, actual_pat_made, points, att_rate, proj_att, own_rate, allowed_rate, "
    "exp_att, adj_exp_att, xppg, kick_pct, exp_points, cash"
)


def _jb(n: str, hits: str, misses: str) -> str:
    """Moments of +1 / -1 / 0 outcomes written out as sums."""
    mean = f"(({hits} - {misses}) / CAST({n} AS DOUBLE))"
    even = f"(({hits} + {misses}) / CAST({n} AS DOUBLE))"
    var = f"({even} - {mean} * {mean})"
    third = f"({mean} - 3 * {mean} * {even} + 2 * {mean} * {mean} * {mean})"
    fourth = (
        f"({even} - 4 * {mean} * {mean} + 6 * {mean} * {mean} * {even} - 3 * {mean} * {mean} * {mean} * {mean})"
    )
    skew2 = f"({third} * {third} / ({var} * {var} * {var}))"
    excess = f"({fourth} / ({var} * {var}) - 3)"
    return (
        f"CASE WHEN {n} > 0 AND {hits} + {misses} > 0 AND {var} > 0 "
        f"THEN CAST({n} AS DOUBLE) / 6 * ({skew2} + {excess} * {excess} / 4) END"
    )


def _verdict(source: str, keys: str, flag: str | None = None) -> str:
    """Report columns from (n, hits, misses, periods)."""
    published = "CASE WHEN n > 0 THEN (n / 2e0 + (hits - misses)) / n END"
    under = f"coalesce({published} < 0.5, false)" if flag is None else f"({flag} = 'u')"
    return f"""
SELECT {keys}, n / CAST(periods AS DOUBLE) AS weeks_per_occurrence,
       CASE WHEN {under} THEN 'u' ELSE 'o' END AS o_u,
       round(exp(-({_jb("n", "hits", "misses")}) / 2), 9) AS p_value,
       CAST(n AS BIGINT) AS observations,
       CAST(CASE WHEN {under} THEN misses - hits ELSE hits - misses END AS BIGINT) AS profit,
       CASE WHEN {under} THEN 1 - ({published}) ELSE {published} END AS hit_rate_ref,
       CASE WHEN hits + misses > 0 THEN
         (CASE WHEN {under} THEN misses ELSE hits END) / CAST(hits + misses AS DOUBLE) END AS hit_rate
FROM {source}"""


_HISTORY_ZERO = """,
history AS (
  SELECT coalesce(adj_exp_att, 0e0) AS adj_exatt, coalesce(exp_att, 0e0) AS exatt, coalesce(pct, 0e0) AS pct,
         coalesce(cash, 0) AS cash
  FROM sides),
period AS (SELECT count(*) AS periods FROM (SELECT DISTINCT season, week FROM sides))
"""


def _rolled(fact: str, measures: str) -> str:
    sums = ", ".join(f"CAST(sum(f.{m}) AS BIGINT) AS {m}" for m in measures.split())
    some = " OR ".join(f"{m} IS NOT NULL" for m in measures.split())
    return f"""
SELECT * FROM (
  SELECT t.season, w.week, t.team, {sums}
  FROM (SELECT DISTINCT season, team FROM {fact}) t CROSS JOIN weeks w
  LEFT JOIN {fact} f
    ON f.season = t.season AND f.team = t.team AND f.week BETWEEN w.week - 6 AND w.week - 1
  GROUP BY t.season, w.week, t.team) WHERE {some}"""


def _role_fact(down: str) -> str:
    return f""",
role_week AS (
  SELECT season, week, team, sum(own_att) AS own_att, sum(own_made) AS own_made,
         sum(allowed_att) AS allowed_att, sum(allowed_made) AS allowed_made
  FROM (
    SELECT season, week, posteam AS team, 1 AS own_att, made AS own_made, NULL AS allowed_att, NULL AS allowed_made
    FROM lines WHERE att = 1 {down}
    UNION ALL
    SELECT season, week, defteam, NULL, NULL, 1, made FROM lines WHERE att = 1 {down})
  GROUP BY season, week, team)
"""


def _quantile(column: str, p: str) -> str:
    return (
        _FORM
        + f"SELECT season, week, round(quantile_cont({column}, {p}), 6) AS quantile FROM sides "
        + f"WHERE {column} IS NOT NULL GROUP BY season, week"
    )


_SINGLE = """,
counted AS (
  SELECT {threshold} AS threshold, count(*) AS n, coalesce(sum(CASE WHEN cash = 1 THEN 1 ELSE 0 END), 0) AS hits,
         coalesce(sum(CASE WHEN cash = -1 THEN 1 ELSE 0 END), 0) AS misses
  FROM history WHERE exatt >= {threshold} * 0.97e0 AND exatt <= {threshold} * 1.03e0)
"""

# Thresholds of the sweep: expectation, flag, lower and upper end of accuracy.
SWEEP = (
    (1.22, "u", None, None),
    (1.3, "u", None, 0.9),
    (1.5, "u", None, 0.65),
    (0.8, "o", 0.9, None),
    (1.0, "o", 0.5, 0.95),
    (2.6, "o", None, None),
    *(((2 * step + 1) / 100, "u" if step < 75 else "o", None, None) for step in range(30, 130)),
)


# One-sided rules: flag, lower and upper end of expectation, of accuracy.
CUTS = (
    ("u", None, 1.3, None, 0.9),
    ("o", 2.7, None, 0.9, None),
    ("o", 2.6, None, None, None),
    ("u", None, 1.5, None, 0.65),
)


def _sql_double(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"{v}e0"


def _sweep_values() -> str:
    return ", ".join(f"({t}e0, '{f}', {_sql_double(lo)}, {_sql_double(hi)})" for t, f, lo, hi in SWEEP)


def _normal_equations(target: str, x1: str, x2: str) -> str:
    """Two regressors in closed form from covariances."""
    return f"""
SELECT unnest(['intercept', '{x1}', '{x2}']) AS term,
       unnest([round(my - b1 * m1 - b2 * m2, 6), round(b1, 6), round(b2, 6)]) AS coefficient
FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
      FROM (SELECT avg({target}) AS my, avg({x1}) AS m1, avg({x2}) AS m2,
                   covar_pop({x1}, {x1}) AS s11, covar_pop({x2}, {x2}) AS s22, covar_pop({x1}, {x2}) AS s12,
                   covar_pop({x1}, {target}) AS s1y, covar_pop({x2}, {target}) AS s2y
            FROM rows))"""


def _residual_steps(target: str, terms: list[str], names: list[str]) -> str:
    """Any number of regressors: each step takes one regressor out of everything left."""
    k = len(terms)
    steps = ["r0 AS (SELECT " + ", ".join(f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(terms))]
    steps[0] += f", CAST({target} AS DOUBLE) AS y FROM rows)"
    for i in range(k):
        rest = [f"x{j}" for j in range(i + 1, k)] + ["y"]
        fits = ", ".join(f"regr_slope({v}, x{i}) AS s_{v}, regr_intercept({v}, x{i}) AS c_{v}" for v in rest)
        left = ", ".join(f"{v} - s_{v} * x{i} - c_{v} AS {v}" for v in rest)
        steps.append(f"g{i} AS (SELECT {fits} FROM r{i})")
        steps.append(f"r{i + 1} AS (SELECT {left} FROM r{i}, g{i})")
    # Back substitution from the last regressor to the first.
    beta = {}
    for i in reversed(range(k)):
        expr = f"(SELECT s_y FROM g{i})"
        for j in range(i + 1, k):
            expr += f" - (SELECT s_x{j} FROM g{i}) * b{j}"
        beta[i] = expr
    inner = "SELECT 1 AS one"
    for i in reversed(range(k)):
        inner = f"SELECT *, {beta[i]} AS b{i} FROM ({inner})"
    mean = " - ".join(["(SELECT avg(y) FROM r0)"] + [f"b{i} * (SELECT avg(x{i}) FROM r0)" for i in range(k)])
    labels = ", ".join(f"'{n}'" for n in ["intercept", *names])
    values = ", ".join([f"round({mean}, 6)"] + [f"round(b{i}, 6)" for i in range(k)])
    return (
        ", " + ", ".join(steps) + f" SELECT unnest([{labels}]) AS term, unnest([{values}]) AS coefficient FROM ({inner})"
    )


def _summary_moments(column: str) -> str:
    return (
        f"count({column}) AS n, min({column}) AS min, round(quantile_cont({column}, 0.25), 6) AS q1, "
        f"round(quantile_cont({column}, 0.5), 6) AS median, round(avg({column}), 6) AS mean, "
        f"round(quantile_cont({column}, 0.75), 6) AS q3, max({column}) AS max, round(stddev_samp({column}), 6) AS sd"
    )


def _matrix(columns: list[str], source: str) -> str:
    def cell(a: str, b: str) -> str:
        value = "1e0" if a == b else f"round(corr({a}, {b}), 6)"
        return f"SELECT '{a}' AS \"row\", '{b}' AS col, {value} AS r FROM {source}"

    # A row of ones repeats per input row without an aggregate: group it away.
    return " UNION ".join(cell(a, b) for a in columns for b in columns)


def _two_sides(columns: str) -> str:
    return f"""
SELECT h.game_id, h.season, h.week, h.roof, h.team AS home_team, a.team AS away_team,
       {", ".join(f"h.{c} AS home_{c}, a.{c} AS away_{c}" for c in columns.split())}
FROM sides h JOIN sides a ON h.game_id = a.game_id AND h.side = 'home' AND a.side = 'away'
WHERE h.week BETWEEN 7 AND 53"""


_WEIGHTED = "SELECT * FROM sides WHERE cash IS NOT NULL"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # --- scans, projections -------------------------------------------------
    sql["scan_filter_rename"] = (
        _LINES
        + "SELECT season, week, team, player_id, fg_att, fg_made, fg_missed, pat_att, pat_made FROM all_weekly "
        + "WHERE position = 'K'"
    )
    sql["season_range_filter"] = (
        _LINES
        + "SELECT game_id, season, week, home_team, away_team, roof FROM schedule WHERE season BETWEEN 1996 AND 1998"
    )
    sql["union_by_name"] = (
        _LINES
        + """SELECT season, week, team, fg_att, CAST(NULL AS BIGINT) AS games FROM weekly
UNION ALL SELECT season, week, team, NULL, 1 FROM side_rows"""
    )
    sql["sum_all_numeric"] = (
        _LINES
        + """SELECT season, team, CAST(sum(fg_att) AS BIGINT) AS fg_att, CAST(sum(fg_made) AS BIGINT) AS fg_made,
  CAST(sum(fg_missed) AS BIGINT) AS fg_missed, CAST(sum(pat_att) AS BIGINT) AS pat_att,
  CAST(sum(pat_made) AS BIGINT) AS pat_made, CAST(sum(b1) AS BIGINT) AS fg_made_0_19,
  CAST(sum(b2) AS BIGINT) AS fg_made_20_29, CAST(sum(b3) AS BIGINT) AS fg_made_30_39,
  CAST(sum(b4) AS BIGINT) AS fg_made_40_49, CAST(sum(b5) AS BIGINT) AS fg_made_50_59,
  CAST(sum(b6) AS BIGINT) AS fg_made_60_
FROM (SELECT season, posteam AS team, att AS fg_att, made AS fg_made, att - made AS fg_missed, 1 - att AS pat_att,
        pat AS pat_made,
        CASE WHEN made = 1 AND yards <= 19 THEN 1 ELSE 0 END AS b1,
        CASE WHEN made = 1 AND yards BETWEEN 20 AND 29 THEN 1 ELSE 0 END AS b2,
        CASE WHEN made = 1 AND yards BETWEEN 30 AND 39 THEN 1 ELSE 0 END AS b3,
        CASE WHEN made = 1 AND yards BETWEEN 40 AND 49 THEN 1 ELSE 0 END AS b4,
        CASE WHEN made = 1 AND yards BETWEEN 50 AND 59 THEN 1 ELSE 0 END AS b5,
        CASE WHEN made = 1 AND yards >= 60 THEN 1 ELSE 0 END AS b6
      FROM lines WHERE position = 'K') GROUP BY season, team"""
    )
    sql["safe_ratio"] = (
        _LINES
        + """SELECT game_id, team, CASE WHEN fg_att = 0 THEN 0e0 ELSE fg_made / CAST(fg_att AS DOUBLE) END AS pct,
  CASE WHEN pat_att = 0 THEN 0e0 ELSE pat_made / CAST(pat_att AS DOUBLE) END AS pat_pct FROM weekly"""
    )
    sql["code_normalize_backward"] = """
SELECT season, code, count(*) AS orders FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season,
         CASE WHEN n_name = 'NATION_3' AND year(o_orderdate) < 1997 THEN 'OLD_3'
              WHEN n_name = 'NATION_7' AND year(o_orderdate) < 1999 THEN 'OLD_7'
              WHEN n_name = 'NATION_11' AND year(o_orderdate) < 2000 THEN 'OLD_11' ELSE n_name END AS code
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
GROUP BY season, code"""
    sql["code_normalize_forward"] = """
SELECT season, code, count(*) AS orders FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season,
         CASE WHEN n_name = 'NATION_3' AND year(o_orderdate) > 1997 THEN 'NEW_3'
              WHEN n_name = 'NATION_7' AND year(o_orderdate) > 1999 THEN 'NEW_7'
              WHEN n_name = 'NATION_11' AND year(o_orderdate) > 2000 THEN 'NEW_11' ELSE n_name END AS code
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
GROUP BY season, code"""
    sql["null_fill"] = (
        _LINES
        + """SELECT game_id, team, coalesce(nullif(b, 0), 0) AS fg_made_30_39 FROM (
  SELECT game_id, posteam AS team, CAST(sum(CASE WHEN made = 1 AND yards BETWEEN 30 AND 39 THEN 1 ELSE 0 END) AS BIGINT) AS b
  FROM lines WHERE position = 'K' GROUP BY game_id, posteam)"""
    )
    sql["cash_indicator"] = (
        _FORM + "SELECT game_id, side, actual_fg_made, cash FROM sides WHERE week BETWEEN 7 AND 53"
    )
    sql["dropna_complete_cases"] = (
        _FORM
        + """SELECT game_id, side, exp_att, actual_fg_att, actual_fg_made, fg_att, fg_made, cash FROM sides
WHERE exp_att IS NOT NULL AND actual_fg_att IS NOT NULL AND actual_fg_made IS NOT NULL AND fg_att IS NOT NULL
  AND fg_made IS NOT NULL AND cash IS NOT NULL"""
    )

    # --- games, sides, opponents --------------------------------------------
    sql["games_by_team"] = (
        _LINES + "SELECT season, week, team, count(*) AS games FROM side_rows GROUP BY season, week, team"
    )
    sql["games_played_outer"] = (
        _LINES
        + """, h AS (SELECT season, home_team AS team, count(*) AS n FROM schedule GROUP BY 1, 2),
a AS (SELECT season, away_team AS team, count(*) AS n FROM schedule GROUP BY 1, 2)
SELECT coalesce(h.season, a.season) AS season, coalesce(h.team, a.team) AS team, coalesce(h.n, 0) AS home_games,
  coalesce(a.n, 0) AS away_games, coalesce(h.n, 0) + coalesce(a.n, 0) AS games
FROM h FULL OUTER JOIN a ON h.season = a.season AND h.team = a.team"""
    )
    sql["sides_long"] = _LINES + "SELECT game_id, season, week, roof, side, team, opp FROM side_rows"
    sql["matchups_union_distinct"] = (
        _LINES
        + """SELECT season, week, home_team AS team, away_team AS opp FROM schedule
UNION SELECT season, week, away_team, home_team FROM schedule"""
    )
    sql["opponent_lookup"] = (
        _LINES
        + """, kick_week AS (SELECT season, week, team, CAST(sum(fg_att) AS BIGINT) AS fg_att FROM weekly GROUP BY 1, 2, 3)
SELECT k.season, k.week, k.team, k.fg_att, m.opp AS oppteam FROM kick_week k
JOIN (SELECT DISTINCT season, week, team, opp FROM side_rows) m
  ON m.season = k.season AND m.week = k.week AND m.team = k.team"""
    )
    sql["team_week_spine"] = (
        _SPINE + "SELECT t.season, week, t.team FROM (SELECT DISTINCT season, team FROM side_rows) t CROSS JOIN weeks"
    )
    sql["side_prefix_wide"] = _FORM + _two_sides(
        "games fg_att fg_made fg_missed pat_att pat_made own_att own_made allowed_att allowed_made"
    )
    sql["actual_outcomes"] = _FORM + _two_sides("actual_fg_att actual_fg_made actual_pat_made")

    # --- trailing windows -----------------------------------------------------
    fix = ", fix_week AS (SELECT season, week, team, count(*) AS games FROM side_rows GROUP BY 1, 2, 3)"
    sql["rolling_games"] = _SPINE + fix + _rolled("fix_week", "games")
    sql["games_played_calendar"] = (
        _FORM
        + """SELECT h.game_id, h.season, h.week, h.games AS home_games, a.games AS away_games
FROM sides h JOIN sides a ON h.game_id = a.game_id AND h.side = 'home' AND a.side = 'away'"""
    )
    kick = """, kick_week AS (
  SELECT season, week, team, fg_att, fg_made, fg_missed, pat_att, pat_made, NULL AS games FROM weekly
  UNION ALL SELECT season, week, team, NULL, NULL, NULL, NULL, NULL, 1 FROM side_rows)"""
    sql["rolling_form"] = (
        _SPINE
        + kick
        + "SELECT *, CASE WHEN games = 0 THEN 0e0 ELSE fg_att / CAST(games AS DOUBLE) END AS att_rate FROM ("
        + _rolled("kick_week", "games fg_att fg_made fg_missed pat_att pat_made")
        + ")"
    )
    # Distances of made kicks by bucket; a bucket without a kick is missing in its row.
    buckets = {"fg_made_0_19": (0, 19), "fg_made_20_29": (20, 29), "fg_made_30_39": (30, 39), "fg_made_40_49": (40, 49), "fg_made_50_59": (50, 59), "fg_made_60_": (60, 9999)}
    by_bucket = ", ".join(f"nullif(sum(CASE WHEN made = 1 AND yards BETWEEN {a} AND {b} THEN 1 ELSE 0 END), 0) AS {c}" for c, (a, b) in buckets.items())
    names = " ".join(buckets)
    listed = ", ".join(buckets)
    bucket_week = f""", bucket_rows AS (
  SELECT game_id, season, week, posteam AS team, {by_bucket} FROM lines WHERE position = 'K' GROUP BY ALL),
"""
    nothing = ", ".join(["NULL"] * (5 + len(buckets)))
    sql["rolling_every_column"] = (
        _SPINE
        + bucket_week
        + f"""every_week AS (
  SELECT season, week, team, fg_att, fg_made, fg_missed, pat_att, pat_made, {listed}, NULL AS games
  FROM weekly JOIN bucket_rows USING (game_id, season, week, team)
  UNION ALL SELECT season, week, team, {nothing}, 1 FROM side_rows)"""
        + _rolled("every_week", f"games fg_att fg_made fg_missed pat_att pat_made {names}")
    )
    rolled = ", ".join(f"CAST(sum(coalesce(b.{c}, 0)) FILTER (WHERE b.team IS NOT NULL) AS BIGINT) AS {c}" for c in buckets)
    sql["sides_every_column"] = (
        _FORM
        + bucket_week
        + f"""f_bucket AS (
  SELECT t.season, t.week, t.team, {rolled}
  FROM target t LEFT JOIN bucket_rows b ON b.season = t.season AND b.team = t.team AND b.week BETWEEN t.week - 6 AND t.week - 1
  GROUP BY t.season, t.week, t.team)
SELECT game_id, season, week, side, team, games, fg_att, {listed}, exp_points FROM sides JOIN f_bucket USING (season, week, team)"""
    )
    roles = "own_att own_made allowed_att allowed_made"
    sql["rolling_allowed"] = _SPINE + _role_fact("") + _rolled("role_week", roles)
    sql["rolling_allowed_fourth"] = _SPINE + _role_fact("AND down = 4") + _rolled("role_week", roles)
    sql["projected_attempts"] = (
        _FORM + "SELECT game_id, season, week, side, team, opp, att_rate, opp_any_rate, proj_att FROM sides"
    )

    # --- expectations -----------------------------------------------------------
    sql["expected_metrics"] = (
        _FORM + f"SELECT game_id, season, week, side, team, opp, roof, {_SIDE_COLUMNS} FROM sides"
    )
    sql["regression_score"] = (
        _FORM + "SELECT game_id, side, xppg, adj_exp_att, kick_pct, regress_points FROM sides"
    )

    # --- points --------------------------------------------------------------------
    sql["points_by_bucket"] = _LINES + "SELECT game_id, season, week, team, points AS fantasy_points FROM weekly"
    sql["points_fallback"] = (
        _LINES + "SELECT game_id, season, week, team, pat_made + 3 * fg_made AS fantasy_points FROM weekly"
    )
    sql["points_from_list"] = (
        _LINES
        + """SELECT game_id, season, week, posteam AS team, player_id,
  CAST(sum(CASE WHEN made = 1 AND yards < 40 THEN 3 WHEN made = 1 AND yards < 50 THEN 4
                WHEN made = 1 THEN 5 ELSE pat END) AS BIGINT) AS fantasy_points
FROM lines WHERE position = 'K' GROUP BY ALL"""
    )
    sql["actual_points"] = (
        _LINES
        + "SELECT season, week, team, CAST(sum(points) AS BIGINT) AS fantasy_points FROM weekly GROUP BY season, week, team"
    )

    # --- statistics -------------------------------------------------------------------
    sql["weekly_quantile_points"] = _quantile("exp_points", "0.88")
    sql["weekly_quantile_attempts"] = _quantile("exp_att", "0.95")
    sql["mean_weekly_quantile"] = (
        _FORM
        + """SELECT round(avg(qp), 6) AS points_quantile, round(avg(qa), 6) AS attempts_quantile FROM (
  SELECT season, week, quantile_cont(exp_points, 0.88) AS qp, quantile_cont(exp_att, 0.95) AS qa
  FROM sides GROUP BY season, week)"""
    )
    moments = ""
    for name in ("cash", "points"):
        moments += f"""
  count({name}) AS {name}_n, sum(CAST({name} AS DOUBLE)) / count({name}) AS {name}_m,
  sum(CAST({name} AS DOUBLE) * {name}) / count({name}) AS {name}_m2,
  sum(CAST({name} AS DOUBLE) * {name} * {name}) / count({name}) AS {name}_m3,
  sum(CAST({name} AS DOUBLE) * {name} * {name} * {name}) / count({name}) AS {name}_m4,"""

    def central(name: str) -> str:
        m, m2, m3, m4 = (f"{name}_m{i}" for i in ("", 2, 3, 4))
        var = f"({m2} - {m} * {m})"
        third = f"({m3} - 3 * {m} * {m2} + 2 * {m} * {m} * {m})"
        fourth = f"({m4} - 4 * {m} * {m3} + 6 * {m} * {m} * {m2} - 3 * {m} * {m} * {m} * {m})"
        return (
            f"({name}_n / 6e0 * (pow({third} / pow({var}, 1.5), 2) + pow({fourth} / ({var} * {var}) - 3, 2) / 4))"
        )

    sql["jarque_bera"] = (
        _FORM
        + f"""SELECT roof, cash_n AS n_cash, round({central("cash")}, 4) AS jb_cash,
  round(exp(-{central("cash")} / 2), 9) AS p_cash, points_n AS n_points, round({central("points")}, 4) AS jb_points,
  round(exp(-{central("points")} / 2), 9) AS p_points
FROM (SELECT roof, {moments} FROM sides GROUP BY roof)"""
    )
    sql["summary_stats"] = (
        _FORM
        + f"SELECT 'points' AS measure, {_summary_moments('CAST(points AS DOUBLE)')} FROM sides UNION ALL "
        + f"SELECT 'exp_points', {_summary_moments('exp_points')} FROM sides UNION ALL "
        + f"SELECT 'pct', {_summary_moments('pct')} FROM sides"
    )
    sql["roof_levels"] = _LINES + "SELECT DISTINCT roof FROM schedule"
    sql["late_season_by_roof"] = (
        _FORM + "SELECT roof, avg(actual_fg_made) AS avg_made FROM sides WHERE week > 14 GROUP BY roof"
    )
    pats = (
        _FORM
        + """, pats AS (SELECT coalesce(actual_fg_att, 0) AS fgatt, coalesce(pat_att, 0) AS pastpat, coalesce(games, 0) AS g,
  coalesce(CASE WHEN games = 0 THEN 0e0 ELSE pat_att / CAST(games AS DOUBLE) END, 0) AS patpg FROM sides) """
    )
    sql["correlation_matrix"] = pats + _matrix(["fgatt", "pastpat", "g", "patpg"], "pats")
    sql["eval_mae_rmse"] = (
        _FORM
        + """SELECT round(avg(abs(points - regress_points)), 6) AS mae,
  round(sqrt(avg((points - regress_points) * (points - regress_points))), 6) AS rmse FROM sides"""
    )

    # --- thresholds and comparables --------------------------------------------------------
    sql["threshold_single"] = (
        _FORM
        + _HISTORY_ZERO
        + _SINGLE.format(threshold="1.22e0")
        + _verdict("(SELECT *, 'u' AS flag FROM counted, period)", "threshold", "flag")
    )
    sql["threshold_sweep"] = (
        _FORM
        + _HISTORY_ZERO
        + f""", tries AS (SELECT * FROM (VALUES {_sweep_values()}) AS t(threshold, flag, min_pct, max_pct)),
counted AS (
  SELECT threshold, flag, min_pct, max_pct, count(cash) AS n,
         coalesce(sum(CASE WHEN cash = 1 THEN 1 ELSE 0 END), 0) AS hits,
         coalesce(sum(CASE WHEN cash = -1 THEN 1 ELSE 0 END), 0) AS misses
  FROM tries LEFT JOIN history ON exatt >= threshold * 0.97e0 AND exatt <= threshold * 1.03e0
    AND (min_pct IS NULL OR pct >= min_pct) AND (max_pct IS NULL OR pct <= max_pct)
  GROUP BY ALL)"""
        + _verdict("(SELECT * FROM counted, period)", "threshold, min_pct, max_pct", "flag")
    )
    sql["points_threshold"] = (
        _FORM
        + f""", chosen AS (SELECT points FROM sides WHERE exp_points >= 4e0 * 0.95e0 AND exp_points <= 4e0 * 1.05e0
    AND kick_pct > 0.95e0),
all_sides AS (SELECT avg(points) AS everybody, count(DISTINCT season * 100 + week) AS periods FROM sides)
SELECT 4e0 AS threshold, points_n / CAST(periods AS DOUBLE) AS weeks_per_occurrence, 0.95e0 AS pct_threshold,
  round(exp(-{central("points")} / 2), 9) AS p_value, points_n AS observations,
  round(points_m - everybody, 6) AS advantage, round(points_m, 6) AS outcome
FROM (SELECT {moments[moments.index("count(points)"):]} FROM chosen), all_sides"""
    )
    # Every try against every side, moments by DuckDB's own functions (samples' skewness and kurtosis turned to populations').
    sql["points_thresholds"] = (
        _FORM
        + """, tries AS (SELECT 2e0 + s / 4e0 AS threshold, p AS pct_threshold
  FROM range(10) AS r(s), (VALUES (0.5e0), (0.75e0), (0.95e0)) AS v(p)),
all_sides AS (SELECT avg(points) AS everybody, count(DISTINCT season * 100 + week) AS periods FROM sides),
met AS (SELECT threshold, pct_threshold, CAST(points AS DOUBLE) AS v FROM tries LEFT JOIN sides
  ON exp_points >= threshold * 0.95e0 AND exp_points <= threshold * 1.05e0 AND kick_pct > pct_threshold),
centred AS (SELECT *, v - avg(v) OVER (PARTITION BY threshold, pct_threshold) AS d FROM met),
tested AS (
  SELECT threshold, pct_threshold, count(v) AS n, avg(v) AS mean, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4
  FROM centred GROUP BY ALL)
SELECT threshold, n / CAST(periods AS DOUBLE) AS weeks_per_occurrence, pct_threshold,
  CASE WHEN m2 > 0 THEN round(exp(-(n / 6e0 * (m3 * m3 / (m2 * m2 * m2) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4)) / 2), 9) END AS p_value,
  n AS observations, round(mean - everybody, 6) AS advantage, round(mean, 6) AS outcome
FROM tested, all_sides"""
    )
    sql["low_accuracy_cut"] = (
        _FORM
        + f""", low AS (SELECT cash FROM sides
  WHERE actual_fg_att IS NOT NULL AND xppg IS NOT NULL AND actual_fg_made IS NOT NULL AND cash IS NOT NULL
    AND fg_att > 0 AND fg_made IS NOT NULL AND adj_exp_att IS NOT NULL AND games IS NOT NULL AND pct <= 0.65e0),
counted AS (SELECT count(*) AS n, CAST(sum(CASE WHEN cash = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  CAST(sum(CASE WHEN cash = -1 THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM low)
SELECT 0.65e0 AS max_pct, n AS observations, hits - misses AS profit, (n / 2e0 + (hits - misses)) / n AS hit_rate_ref,
  hits / CAST(hits + misses AS DOUBLE) AS hit_rate, round({_jb("n", "hits", "misses")}, 6) AS jb,
  round(exp(-({_jb("n", "hits", "misses")}) / 2), 9) AS p_value FROM counted"""
    )
    near = "h.{c} >= {t} * {lo}e0 AND h.{c} <= {t} * {hi}e0"
    comparable = (
        near.format(c="exp_points", t="p.exp_points", lo="0.95", hi="1.05")
        + " AND "
        + near.format(c="kick_pct", t="p.kick_pct", lo="0.95", hi="1.05")
    )
    with_history = f""",
probes AS (SELECT DISTINCT exp_points, kick_pct FROM sides WHERE exp_points IS NOT NULL AND kick_pct IS NOT NULL),
alike AS (
  SELECT p.exp_points, p.kick_pct, CAST(sum(h.points) AS BIGINT) / CAST(count(*) AS DOUBLE) AS historical_points
  FROM probes p JOIN sides h ON {comparable} GROUP BY p.exp_points, p.kick_pct)
"""
    sql["historical_comparables"] = (
        _FORM
        + with_history
        + """SELECT s.game_id, s.season, s.week, s.side, s.team, s.exp_points, s.kick_pct, s.points, historical_points
FROM sides s LEFT JOIN alike c ON c.exp_points = s.exp_points AND c.kick_pct = s.kick_pct"""
    )
    sql["games_with_comparables"] = (
        _FORM
        + with_history
        + """, answered AS (SELECT s.*, historical_points FROM sides s
  LEFT JOIN alike c ON c.exp_points = s.exp_points AND c.kick_pct = s.kick_pct)
SELECT h.game_id, h.exp_points AS home_exp_points, h.kick_pct AS home_kick_pct, h.points AS home_points,
  h.historical_points AS home_historical_points, a.exp_points AS away_exp_points, a.kick_pct AS away_kick_pct,
  a.points AS away_points, a.historical_points AS away_historical_points
FROM answered h JOIN answered a ON h.game_id = a.game_id AND h.side = 'home' AND a.side = 'away'"""
    )
    sql["comparables_past_only"] = (
        _FORM
        + f""",
probes AS (SELECT DISTINCT season, week, exp_points, kick_pct FROM sides
  WHERE exp_points IS NOT NULL AND kick_pct IS NOT NULL)
SELECT p.season, p.week, p.exp_points, p.kick_pct, count(*) AS comparables,
  CAST(sum(h.points) AS BIGINT) / CAST(count(*) AS DOUBLE) AS historical_points
FROM probes p JOIN sides h ON h.season * 100 + h.week < p.season * 100 + p.week AND {comparable}
GROUP BY p.season, p.week, p.exp_points, p.kick_pct"""
    )
    board = " WHERE s.season = 2000 AND s.week = 20"
    sql["week_board"] = (
        _FORM
        + with_history
        + """SELECT s.game_id, s.side, s.team, s.exp_att, s.exp_points, s.roof, s.kick_pct, historical_points
FROM sides s LEFT JOIN alike c ON c.exp_points = s.exp_points AND c.kick_pct = s.kick_pct"""
        + board
    )
    sql["threshold_report"] = (
        _FORM
        + _HISTORY_ZERO
        + f""", counted AS (
  SELECT s.game_id, s.side, s.team, s.exp_att AS threshold, s.kick_pct AS pct_threshold, count(h.cash) AS n,
         coalesce(sum(CASE WHEN h.cash = 1 THEN 1 ELSE 0 END), 0) AS hits,
         coalesce(sum(CASE WHEN h.cash = -1 THEN 1 ELSE 0 END), 0) AS misses
  FROM sides s LEFT JOIN history h
    ON {near.format(c="pct", t="s.kick_pct", lo="0.94", hi="1.06")}
    AND {near.format(c="adj_exatt", t="s.exp_att", lo="0.94", hi="1.06")}
  {board} GROUP BY ALL)"""
        + _verdict("(SELECT * FROM counted, period)", "game_id, side, team, threshold, pct_threshold")
    )
    sql["weekly_report"] = f"""
SELECT threshold, weeks_per_occurrence AS weeksperoccurence, o_u, pct_threshold AS kickpctthresh, p_value AS pvalue,
       CAST(observations AS INTEGER) AS observations, team, CAST(profit AS INTEGER) AS profit, hit_rate_ref AS hitrate
FROM ({sql["threshold_report"]})"""
    sql["over_under_flip"] = (
        _FORM
        + """, period AS (SELECT count(*) AS periods FROM (SELECT DISTINCT season, week FROM sides)),
counted AS (SELECT team, count(cash) AS n, sum(CASE WHEN cash = 1 THEN 1 ELSE 0 END) AS hits,
  sum(CASE WHEN cash = -1 THEN 1 ELSE 0 END) AS misses FROM sides WHERE cash IS NOT NULL GROUP BY team)"""
        + _verdict("(SELECT * FROM counted, period)", "team")
    )

    cuts = " UNION ALL ".join(
        f"SELECT '{flag}' AS o_u, {_sql_double(lo)} AS min_exatt, {_sql_double(hi)} AS max_exatt, "
        f"{_sql_double(plo)} AS min_pct, {_sql_double(phi)} AS max_pct"
        for flag, lo, hi, plo, phi in CUTS
    )
    sql["cut_rules"] = (
        _FORM
        + _HISTORY_ZERO
        + f""", rules AS ({cuts}),
counted AS (
  SELECT o_u AS flag, min_exatt, max_exatt, min_pct, max_pct, count(cash) AS n,
         coalesce(sum(CASE WHEN cash = 1 THEN 1 ELSE 0 END), 0) AS hits,
         coalesce(sum(CASE WHEN cash = -1 THEN 1 ELSE 0 END), 0) AS misses
  FROM rules LEFT JOIN history ON (min_exatt IS NULL OR exatt >= min_exatt) AND (max_exatt IS NULL OR exatt <= max_exatt)
    AND (min_pct IS NULL OR pct >= min_pct) AND (max_pct IS NULL OR pct <= max_pct)
  GROUP BY ALL)"""
        + _verdict("(SELECT * FROM counted, period)", "min_exatt, max_exatt, min_pct, max_pct", "flag")
    )
    sql["points_by_expectation"] = (
        _FORM
        + f"""SELECT exp_points > 4e0 AS above, {_summary_moments('CAST(points AS DOUBLE)')} FROM sides
WHERE exp_points IS NOT NULL GROUP BY above"""
    )
    sql["correlation_attempts"] = (
        _FORM
        + """, attempts AS (SELECT actual_fg_att AS fgatt, actual_pat_made AS xpmade, actual_fg_made AS fgmade, cash,
  fg_att AS pastatt, fg_made AS pastmade, exp_att AS exatt, pct FROM sides
  WHERE actual_fg_att IS NOT NULL AND fg_att > 0 AND exp_att IS NOT NULL) """
        + _matrix("fgatt xpmade fgmade cash pastatt pastmade exatt pct".split(), "attempts")
    )

    # --- sketches, SQL text -----------------------------------------------------------------
    sql["approximate_quantiles"] = (
        _FORM
        + """SELECT season, quantile, count(*) AS n, true AS within FROM sides, (VALUES ('q25'), ('q50'), ('q88'), ('q95')) AS v(quantile)
WHERE exp_points IS NOT NULL GROUP BY season, quantile"""
    )
    sql["sql_attempts_per_game"] = (
        _LINES
        + """, kicks AS (SELECT season, team, CAST(sum(fg_att) AS BIGINT) AS fg_att, CAST(sum(points) AS BIGINT) AS points FROM weekly GROUP BY ALL),
played AS (SELECT season, team, count(*) AS games FROM side_rows GROUP BY ALL)
SELECT season, team, fg_att, points, games, fg_att / CAST(games AS DOUBLE) AS attpg FROM kicks LEFT JOIN played USING (season, team)"""
    )
    sql["sql_opponents"] = (
        _LINES
        + """, kicks AS (SELECT season, week, team, CAST(sum(fg_att) AS BIGINT) AS fg_att FROM weekly GROUP BY ALL)
SELECT k.*, away_team AS oppteam FROM kicks k JOIN schedule s ON s.season = k.season AND s.week = k.week AND s.home_team = k.team
UNION SELECT k.*, home_team FROM kicks k JOIN schedule s ON s.season = k.season AND s.week = k.week AND s.away_team = k.team"""
    )
    sql["sql_late_season_by_roof"] = (
        _FORM
        + """SELECT roof, avg(actual_fg_made) AS fgm, count(*) FILTER (WHERE actual_fg_made >= 2) AS over
FROM sides WHERE week > 14 GROUP BY roof"""
    )

    # --- regressions ----------------------------------------------------------------------
    sql["ols_simple"] = (
        _FORM
        + """, complete AS (SELECT *, pct * exp_att AS pctadj FROM sides WHERE exp_att IS NOT NULL AND actual_fg_att IS NOT NULL
  AND fg_att > 0 AND fg_made IS NOT NULL AND cash IS NOT NULL)
SELECT 'points' AS target, 'exp_att' AS regressor, regr_count(points, exp_att) AS n,
  round(regr_slope(points, exp_att), 6) AS slope, round(regr_intercept(points, exp_att), 6) AS intercept,
  round(regr_r2(points, exp_att), 6) AS r2 FROM sides
UNION ALL SELECT 'actual_fg_att', 'exp_att', regr_count(actual_fg_att, exp_att), round(regr_slope(actual_fg_att, exp_att), 6),
  round(regr_intercept(actual_fg_att, exp_att), 6), round(regr_r2(actual_fg_att, exp_att), 6) FROM complete
UNION ALL SELECT 'actual_fg_made', 'pct*exp_att', regr_count(actual_fg_made, pctadj), round(regr_slope(actual_fg_made, pctadj), 6),
  round(regr_intercept(actual_fg_made, pctadj), 6), round(regr_r2(actual_fg_made, pctadj), 6) FROM complete"""
    )
    attempted = "CASE WHEN fg_att > 0 THEN pct END"

    def two(y: str, x1: str, x2: str) -> str:
        """Two regressors per season in closed form."""
        v = {f"{a}{b}": f"covar_pop({p}, {q})" for a, p in (("1", x1), ("2", x2), ("y", y)) for b, q in (("1", x1), ("2", x2), ("y", y))}
        return f"""SELECT season, count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, {v["yy"]} AS cyy, {v["1y"]} AS c1y, {v["2y"]} AS c2y,
  ({v["1y"]} * {v["22"]} - {v["2y"]} * {v["12"]}) / ({v["11"]} * {v["22"]} - {v["12"]} * {v["12"]}) AS b1,
  ({v["2y"]} * {v["11"]} - {v["1y"]} * {v["12"]}) / ({v["11"]} * {v["22"]} - {v["12"]} * {v["12"]}) AS b2
  FROM rows WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL GROUP BY season"""

    fitted = """SELECT season, '{y}' AS target, '{terms}' AS terms, n, round((b1 * c1y + b2 * c2y) / cyy, 6) AS r2,
  round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS first, round(b2, 6) AS second FROM ({inner})"""
    sql["ols_by_season"] = (
        _FORM
        + f""", rows AS (SELECT season, CAST(points AS DOUBLE) AS points, exp_att, CAST(actual_fg_made AS DOUBLE) AS made, {attempted} AS pct, xppg,
  {attempted} * exp_att AS pct_att FROM sides)
SELECT season, 'points' AS target, 'exp_att' AS terms, regr_count(points, exp_att) AS n, round(regr_r2(points, exp_att), 6) AS r2,
  round(regr_intercept(points, exp_att), 6) AS intercept, round(regr_slope(points, exp_att), 6) AS first, CAST(NULL AS DOUBLE) AS second
FROM rows GROUP BY season UNION ALL """
        + fitted.format(y="made", terms="pct,exp_att", inner=two("made", "pct", "exp_att"))
        + " UNION ALL "
        + fitted.format(y="points", terms="pct:exp_att,xppg", inner=two("points", "pct_att", "xppg"))
    )
    sql["ols_two"] = (
        _FORM
        + f""", rows AS (SELECT actual_fg_made AS made, {attempted} AS pct, exp_att FROM sides
  WHERE actual_fg_made IS NOT NULL AND fg_att > 0 AND fg_made IS NOT NULL AND exp_att IS NOT NULL)"""
        + _normal_equations("made", "pct", "exp_att")
    )
    sql["ols_interaction"] = (
        _FORM
        + """, rows AS (SELECT points AS y, xppg, adj_exp_att, pct FROM sides
  WHERE xppg IS NOT NULL AND adj_exp_att IS NOT NULL AND fg_att > 0 AND fg_made IS NOT NULL)"""
        + _residual_steps(
            "y",
            ["xppg", "adj_exp_att", "pct", "adj_exp_att * pct"],
            ["xppg", "adj_exp_att", "pct", "adj_exp_att:pct"],
        )
    )
    sql["ols_allowed_kicked"] = (
        _FORM
        + """, rows AS (SELECT actual_fg_att AS y, opp_allowed_rate AS allowed, own_rate AS kicked FROM sides
  WHERE actual_fg_att IS NOT NULL AND opp_allowed_rate IS NOT NULL AND own_rate IS NOT NULL)"""
        + _residual_steps("y", ["allowed", "kicked", "allowed * kicked"], ["allowed", "kicked", "allowed:kicked"])
    )
    home_rows = """, rows AS (SELECT points AS y, coalesce(adj_exp_att, 0e0) AS adj_exp_att,
  coalesce(kick_pct, 0e0) AS kick_pct, coalesce(xppg, 0e0) AS xppg FROM sides WHERE side = 'home')"""
    home_terms = ["adj_exp_att", "kick_pct", "xppg"]
    sql["ols_points_home"] = _FORM + home_rows + _residual_steps("y", home_terms, home_terms)
    solved = _residual_steps("y", home_terms, home_terms)
    steps, final = solved.split(" SELECT unnest(", 1)
    inner = final.split(" AS coefficient FROM ", 1)[1]
    mean = " - ".join(["(SELECT avg(y) FROM r0)"] + [f"b{i} * (SELECT avg(x{i}) FROM r0)" for i in range(3)])
    sql["ols_points_predict"] = (
        _FORM
        + home_rows
        + steps
        + f""", fitted AS (SELECT b0, b1, b2, {mean} AS b FROM {inner})
SELECT game_id, round(b + b0 * coalesce(adj_exp_att, 0e0) + b1 * coalesce(kick_pct, 0e0) + b2 * coalesce(xppg, 0e0), 6)
  AS predicted FROM sides, fitted WHERE side = 'home'"""
    )
    return sql
