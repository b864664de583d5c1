"""Queries of the rating and league-table family."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.scalars import elo_after, elo_expected
from touchline.operators import ratings as rt
from touchline.operators import standings as st
from touchline.plans import views as v
from touchline.plans.registry import query, rounded, sql_rounded
from touchline.sources.tables import read_table

GAME = ["contest_id", "ts", "pool", "home_id", "away_id", "home_score", "away_score"]


def _put(lst: str, at: str, val: str) -> str:
    return f"list_concat(list_concat(list_slice({lst}, 1, {at} - 1), [{val}]), list_slice({lst}, {at} + 1, len({lst})))"


_ELO = f"""WITH RECURSIVE {v.CONTESTS_SQL}, num AS MATERIALIZED (SELECT contest_id, pool, ts, home_id + 1 AS h, away_id + 1 AS a, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END AS s,
  row_number() OVER (PARTITION BY pool ORDER BY ts, contest_id) AS rn FROM contests),
size AS (SELECT max(greatest(h, a)) AS m FROM num),
r(pool, rn, contest_id, home_elo, away_elo, l) AS (SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), list_resize([CAST(1500 AS DOUBLE)], m, CAST(1500 AS DOUBLE)) FROM num, size
UNION ALL SELECT q.pool, q.rn, q.contest_id, q.rh, q.ra, {_put(_put('q.l', 'q.h', 'q.rh + q.mv'), 'q.a', 'q.ra - q.mv')}
FROM (SELECT n.*, r.l, r.l[n.h] AS rh, r.l[n.a] AS ra, 32.0 * (n.s - 1.0 / (1.0 + power(10.0, (r.l[n.a] - r.l[n.h]) / 400.0))) AS mv FROM r JOIN num n ON n.pool = r.pool AND n.rn = r.rn + 1) q)
"""


@query("elo_pool", _ELO + f"SELECT pool, contest_id, {sql_rounded(['home_elo', 'away_elo'], 5)} FROM r WHERE rn > 0")
def elo_pool(spark, sf):
    return rounded(rt.elo_fold(v.contests(spark, sf), ["pool"], at_most=v.rows_in(spark, sf, "orders"))[0], ["pool", "contest_id"], ["home_elo", "away_elo"], 5)


@query("elo_table", _ELO + f""", fin AS (SELECT pool, arg_max(l, rn) AS l FROM r GROUP BY pool), f AS (SELECT pool, unnest(l) AS elo, unnest(range(len(l))) AS team FROM fin),
seen AS (SELECT pool, team, count(*) AS played, max(ts) AS last_ts FROM (SELECT pool, ts, h - 1 AS team FROM num UNION ALL SELECT pool, ts, a - 1 FROM num) GROUP BY ALL)
SELECT pool, team, played, last_ts, {sql_rounded(['elo'], 5)} FROM f JOIN seen USING (pool, team)""")
def elo_table(spark, sf):
    """Every current rating with contests played and last contest."""
    games = v.contests(spark, sf)
    log = games.select("pool", "ts", F.explode(F.array("home_id", "away_id")).alias("team"))
    return rounded(rt.rating_table(rt.elo_fold(games, ["pool"], at_most=v.rows_in(spark, sf, "orders"))[1], log, ["pool"], "elo"), ["pool", "team", "played", "last_ts"], ["elo"], 5)


@query("elo_step", f"""WITH {v.CONTESTS_SQL}, x AS (SELECT contest_id, 1400.0 + home_id AS h, 1450.0 + away_id * 0.5 AS a, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END AS s FROM contests),
y AS (SELECT contest_id, 1 / (1 + power(10, (a - h) / 400)) AS expected, h + 32 * (s - 1 / (1 + power(10, (a - h) / 400))) AS home_after, a + 32 * ((1 - s) - 1 / (1 + power(10, (h - a) / 400))) AS away_after FROM x)
SELECT contest_id, {sql_rounded(['expected', 'home_after', 'away_after'])} FROM y""")
def elo_step(spark, sf):
    """One Elo update of every contest from given ratings."""
    s = F.when(F.col("home_score") > F.col("away_score"), 1.0).when(F.col("home_score") == F.col("away_score"), 0.5).otherwise(0.0)
    rows = v.contests(spark, sf).select("contest_id", (F.col("home_id") + 1400.0).alias("h"), (F.col("away_id") * 0.5 + 1450.0).alias("a"), s.alias("s"))
    return rounded(rows.select("contest_id", elo_expected("h", "a").alias("expected"), elo_after("h", "a", "s").alias("home_after"),
                               elo_after("a", "h", 1 - F.col("s")).alias("away_after")), ["contest_id"], ["expected", "home_after", "away_after"])


@query("glicko_pool")
def glicko_pool(spark, sf):
    shots = rt.glicko_fold(v.contests(spark, sf), ["pool"], at_most=v.rows_in(spark, sf, "orders"))[0]
    return rounded(rt.glicko_chances(shots), ["pool", "contest_id"], ["home_rating", "home_rd", "away_rating", "away_rd", "p_home", "p_draw", "p_away"], 4)


@query("glicko_period")
def glicko_period(spark, sf):
    return rounded(rt.glicko_periods(v.contests(spark, sf), ["pool"], "year")[1], ["pool", "team"], ["rating", "rd", "volatility"], 4)


_PHI = "sqrt(1 + 3 * power(rd / 173.7178, 2) / power(pi(), 2))"


@query("rating_chances", f"""WITH x AS (SELECT s_suppkey AS id, 1400 + s_suppkey % 200 AS h, 1450 + s_acctbal / 100 AS a, 50.0 + s_nationkey * 10 AS rd FROM supplier),
e AS (SELECT id, 1 / (1 + exp(-(1 / {_PHI}) * ((h - a) / 173.7178))) AS e FROM x), p AS (SELECT id, greatest(0.0, e - 0.125) AS p_home FROM e),
q AS (SELECT *, greatest(0.0, 0.75 - p_home) AS p_away FROM p), z AS (SELECT *, greatest(0.0, 1 - p_home - p_away) AS p_draw FROM q) SELECT id, {sql_rounded(['p_home', 'p_draw', 'p_away'])} FROM z""")
def rating_chances(spark, sf):
    rows = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 200 + 1400.0).alias("home_rating"),
                                                    (F.col("s_acctbal") / 100 + 1450).alias("away_rating"), (F.col("s_nationkey") * 10 + 50.0).alias("away_rd"))
    return rounded(rt.glicko_chances(rows), ["id"], ["p_home", "p_draw", "p_away"])


_STATES = f"""{v.LOG_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY ts, contest_id) AS g FROM contests),
st AS (SELECT l.pool, l.team, n.g, sum(pts) OVER w AS pts, sum(score - score_ag) OVER w AS gd, sum(score) OVER w AS gf FROM log l JOIN num n USING (contest_id) WINDOW w AS (PARTITION BY l.pool, l.team ORDER BY n.g)),
teams AS (SELECT DISTINCT pool, team FROM st),
spots AS (SELECT n.pool, n.contest_id, n.g, t.team FROM num n JOIN teams t USING (pool)),
cur AS (SELECT a.contest_id, a.pool, a.team, s.pts, s.gd, s.gf FROM spots a ASOF JOIN st s ON a.pool = s.pool AND a.team = s.team AND s.g < a.g)"""


@query("standings_before", f"""WITH {_STATES},
rk AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY pts DESC, gd DESC, gf DESC, team) AS pos FROM cur), cnt AS (SELECT contest_id, count(*) AS n FROM cur GROUP BY contest_id)
SELECT l.contest_id, l.team, l.side, CASE WHEN coalesce(n, 0) < 4 THEN 10.0 ELSE coalesce(pos, (n + 1) / 2.0) END AS position,
CAST(CASE WHEN coalesce(n, 0) < 4 THEN 0 ELSE coalesce(r.pts, 0) END AS BIGINT) AS table_pts, CAST(CASE WHEN coalesce(n, 0) < 4 THEN 0 ELSE coalesce(r.gd, 0) END AS BIGINT) AS table_gd
FROM log l LEFT JOIN cnt USING (contest_id) LEFT JOIN rk r ON r.contest_id = l.contest_id AND r.team = l.team""")
def standings_before(spark, sf):
    return st.standings_before(v.team_log(spark, sf)).select("contest_id", "team", "side", "position", "table_pts", "table_gd")


@query("standings_points_only", f"""WITH {_STATES},
rk AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY pts DESC, team) AS pos FROM cur WHERE pts > 0), cnt AS (SELECT contest_id, count(*) AS n FROM cur WHERE pts > 0 GROUP BY contest_id)
SELECT l.contest_id, l.team, l.side, CAST(coalesce(pos, coalesce(n, 0) + 1) AS DOUBLE) AS position, CAST(coalesce(r.pts, 0) AS BIGINT) AS table_pts
FROM log l LEFT JOIN cnt USING (contest_id) LEFT JOIN rk r ON r.contest_id = l.contest_id AND r.team = l.team""")
def standings_points_only(spark, sf):
    return st.standings_before(v.team_log(spark, sf), points_only=True).select("contest_id", "team", "side", "position", "table_pts")


@query("standings_at", f"""WITH {v.LOG_SQL}, t AS (SELECT pool, team, CAST(sum(pts) AS BIGINT) AS points, CAST(sum(score - score_ag) AS BIGINT) AS gd, CAST(sum(score) AS BIGINT) AS gf, count(*) AS played
FROM log WHERE ts < TIMESTAMP '1999-07-01' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY pool ORDER BY points DESC, gd DESC, gf DESC, team) AS position FROM t""")
def standings_at(spark, sf):
    return st.standings_at(v.team_log(spark, sf), "1999-07-01")




@query("goal_grid", """WITH x AS (SELECT p_partkey AS id, 0.6 + p_size / CAST(25 AS DOUBLE) AS lam, 0.5 + (p_partkey % 20) / CAST(12 AS DOUBLE) AS mu FROM part),
k AS (SELECT CAST(k AS INT) AS k, factorial(CAST(k AS INT)) AS f FROM generate_series(0, 8) t(k)),
g AS (SELECT id, i.k AS i, j.k AS j, exp(-lam) * power(lam, i.k) / i.f * exp(-mu) * power(mu, j.k) / j.f * greatest(0, CASE WHEN i.k = 0 AND j.k = 0 THEN 1 + lam * mu * 0.08 WHEN i.k = 0 AND j.k = 1 THEN 1 - lam * 0.08
 WHEN i.k = 1 AND j.k = 0 THEN 1 - mu * 0.08 WHEN i.k = 1 AND j.k = 1 THEN 1 + 0.08 ELSE 1 END) AS p FROM x, k i, k j),
s AS (SELECT id, sum(p) FILTER (i > j) / sum(p) AS p_home, sum(p) FILTER (i = j) / sum(p) AS p_draw, sum(p) FILTER (i < j) / sum(p) AS p_away FROM g GROUP BY id) SELECT id, """ + sql_rounded(["p_home", "p_draw", "p_away"]) + " FROM s")
def goal_grid(spark, sf):
    rows = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 25.0 + 0.6).alias("lam"), ((F.col("p_partkey") % 20) / 12.0 + 0.5).alias("mu"))
    return rounded(rt.goal_grid(rows, "lam", "mu", rho=-0.08), ["id"], ["p_home", "p_draw", "p_away"])
