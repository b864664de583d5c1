"""Queries of the trailing-history family."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import form as fm
from touchline.operators.history import as_of_date, asof_attach, trailing
from touchline.plans import views as v
from touchline.functions.scalars import rnd
from touchline.plans.registry import ORACLES, query, rounded, sql_rounded
from touchline.sources.tables import read_table

KEYS = ["contest_id", "team", "side"]
_W = "WINDOW w AS (PARTITION BY {p} ORDER BY ts, contest_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_FORM = """SELECT contest_id, team, side, coalesce(avg(pts / 3.0) OVER w, 0.5) AS points, coalesce(avg(score) OVER w, 1.3) AS goals_for,
  coalesce(avg(score_ag) OVER w, 1.3) AS goals_against, coalesce(avg((pts = 3)::INT) OVER w, 0.33) AS wins,
  coalesce(avg((pts = 1)::INT) OVER w, 0.25) AS draws, coalesce(avg((pts = 0)::INT) OVER w, 0.33) AS losses FROM log """


def form_sql(partition: str, n: int = 5) -> str:
    return (f"WITH {v.LOG_SQL}, x AS ({_FORM}{_W.format(p=partition, n=n)}) "
            f"SELECT contest_id, team, side, {sql_rounded(list(fm.FORM_DEFAULTS))} FROM x")


def _form_query(within):
    def run(spark, sf):
        hot = v.hot_teams(spark, sf)
        if hot and within:
            hot = None
        return rounded(fm.form(v.team_log(spark, sf), 5, within, hot), KEYS, list(fm.FORM_DEFAULTS))
    return run


query("form_last5", form_sql("team"))(_form_query([]))
query("form_side_last5", form_sql("team, side"))(_form_query(["side"]))
query("form_pool_last5", form_sql("team, pool"))(_form_query(["pool"]))

# Runs counted from gaps and islands; the bound is the number of earlier rows looked at.
_RUNS = """isl AS (SELECT *, row_number() OVER t AS rn, count(*) FILTER (pts <> 3) OVER t AS nw, count(*) FILTER (pts <> 0) OVER t AS nl
  FROM log WINDOW t AS (PARTITION BY team ORDER BY ts, contest_id)),
runs AS (SELECT *, row_number() OVER (PARTITION BY team, nw ORDER BY rn) - CASE WHEN nw = 0 THEN 0 ELSE 1 END AS w_after,
  row_number() OVER (PARTITION BY team, nl ORDER BY rn) - CASE WHEN nl = 0 THEN 0 ELSE 1 END AS l_after FROM isl),
streak AS (SELECT contest_id, team, side, ts,
  CAST(least({far}, coalesce(lag(w_after) OVER t, 0)) AS INT) AS win_streak,
  CAST(least({far}, coalesce(lag(l_after) OVER t, 0)) AS INT) AS loss_streak
  FROM runs WINDOW t AS (PARTITION BY team ORDER BY ts, contest_id))"""


@query("form_advanced", f"""WITH {v.LOG_SQL}, {_RUNS.format(far=10)},
x AS (SELECT contest_id, team, side, coalesce(avg((score_ag = 0)::INT) OVER w, 0.25) AS clean_sheet,
  coalesce(avg((score = 0)::INT) OVER w, 0.2) AS failed_to_score, coalesce(avg((score > 0 AND score_ag > 0)::INT) OVER w, 0.5) AS both_scored,
  coalesce(stddev_samp(score) OVER w, 1.0) AS goals_std FROM log {_W.format(p='team', n=10)})
SELECT x.contest_id, x.team, x.side, win_streak, loss_streak, {sql_rounded(list(fm.ADVANCED_DEFAULTS))}
FROM x JOIN streak s ON s.contest_id = x.contest_id AND s.team = x.team""")
def form_advanced(spark, sf):
    out = fm.advanced_form(v.team_log(spark, sf), 10, v.hot_teams(spark, sf))
    return rounded(out, [*KEYS, "win_streak", "loss_streak"], list(fm.ADVANCED_DEFAULTS))


@query("streaks", f"WITH {v.LOG_SQL}, {_RUNS.format(far=20)} SELECT contest_id, team, side, win_streak, loss_streak FROM streak")
def streaks(spark, sf):
    return fm.result_streaks(v.team_log(spark, sf), 20, v.hot_teams(spark, sf)).select(*KEYS, "win_streak", "loss_streak")


@query("rest_days", f"""WITH {v.LOG_SQL}, x AS (SELECT contest_id, team, side, date_diff('day', lag(ts) OVER t, ts) AS gap
  FROM log WINDOW t AS (PARTITION BY team ORDER BY ts, contest_id))
SELECT contest_id, team, side, CAST(CASE WHEN gap IS NULL THEN 7 ELSE least(gap, 30) END AS INT) AS rest,
  CAST(CASE WHEN gap IS NULL THEN 14 ELSE least(gap, 21) END AS INT) AS rest_21, CAST(gap AS INT) AS rest_raw FROM x""")
def rest(spark, sf):
    raw = fm.rest_days(v.team_log(spark, sf), None, None, v.hot_teams(spark, sf))
    return raw.select(*KEYS, F.coalesce(F.when(F.col("rest").isNotNull(), F.least("rest", F.lit(30))), F.lit(7)).alias("rest"),
                      F.coalesce(F.when(F.col("rest").isNotNull(), F.least("rest", F.lit(21))), F.lit(14)).alias("rest_21"),
                      F.col("rest").alias("rest_raw"))


def skipping_sql(cond: str, feats: dict[str, str]) -> str:
    """State after each counted row, taken over by ASOF JOIN on the row number."""
    inner = ", ".join(f"{e} AS {k}" for k, e in feats.items())
    return f"""WITH {v.LOG_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, contest_id) AS rn FROM log),
st AS (SELECT team, rn, {inner} FROM num WHERE {cond}
  WINDOW w5 AS (PARTITION BY team ORDER BY rn ROWS 4 PRECEDING), w10 AS (PARTITION BY team ORDER BY rn ROWS 9 PRECEDING)),
x AS (SELECT n.contest_id, n.team, n.side, {", ".join("st." + k for k in feats)} FROM num n ASOF LEFT JOIN st ON st.team = n.team AND st.rn < n.rn)"""


_XG = {f"{k}_{n}": f"avg({c}) OVER w{n}" for n in (5, 10) for k, c in (("f", "xg"), ("a", "xg_ag"))}
_XG["o"] = "avg(score - xg) OVER w10"
XG_COLS = [f"{k}_{n}" for n in (5, 10) for k in ("xg_for", "xg_against", "xg_diff", "xg_ratio")] + ["xg_over"]
_XG_Y = ", ".join(f"coalesce(f_{n}, 1.3) AS xg_for_{n}, coalesce(a_{n}, 1.3) AS xg_against_{n}" for n in (5, 10))
_XG_Z = ", ".join(f"xg_for_{n} - xg_against_{n} AS xg_diff_{n}, CASE WHEN xg_against_{n} > 0 THEN xg_for_{n} / xg_against_{n} "
                  f"ELSE 1.0 END AS xg_ratio_{n}" for n in (5, 10))


@query("xg_history", skipping_sql("xg IS NOT NULL AND xg_ag IS NOT NULL", _XG)
       + f""", y AS (SELECT contest_id, team, side, {_XG_Y}, coalesce(o, 0.0) AS xg_over FROM x), z AS (SELECT *, {_XG_Z} FROM y)
SELECT contest_id, team, side, {sql_rounded(XG_COLS)} FROM z""")
def xg_history(spark, sf):
    return rounded(fm.xg_history(v.team_log(spark, sf, ["score", "xg"]), hot=v.hot_teams(spark, sf)), KEYS, XG_COLS)


_STAT_SRC = {"sot_for": "sot", "sot_against": "sot_ag", "box_for": "box", "box_against": "box_ag", "possession": "poss",
             "corners": "corners", "saves": "saves", "passes_acc": "pass_acc"}


def _coalesced(defaults: dict[str, float], prefix: str = "") -> str:
    return ", ".join(f"coalesce({prefix}{k}, {d}) AS {prefix}{k}" for k, d in defaults.items())


@query("stat_averages", skipping_sql("sot IS NOT NULL AND sot_ag IS NOT NULL", {f"avg_{k}": f"avg({c}) OVER w5" for k, c in _STAT_SRC.items()})
       + f", y AS (SELECT contest_id, team, side, {_coalesced(fm.STAT_DEFAULTS, 'avg_')} FROM x) "
       + f"SELECT contest_id, team, side, {sql_rounded(['avg_' + k for k in fm.STAT_DEFAULTS])} FROM y")
def stat_averages(spark, sf):
    log = v.team_log(spark, sf, ["score", "sot", "box", "poss", "corners", "saves", "pass_acc"])
    return rounded(fm.stat_averages(log, 5, v.hot_teams(spark, sf)), KEYS, [f"avg_{k}" for k in fm.STAT_DEFAULTS])


_EFF = {"conversion": "avg(CASE WHEN sot > 0 THEN score / sot END) OVER w10", "accuracy": "avg(CASE WHEN shots > 0 THEN sot / shots END) OVER w10",
        "box_ratio": "avg(CASE WHEN shots > 0 THEN box / shots END) OVER w10", "save_pct": "avg(CASE WHEN sot_ag > 0 THEN saves / sot_ag END) OVER w10",
        "pass_pct": "avg(CASE WHEN pass_tot > 0 THEN pass_acc / pass_tot END) OVER w10"}


@query("efficiency", skipping_sql("sot IS NOT NULL AND sot_ag IS NOT NULL", _EFF)
       + f", y AS (SELECT contest_id, team, side, {_coalesced(fm.RATE_DEFAULTS)} FROM x) "
       + f"SELECT contest_id, team, side, {sql_rounded(list(fm.RATE_DEFAULTS))} FROM y")
def efficiency(spark, sf):
    log = v.team_log(spark, sf, ["score", "sot", "shots", "box", "saves", "pass_acc", "pass_tot"])
    return rounded(fm.efficiency(log, 10, v.hot_teams(spark, sf)), KEYS, list(fm.RATE_DEFAULTS))


ROLL = ["score", "score_ag", "pts", "xg", "xg_ag", "sot", "sot_ag", "shots", "box", "poss", "corners", "pass_acc"]
ROLL_OUT = [f"{m}_{s}_{n}" for s in ("all", "side") for m in ROLL for n in (5, 10)]
_ROLL_SQL = ", ".join(f"avg({m}) OVER {w}{n} AS {m}_{s}_{n}" for s, w in (("all", "a"), ("side", "s")) for m in ROLL for n in (5, 10))


@query("rolling_matrix", f"""WITH {v.LOG_SQL}, x AS (SELECT contest_id, team, side, {_ROLL_SQL} FROM log WINDOW
 a5 AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 a10 AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
 s5 AS (PARTITION BY team, side ORDER BY ts, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 s10 AS (PARTITION BY team, side ORDER BY ts, contest_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT contest_id, team, side, {sql_rounded(ROLL_OUT)} FROM x""")
def rolling_matrix(spark, sf):
    hot = v.hot_teams(spark, sf)
    log = v.team_log(spark, sf, ["score", "xg", "sot", "shots", "box", "poss", "corners", "pass_acc"])
    wide = fm.rolling_matrix(fm.rolling_matrix(log, ROLL, (5, 10), "all", hot), ROLL, (5, 10), "side", hot)
    return rounded(wide, KEYS, ROLL_OUT)


_EV_SQL = """x AS (SELECT event_id, user_id, avg(value) OVER w5 AS mean_5, avg(value) OVER w10 AS mean_10, stddev_samp(value) OVER w10 AS std_10
  FROM events WINDOW w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


@query("rolling_metric_5_10", f"WITH {_EV_SQL} SELECT event_id, user_id, {sql_rounded(['mean_5', 'mean_10', 'std_10'])} FROM x")
def rolling_metric(spark, sf):
    log = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    feats = {"mean_5": (F.avg("value"), 5, 1), "mean_10": (F.avg("value"), 10, 1), "std_10": (F.stddev_samp("value"), 10, 1)}
    wide = trailing(log, ["user_id"], ["ts", "event_id"], feats, hot=v.hot_in(spark, sf, "events", "user_id"))
    return rounded(wide, ["event_id", "user_id"], list(feats))


STATE = ["xg_for_10", "xg_against_10", "ppg_10", "form_5", "xg_trend", "possession_10", "sot_10", "pass_acc_10", "rating_momentum"]


@query("team_state", f"""WITH {v.LOG_SQL}, {_RUNS.format(far=20)},
x AS (SELECT contest_id, team, side, avg(xg) OVER w10 AS xg_for_10, avg(xg_ag) OVER w10 AS xg_against_10, avg(pts) OVER w10 AS ppg_10,
  avg(pts) OVER w5 AS form_5, avg(xg) OVER w5 - avg(xg) OVER w10 AS xg_trend, avg(poss) OVER w10 AS possession_10, avg(sot) OVER w10 AS sot_10,
  avg(CASE WHEN pass_tot > 0 THEN pass_acc / pass_tot END) OVER w10 AS pass_acc_10, rating - lag(rating, 5) OVER t AS rating_momentum, lag(ts) OVER t AS last_ts
  FROM log WINDOW t AS (PARTITION BY team ORDER BY ts, contest_id),
  w5 AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT x.contest_id, x.team, x.side, x.last_ts, win_streak, loss_streak, {sql_rounded(STATE)} FROM x JOIN streak s ON s.contest_id = x.contest_id AND s.team = x.team""")
def team_state(spark, sf):
    log = v.team_log(spark, sf, ["score", "xg", "poss", "sot", "pass_acc", "pass_tot", "rating"])
    return rounded(fm.team_state(log, v.hot_teams(spark, sf)), [*KEYS, "last_ts", "win_streak", "loss_streak"], STATE)


SPLITS = [f"{k}_{s}_10" for s in ("home", "away") for k in ("xg_for", "ppg")]
_SPLIT_ST = ", ".join(f"{s}_st AS (SELECT team, rn, avg(xg) OVER w AS xg_for_{s}_10, avg(pts) OVER w AS ppg_{s}_10 FROM num WHERE side = '{s}' "
                      f"WINDOW w AS (PARTITION BY team ORDER BY rn ROWS 9 PRECEDING))" for s in ("home", "away"))


@query("side_splits", f"""WITH {v.LOG_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, contest_id) AS rn FROM log), {_SPLIT_ST},
x AS (SELECT n.contest_id, n.team, n.side, h.* EXCLUDE (team, rn), a.* EXCLUDE (team, rn) FROM num n
  ASOF LEFT JOIN home_st h ON h.team = n.team AND h.rn < n.rn ASOF LEFT JOIN away_st a ON a.team = n.team AND a.rn < n.rn)
SELECT contest_id, team, side, {sql_rounded(SPLITS)} FROM x""")
def side_splits(spark, sf):
    return rounded(fm.side_splits(v.team_log(spark, sf, ["score", "xg"]), v.hot_teams(spark, sf)), KEYS, SPLITS)


@query("momentum", f"""WITH {v.LOG_SQL} SELECT contest_id, team, side, lag(rating, 1) OVER t - lag(rating, 5) OVER t AS rating_momentum
FROM log WINDOW t AS (PARTITION BY team ORDER BY ts, contest_id)""")
def momentum(spark, sf):
    return fm.momentum(v.team_log(spark, sf, ["score", "rating"]), "rating", 5, v.hot_teams(spark, sf)).select(*KEYS, "rating_momentum")


H2H = ["h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_goals"]


def _h2h_sql(n: int) -> str:
    return f"""WITH {v.CONTESTS_SQL}, p AS (SELECT *, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b,
  CASE WHEN home_id < away_id THEN home_score - away_score ELSE away_score - home_score END AS d FROM contests),
x AS (SELECT contest_id, home_id, away_id, CAST(count(*) OVER w AS INT) AS h2h_n,
  CASE WHEN home_id = a THEN avg((d > 0)::INT) OVER w ELSE avg((d < 0)::INT) OVER w END AS h2h_home_wins, avg((d = 0)::INT) OVER w AS h2h_draws,
  CASE WHEN home_id = a THEN avg((d < 0)::INT) OVER w ELSE avg((d > 0)::INT) OVER w END AS h2h_away_wins,
  avg(home_score + away_score) OVER w AS h2h_goals,
  CAST(CASE WHEN home_id = a THEN 1 ELSE -1 END * sign(lag(d) OVER (PARTITION BY a, b ORDER BY ts, contest_id)) AS INT) AS h2h_last
  FROM p WINDOW w AS (PARTITION BY a, b ORDER BY ts, contest_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))
SELECT contest_id, home_id, away_id, h2h_n, h2h_last, {sql_rounded(H2H)} FROM x"""


def _h2h(n):
    def run(spark, sf):
        # A pair can only be hot if one of its members is.
        hot = None if v.hot_teams(spark, sf) else []
        return rounded(fm.head_to_head(v.contests(spark, sf), n, hot), ["contest_id", "home_id", "away_id", "h2h_n", "h2h_last"], H2H)
    return run


query("h2h_last5", _h2h_sql(5))(_h2h(5))
query("h2h_last3", _h2h_sql(3))(_h2h(3))


@query("pair_deltas", f"""WITH {v.LOG_SQL}, x AS ({_FORM}{_W.format(p='team', n=5)}),
d AS (SELECT contest_id, {", ".join(f"max(CASE WHEN side = 'home' THEN {c} END) - max(CASE WHEN side = 'away' THEN {c} END) AS delta_{c}" for c in fm.FORM_DEFAULTS)} FROM x GROUP BY contest_id)
SELECT contest_id, {sql_rounded([f'delta_{c}' for c in fm.FORM_DEFAULTS])} FROM d""")
def pair_deltas(spark, sf):
    names = list(fm.FORM_DEFAULTS)
    wide = fm.to_contest(fm.form(v.team_log(spark, sf), 5, [], v.hot_teams(spark, sf)), names)
    return rounded(fm.pair_deltas(wide, names), ["contest_id"], [f"delta_{c}" for c in names])


MIXED = ["dominance", "quality_gap", "home_edge", "away_hotness"]


@query("interactions", f"""WITH t AS MATERIALIZED ({ORACLES["team_state"]}), s AS MATERIALIZED ({ORACLES["side_splits"]}), l AS MATERIALIZED (WITH {v.LOG_SQL} SELECT contest_id, side, pool, rating, pts FROM log),
pr AS (SELECT pool, avg((pts = 3)::INT) AS prior FROM l WHERE side = 'home' GROUP BY pool),
j AS MATERIALIZED (SELECT t.*, l.pool, l.rating, s.ppg_home_10 FROM t JOIN s USING (contest_id, team, side) JOIN l USING (contest_id, side)),
x AS (SELECT h.contest_id, (h.rating - w.rating) * ((h.xg_for_10 - h.xg_against_10) - (w.xg_for_10 - w.xg_against_10)) AS dominance, (h.xg_for_10 - w.xg_against_10) - (w.xg_for_10 - h.xg_against_10) AS quality_gap,
CAST(sign(h.form_5 - w.form_5) + sign({v.sql_rnd('h.xg_trend - w.xg_trend', 5)}) + sign(h.rating_momentum - w.rating_momentum) AS INT) AS alignment, h.ppg_home_10 - prior * 3 AS home_edge, w.win_streak * w.xg_trend AS away_hotness
FROM j h JOIN j w ON w.contest_id = h.contest_id AND h.side = 'home' AND w.side = 'away' JOIN pr ON pr.pool = h.pool) SELECT contest_id, alignment, {sql_rounded(MIXED, 4)} FROM x""")
def interactions(spark, sf):
    """Composite columns built from both sides' states and the pool's home win rate."""
    hot = v.hot_teams(spark, sf)
    log = v.team_log(spark, sf, ["score", "xg", "poss", "sot", "pass_acc", "pass_tot", "rating"])
    names = ["xg_for_10", "xg_against_10", "form_5", "xg_trend", "rating_momentum", "ppg_home_10"]
    state = fm.side_splits(fm.team_state(log, hot), hot)
    state = state.select("contest_id", "side", "pool", "rating", "win_streak", *[rnd(c).alias(c) for c in names])
    wide = fm.to_contest(state, [*names, "rating", "win_streak", "pool"]).withColumnRenamed("home_pool", "pool")
    prior = log.where("side = 'home'").groupBy("pool").agg(F.avg((F.col("pts") == 3).cast("double")).alias("prior_home_wr"))
    h, w = (lambda c: F.col(f"home_{c}")), (lambda c: F.col(f"away_{c}"))
    m = wide.join(prior, "pool").withColumns({
        "rating_gap": h("rating") - w("rating"), "xg_diff_gap": (h("xg_for_10") - h("xg_against_10")) - (w("xg_for_10") - w("xg_against_10")), "form_gap": h("form_5") - w("form_5"),
        "xg_trend_gap": rnd(h("xg_trend") - w("xg_trend"), 5), "momentum_gap": h("rating_momentum") - w("rating_momentum")})
    return rounded(fm.interactions(m), ["contest_id", "alignment"], MIXED, 4)


def absence_reports(spark, sf):
    """Later lines of an order name absent members of either side."""
    li = read_table(spark, sf, "lineitem").where(F.col("l_linenumber") >= 3)
    return li.select(F.col("l_orderkey").alias("contest_id"), F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("member"))


@query("absence_counts", f"""WITH {v.CONTESTS_SQL}, c AS (SELECT l_orderkey AS contest_id, l_suppkey AS team, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL),
x AS (SELECT g.contest_id, home_id, away_id, coalesce(h.n, 0) AS home_absent, coalesce(a.n, 0) AS away_absent FROM contests g
  LEFT JOIN c h ON h.contest_id = g.contest_id AND h.team = home_id LEFT JOIN c a ON a.contest_id = g.contest_id AND a.team = away_id)
SELECT *, home_absent - away_absent AS absent_diff, (home_absent > 0)::INT AS home_any_absent, (away_absent > 0)::INT AS away_any_absent FROM x""")
def absence_counts(spark, sf):
    games = v.contests(spark, sf).select("contest_id", "home_id", "away_id")
    return fm.absences(games, absence_reports(spark, sf).select("contest_id", "team"))


def player_shares(spark, sf):
    """Quantity per (brand, part): a member's amount inside its group."""
    li = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("grp"))
    return fm.share_of_total(part.join(li, F.col("member") == F.col("l_partkey"), "left").select("grp", "member", F.coalesce("qty", F.lit(0.0)).alias("amt")),
                             ["grp"], "member", "amt")


_SHARES = """q AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey),
shares AS (SELECT p_brand AS grp, p_partkey AS member, coalesce(qty, 0.0) AS amount, sum(coalesce(qty, 0.0)) OVER (PARTITION BY p_brand) AS total,
  CASE WHEN total > 0 THEN amount / total ELSE 0.0 END AS share FROM part LEFT JOIN q ON l_partkey = p_partkey)"""


@query("share_of_total", f"WITH {_SHARES} SELECT grp, member, amount, total, {sql_rounded(['share'])} FROM shares")
def share_of_total(spark, sf):
    return rounded(player_shares(spark, sf), ["grp", "member", "amount", "total"], ["share"])


@query("missing_share", f"""WITH {_SHARES}, r AS (SELECT l_orderkey AS contest_id, l_partkey AS member,
  CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side FROM lineitem WHERE l_linenumber >= 3),
x AS (SELECT contest_id, coalesce(sum(share) FILTER (side = 'home'), 0.0) AS home_missing, coalesce(sum(share) FILTER (side = 'away'), 0.0) AS away_missing
  FROM r LEFT JOIN shares USING (member) GROUP BY contest_id)
SELECT contest_id, {sql_rounded(['home_missing', 'away_missing'])} FROM x""")
def missing_share(spark, sf):
    li = read_table(spark, sf, "lineitem").where(F.col("l_linenumber") >= 3)
    reports = li.select(F.col("l_orderkey").alias("contest_id"), F.col("l_partkey").alias("member"),
                        F.when(F.col("l_linenumber") % 2 == 1, "home").otherwise("away").alias("side"))
    return rounded(fm.missing_share(reports, player_shares(spark, sf), "member"), ["contest_id"], ["home_missing", "away_missing"])


@query("roster_gate", f"""WITH r AS (SELECT l_orderkey AS contest_id, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side,
  len(list(DISTINCT l_partkey)) AS n, avg(l_extendedprice) AS strength FROM lineitem GROUP BY ALL),
x AS (SELECT contest_id, max(CASE WHEN side = 'home' AND n >= 2 THEN strength END) AS home_strength, max(CASE WHEN side = 'away' AND n >= 2 THEN strength END) AS away_strength FROM r GROUP BY contest_id),
y AS (SELECT *, home_strength - away_strength AS strength_diff FROM x) SELECT contest_id, {sql_rounded(['home_strength', 'away_strength', 'strength_diff'])} FROM y""")
def roster_gate(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 1, "home").otherwise("away"))
    per = li.groupBy(F.col("l_orderkey").alias("contest_id"), "side", "l_partkey").agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("c"))
    rosters = per.groupBy("contest_id", "side").agg(F.count(F.lit(1)).alias("n"), (F.sum("s") / F.sum("c")).alias("strength"))
    return rounded(fm.gated_strength(rosters, 2, F.col("n")), ["contest_id"], ["home_strength", "away_strength", "strength_diff"])


CUTOFF = "2000-01-01"


@query("state_at_cutoff", f"""WITH {v.LOG_SQL}, x AS (SELECT team, contest_id, ts, rating, pts FROM log WHERE ts < TIMESTAMP '{CUTOFF}')
SELECT team, arg_max(rating, (ts, contest_id)) AS rating, arg_max(pts, (ts, contest_id)) AS pts, count(*) AS n_before, max(ts) AS last_ts FROM x GROUP BY team""")
def state_at_cutoff(spark, sf):
    log = v.team_log(spark, sf, ["score", "rating"])
    return as_of_date(log, ["team"], "ts", "contest_id", CUTOFF, ["rating", "pts"])


@query("asof_state", f"""WITH {v.LOG_SQL}, q AS (SELECT event_id, user_id % 100 AS team, ts - INTERVAL 9000 DAY + INTERVAL 1 HOUR * (event_id % 24) AS ts FROM events),
ranked AS (SELECT team, ts, arg_max(rating, contest_id) AS rating, arg_max(pts, contest_id) AS pts FROM log GROUP BY team, ts)
SELECT q.event_id, q.team, q.ts, r.rating, r.pts FROM q ASOF LEFT JOIN ranked r ON q.team = r.team AND r.ts < q.ts""")
def asof_state(spark, sf):
    """The state of a contest entity at the time of each event (event times shifted into the contest years)."""
    ev = read_table(spark, sf, "events").select(
        (F.col("user_id") % 100).alias("team"),
        F.expr("ts - make_interval(0, 0, 0, 9000, 0, 0, 0) + make_interval(0, 0, 0, 0, cast(event_id % 24 as int), 0, 0)").alias("ts"), "event_id")
    log = v.team_log(spark, sf, ["score", "rating"])
    return asof_attach(ev, log, ["team"], "ts", "contest_id", ["rating", "pts"]).select("event_id", "team", "ts", "rating", "pts")
