"""Queries of the rule, sweep and pick families."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.devig import with_probs
from touchline.functions.scalars import rnd
from touchline.operators import folds as fl
from touchline.operators import metrics as mx
from touchline.operators import rule_index as ri
from touchline.operators import rules as ru
from touchline.operators import sweep as sw
from touchline.operators.factor_table import DEFAULTS, EV_TIERS, FACTORS
from touchline.operators.ledger import first_rows
from touchline.plans import matrix as mt
from touchline.plans import views as v
from touchline.plans.metric_queries import HIT, _HIT_SQL, wilson_sql
from touchline.plans.quote_queries import ODDS, shin_cte
from touchline.plans.registry import query, rounded, sql_rounded
from touchline.plans.views import sql_rnd
from touchline.sources.tables import read_table

# ---- factor scores over the contest matrix ----------------------------------------------------------------------------
_DEF_SQL = "d AS (SELECT contest_id, home_odds, draw_odds, away_odds, target, " + ", ".join(
    f"coalesce({c}, {x}) AS {c}" for c, x in DEFAULTS.items()) + " FROM matrix)"


def score_sql(side: str, subset=None) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for s, n, c, w, _ in FACTORS if s == side and (subset is None or n in subset))


_TIER = "CASE " + " ".join(f"WHEN {{s}} >= {a} THEN {e}" for a, e in EV_TIERS) + " END"
STRUCTURE = {n for s, n, _, _, g in FACTORS if g in ("elo", "table")}
_SCORES_SQL = f"""{mt.MATRIX_SQL}, {_DEF_SQL}, sc AS (SELECT *, {score_sql('home')} AS score_home, {score_sql('away')} AS score_away,
{score_sql('home', STRUCTURE)} AS part_home, {score_sql('away', STRUCTURE)} AS part_away FROM d)"""


@query("weighted_score", f"""WITH {_SCORES_SQL} SELECT contest_id, score_home, score_away, {_TIER.format(s='score_home')} AS min_ev_home, {_TIER.format(s='score_away')} AS min_ev_away,
part_home >= 15 AS gate_home, part_away >= 15 AS gate_away FROM sc""")
def weighted_score(spark, sf):
    m = ru.weighted_scores(mt.contest_matrix(spark, sf))
    return m.select("contest_id", "score_home", "score_away", ru.minimum_ev("score_home").alias("min_ev_home"), ru.minimum_ev("score_away").alias("min_ev_away"),
                    (ru.score("home", STRUCTURE) >= 15).alias("gate_home"), (ru.score("away", STRUCTURE) >= 15).alias("gate_away"))


@query("gap_pick", f"""WITH {_SCORES_SQL}, e AS (SELECT *, score_home >= score_away AS h, abs(score_home - score_away) AS gap, 1 / (1 + power(10, (away_elo - home_elo) / 400)) AS p FROM sc),
x AS (SELECT contest_id, CASE WHEN h THEN 'home' ELSE 'away' END AS side, gap, CASE WHEN h THEN home_odds ELSE away_odds END AS odds, CASE WHEN h THEN p ELSE 1 - p END AS prob FROM e),
k AS (SELECT *, prob * odds - 1 AS ev, least(greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * 0.25), 0.04) AS kelly FROM x WHERE gap >= 40 AND odds BETWEEN 1.5 AND 4)
SELECT contest_id, side, gap, odds, {sql_rounded(['prob', 'ev', 'kelly'])} FROM k""")
def gap_pick(spark, sf):
    m = ru.weighted_scores(mt.contest_matrix(spark, sf))
    return rounded(ru.gap_picks(m, 40, 1.5, 4.0), ["contest_id", "side", "gap", "odds"], ["prob", "ev", "kelly"])


@query("scenario_count", f"""WITH {mt.MATRIX_SQL}, {_DEF_SQL}, c AS (SELECT contest_id, {' + '.join(f'({c})::INT' for c in ru.SCENARIO['home'])} AS n_home, {' + '.join(f'({c})::INT' for c in ru.SCENARIO['away'])} AS n_away FROM d)
SELECT contest_id, n_home, n_away FROM c WHERE n_home >= 3 OR n_away >= 3""")
def scenario(spark, sf):
    m = ru.with_defaults(mt.contest_matrix(spark, sf))
    return m.select("contest_id", ru.scenario_count("home").alias("n_home"), ru.scenario_count("away").alias("n_away")).where("n_home >= 3 OR n_away >= 3")


VARIANTS = {"base": {}, "no_market": {"market": 0.0}, "form_up": {"form": 1.5, "new": 1.5}, "rating_up": {"elo": 2.0}}
OVERRIDES = {"soft_rating": {"elo_gap_large": 4, "elo_gap_away_large": 6, "home_elo_weak": 8, "elo_win_prob_low": 6}}


def _variant_sql(v_: str, side: str) -> str:
    mult, new = VARIANTS.get(v_, {}), OVERRIDES.get(v_, {})
    return " + ".join(f"CASE WHEN {c} THEN CAST({float(new.get(n, int(w))) * float(mult.get(g, 1.0))} AS DOUBLE) ELSE 0 END" for s, n, c, w, g in FACTORS if s == side)


_ALL_VARIANTS = " UNION ALL ".join(f"SELECT contest_id, '{s}' AS side, '{n}' AS variant, {_variant_sql(n, s)} AS score, target, {s}_odds AS odds FROM d" for n in {**VARIANTS, **OVERRIDES} for s in ("home", "away"))


def active_rows(spark, sf):
    """Two rows per contest with the side's factors, packed. They are read before the rows are doubled: inside explode Spark would not compile them."""
    m = ru.with_defaults(mt.contest_matrix(spark, sf))
    m = m.select("contest_id", "home_odds", "away_odds", "target", *[ru.active_factors(s, packed=True).alias(f"{s}_active") for s in ("home", "away")])
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_active").alias("active"), F.col(f"{s}_odds").alias("odds"), (F.col("target") == s).cast("int").alias("won")) for s in ("home", "away")])
    return m.select("contest_id", F.explode(both).alias("v")).select("contest_id", "v.*")


@query("scaled_scores", f"WITH {mt.MATRIX_SQL}, {_DEF_SQL}, a AS ({_ALL_VARIANTS}) SELECT contest_id, side, variant, {sql_rounded(['score'])} FROM a")
def scaled_scores(spark, sf):
    got = ru.scaled_scores(active_rows(spark, sf).select("contest_id", "side", "active"), VARIANTS, OVERRIDES)
    return rounded(got, ["contest_id", "side", "variant"], ["score"])


CUTS = (20.0, 40.0, 60.0, 80.0)


@query("weight_sweep", f"""WITH {mt.MATRIX_SQL}, {_DEF_SQL}, a AS ({_ALL_VARIANTS}), g AS (SELECT variant, cut, (target = side)::INT AS won, odds FROM a, (SELECT unnest({list(CUTS)}) AS cut) WHERE score >= cut AND odds IS NOT NULL),
h AS (SELECT variant, CAST(cut AS DOUBLE) AS cut, {_HIT_SQL} FROM g GROUP BY ALL) SELECT variant, cut, n, wins, {sql_rounded(HIT)} FROM h""")
def weight_sweep(spark, sf):
    """Hit-rate block of every weight variant and score cut."""
    rows = ru.scaled_scores(active_rows(spark, sf).where("odds IS NOT NULL"), VARIANTS, OVERRIDES)
    got = sw.sweep(rows, ["variant"], [sw.Dim("cut", F.col("score"), CUTS, ">=", False)])
    return rounded(got, ["variant", "cut", "n", "wins"], HIT)


@query("tier_pick", f"""WITH {_SCORES_SQL}, s AS (SELECT contest_id, 'home' AS side, score_home AS score, elo_home_win_prob AS prob, home_odds AS odds FROM sc UNION ALL SELECT contest_id, 'away', score_away, 1 - elo_home_win_prob, away_odds FROM sc),
e AS (SELECT *, prob * odds - 1 AS ev, row_number() OVER (PARTITION BY contest_id ORDER BY prob * odds - 1 DESC, side) AS rn FROM s WHERE odds >= 1.5 AND prob * odds - 1 >= {_TIER.format(s='score')})
SELECT contest_id, side, score, odds, {sql_rnd('ev')} AS ev, {sql_rnd('least(greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * 0.25), 0.04)')} AS kelly FROM e WHERE rn = 1""")
def tier_pick(spark, sf):
    m = ru.weighted_scores(mt.contest_matrix(spark, sf)).withColumn("p_home", F.col("elo_home_win_prob")).withColumn("p_away", 1 - F.col("elo_home_win_prob"))
    return rounded(ru.tier_picks(m), ["contest_id", "side", "score", "odds"], ["ev", "kelly"])


# ---- rule strings and matching ----------------------------------------------------------------------------------------
LEAGUES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RULE_TEXT = ["home[1.3,1.8)", "home[1.55,2.0) xg>=1.2", "home[1.7,2.1) xg>=1.2 elo>=30", "home[1.8,2.5) form>=1.8", "home[2.0,3.0) elo>=75 form>=1.8",
             "home[2.2,3.5) mkt>=0.45", "home[1.3,2.6) xg>=1.0 form>=2.0 mkt>=0.4", "away[1.4,2.0) elo<=-30", "away[1.8,2.5) xg>=1.2 elo<=-75", "away[2.2,2.8) form>=2.2",
             "away[1.5,3.2) mkt>=0.5", "away[2.5,3.5) xg>=1.0 elo>=0"]


def rule_table(spark):
    rows = [(league, text) for league in LEAGUES for text in RULE_TEXT]
    return ru.parse_short_rules(spark.createDataFrame(rows, "league string, rule string"))


_RULES_SQL = "rules AS (SELECT l.league, r.rule, regexp_extract(rule, '^(home|away)', 1) AS side, CAST(regexp_extract(rule, '\\[([0-9.]+),', 1) AS DOUBLE) AS lo, CAST(regexp_extract(rule, ',([0-9.]+)\\)', 1) AS DOUBLE) AS hi, " + ", ".join(
    f"TRY_CAST(nullif(regexp_extract(rule, ' {lab}{op}(-?[0-9.]+)', 1), '') AS DOUBLE) AS t_{n}" for n, (lab, op) in ru.SHORT.items()) + \
    f" FROM (SELECT unnest({RULE_TEXT}) AS rule) r, (SELECT unnest({LEAGUES}) AS league) l)"


def _match_sql(top: str) -> str:
    conds = " AND ".join(f"(t_{n} IS NULL OR coalesce({lab} {op} t_{n}, false))" for n, (lab, op) in ru.SHORT.items())
    return f"{v.FACTORS_SQL}, {_RULES_SQL}, m AS (SELECT f.*, rule FROM factors f JOIN rules r ON f.league = r.league AND f.side = r.side AND odds >= lo AND odds {top} hi AND {conds})"


_M = _match_sql("<")


_GE, _LE = {"xg": "r_xg", "elo": "r_elo_ge", "form": "r_form", "mkt": "r_mkt"}, {"elo": "r_elo_le"}


def rule_table_named(spark):
    """The rule table with thresholds named apart from the features."""
    t = rule_table(spark)
    return t.select("league", "rule", "side", "lo", "hi", *[F.col(c).alias(f"r_{c}") for c in ru.SHORT])


def matched(spark, sf, closed=False):
    return ru.match_rules(v.factors(spark, sf), rule_table_named(spark), _GE, _LE, closed)


@query("rule_match", f"WITH {_M} SELECT contest_id, league, side, rule, odds, won FROM m")
def rule_match(spark, sf):
    return matched(spark, sf).select("contest_id", "league", "side", "rule", "odds", "won")


@query("rule_match_closed", f"WITH {_match_sql('<=')} SELECT contest_id, league, side, rule, odds, won FROM m")
def rule_match_closed(spark, sf):
    return matched(spark, sf, True).select("contest_id", "league", "side", "rule", "odds", "won")


CUT = "1999-06-01"
_STATS_SQL = f"""st AS (SELECT league, side, rule, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS n_is, sum(won) FILTER (ts < TIMESTAMP '{CUT}') AS w_is, avg(odds) FILTER (ts < TIMESTAMP '{CUT}') AS avg_odds,
count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS n_oos, avg(won) FILTER (ts >= TIMESTAMP '{CUT}') AS p_oos FROM m GROUP BY ALL),
stats AS (SELECT league, side, rule, n_is, CASE WHEN n_is >= 3 THEN w_is / n_is END AS p_is, CASE WHEN n_is >= 3 THEN {wilson_sql('w_is', 'n_is')} END AS lower, avg_odds, n_oos, p_oos FROM st)"""


@query("rule_stats", f"WITH {_M}, {_STATS_SQL} SELECT league, side, rule, n_is, n_oos, coalesce(lower * avg_odds - 1 > 0, false) AS admitted, {sql_rounded(['p_is', 'lower', 'avg_odds', 'p_oos'])} FROM stats")
def rule_stats(spark, sf):
    got = ru.rule_stats(matched(spark, sf), ["league", "side", "rule"], CUT)
    got = got.withColumn("admitted", ru.lower_bound_ok(F.col("lower"), F.col("avg_odds")))
    return rounded(got, ["league", "side", "rule", "n_is", "n_oos", "admitted"], ["p_is", "lower", "avg_odds", "p_oos"])


@query("rule_best", f"""WITH {_M}, {_STATS_SQL}, c AS (SELECT m.contest_id, m.rule, m.odds, m.won, p_is, p_is * m.odds - 1 AS ev, least(CASE WHEN m.odds > 1 THEN greatest(0.0, (p_is * (m.odds - 1) - (1 - p_is)) / (m.odds - 1) * 0.25) ELSE 0 END, 0.04) AS kelly
FROM m JOIN stats s ON s.league = m.league AND s.side = m.side AND s.rule = m.rule),
r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY p_is DESC, rule) AS rn FROM c WHERE ev > 0 AND kelly > 0) SELECT contest_id, rule, odds, won, {sql_rounded(['p_is', 'ev', 'kelly'])} FROM r WHERE rn = 1""")
def rule_best(spark, sf):
    """One rule per contest: highest in-sample rate with positive expected value."""
    m = matched(spark, sf)
    stats = ru.rule_stats(m, ["league", "side", "rule"], CUT).select("league", "side", "rule", "p_is")
    got = ru.best_rule_picks(m.join(stats, ["league", "side", "rule"]), "p_is", "p_is")
    return rounded(got, ["contest_id", "rule", "odds", "won"], ["p_is", "ev", "kelly"])


def _best_by(rank: str) -> str:
    """One rule per contest by another in-sample rank; equal ranks go by rule."""
    return f"""WITH {_M}, {_STATS_SQL}, k AS (SELECT *, {sql_rnd(rank, 9)} AS rank FROM stats),
c AS (SELECT m.contest_id, m.rule, m.odds, m.won, p_is, rank, p_is * m.odds - 1 AS ev, least(CASE WHEN m.odds > 1 THEN greatest(0.0, (p_is * (m.odds - 1) - (1 - p_is)) / (m.odds - 1) * 0.25) ELSE 0 END, 0.04) AS kelly
FROM m JOIN k ON k.league = m.league AND k.side = m.side AND k.rule = m.rule),
r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY rank DESC, rule) AS rn FROM c WHERE ev > 0 AND kelly > 0) SELECT contest_id, rule, odds, won, {sql_rounded(['p_is', 'rank', 'ev', 'kelly'])} FROM r WHERE rn = 1"""


def _best_picks(spark, sf, rank):
    m = matched(spark, sf)
    stats = ru.rule_stats(m, ["league", "side", "rule"], CUT).select("league", "side", "rule", "p_is", rnd(rank, 9).alias("rank"))
    got = ru.best_rule_picks(m.join(stats, ["league", "side", "rule"]), "p_is", "rank")
    return rounded(got, ["contest_id", "rule", "odds", "won"], ["p_is", "rank", "ev", "kelly"])


@query("rule_best_lower", _best_by("lower"))
def rule_best_lower(spark, sf):
    """One rule per contest: highest lower bound of the in-sample rate."""
    return _best_picks(spark, sf, F.col("lower"))


@query("rule_best_roi", _best_by("p_is * avg_odds - 1"))
def rule_best_roi(spark, sf):
    """One rule per contest: highest in-sample return."""
    return _best_picks(spark, sf, F.col("p_is") * F.col("avg_odds") - 1)


_REC = ["full_p", "full_lower", "recent_p", "recent_lower", "drift", "avg_odds"]


@query("recency_verdict", f"""WITH {_M}, g AS (SELECT league, side, rule, count(*) AS full_n, sum(won) AS fw, avg(odds) AS avg_odds, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS recent_n, sum(won) FILTER (ts >= TIMESTAMP '{CUT}') AS rw FROM m GROUP BY ALL),
s AS (SELECT *, CASE WHEN full_n >= 3 THEN fw / full_n END AS full_p, {wilson_sql('fw', 'full_n')} AS full_lower, CASE WHEN recent_n >= 3 THEN rw / recent_n END AS recent_p, CASE WHEN recent_n > 0 THEN {wilson_sql('rw', 'recent_n')} ELSE 0.0 END AS recent_lower FROM g),
d AS (SELECT *, CASE WHEN full_p <> 0 AND recent_p <> 0 THEN recent_p - full_p END AS drift FROM s)
SELECT league, side, rule, full_n, recent_n, CASE WHEN recent_n < 5 THEN 'thin' WHEN drift IS NULL THEN 'unknown' WHEN NOT coalesce(full_lower * avg_odds - 1 > 0, false) THEN 'unpaid'
WHEN drift < -0.15 AND recent_lower < 0.55 THEN 'lost' WHEN drift < -0.05 AND recent_lower < 0.55 THEN 'fading' WHEN recent_p >= full_p - 0.03 THEN 'steady' ELSE 'lower' END AS verdict, {sql_rounded(_REC)} FROM d""")
def recency_verdict(spark, sf):
    return rounded(ru.recency_verdict(matched(spark, sf), ["league", "side", "rule"], CUT), ["league", "side", "rule", "full_n", "recent_n", "verdict"], _REC)


@query("efficiency_score", f"""WITH {_M}, h AS (SELECT league, side, rule, {_HIT_SQL} FROM m GROUP BY ALL), e AS (SELECT *, n / CAST(6.5 AS DOUBLE) AS per, {wilson_sql()} * avg_odds - 1 AS lower_ev FROM h)
SELECT league, side, rule, n, roi > 0 AS stable, {sql_rnd('per', 2)} AS bets_per_year, {sql_rnd('per * roi', 3)} AS annual_units, {sql_rnd('per * lower_ev', 3)} AS annual_units_low,
{sql_rnd(f"{sql_rnd('per * lower_ev', 3)} * CASE WHEN roi > 0 THEN 1.0 ELSE 0.5 END", 3)} AS efficiency FROM e""")
def efficiency_score(spark, sf):
    h = mx.hit_block(matched(spark, sf), ["league", "side", "rule"]).withColumn("lower_ev", F.col("lower") * F.col("avg_odds") - 1).withColumn("stable", F.col("roi") > 0)
    return ru.efficiency_score(h, 6.5).select("league", "side", "rule", "n", "stable", "bets_per_year", "annual_units", "annual_units_low", "efficiency")


_PARTS = {"g": "min_glicko_gap", "xd": "min_xg_diff", "ws": "min_win_streak", "pa": "min_pass_acc_10", "m": "max_market_prob"}


@query("rule_parse", """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'home' ELSE 'away' END || '[1.' || (p_size % 9) || ',2.' || (p_size % 10) || ') g>=' || (p_partkey % 150) || ' xd>=0.' || (p_size % 7)
|| CASE WHEN p_partkey % 3 = 0 THEN ' pa>=' || (70 + p_size % 20) ELSE ' ws>=' || (p_size % 4) END || CASE p_partkey % 5 WHEN 0 THEN ' m<=0.6' WHEN 1 THEN ' m>=0.6' WHEN 2 THEN ' zz>=1' ELSE '' END AS rule FROM part)
SELECT id, rule, CASE WHEN id % 2 = 0 THEN 'home' ELSE 'away' END AS side, CAST(split_part(split_part(rule, '[', 2), ',', 1) AS DOUBLE) AS lo, CAST(split_part(split_part(rule, ',', 2), ')', 1) AS DOUBLE) AS hi,
CAST(id % 150 AS DOUBLE) AS min_glicko_gap, CAST(split_part(split_part(rule, 'xd>=', 2), ' ', 1) AS DOUBLE) AS min_xg_diff,
CASE WHEN id % 3 <> 0 THEN CAST(split_part(split_part(rule, 'ws>=', 2), ' ', 1) AS DOUBLE) END AS min_win_streak, CASE WHEN id % 3 = 0 THEN CAST(split_part(split_part(rule, 'pa>=', 2), ' ', 1) AS DOUBLE) / 100 END AS min_pass_acc_10,
CASE WHEN id % 5 = 0 THEN CAST(0.6 AS DOUBLE) END AS max_market_prob, id % 5 NOT IN (1, 2) AS understood FROM s""")
def rule_parse(spark, sf):
    """Rule strings to a typed table; a wrong operator or unknown label is flagged."""
    k, z = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.when(k % 2 == 0, "home").otherwise("away"), F.lit("[1."), (z % 9).cast("string"), F.lit(",2."), (z % 10).cast("string"), F.lit(") g>="), (k % 150).cast("string"),
                    F.lit(" xd>=0."), (z % 7).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" pa>="), (z % 20 + 70).cast("string"))).otherwise(F.concat(F.lit(" ws>="), (z % 4).cast("string"))),
                    F.when(k % 5 == 0, " m<=0.6").when(k % 5 == 1, " m>=0.6").when(k % 5 == 2, " zz>=1").otherwise(""))
    rows = read_table(spark, sf, "part").select(k.alias("id"), text.alias("rule"))
    return ru.parse_rules(rows).select("id", "rule", "side", "lo", "hi", *_PARTS.values(), "understood")


@query("rule_text", f"""WITH {v.FACTORS_SQL} SELECT contest_id, side || '[' || CAST(odds AS VARCHAR) || ',' || CAST(odds + 0.5 AS VARCHAR) || ')' || CASE WHEN won = 1 THEN ' g>=' || (contest_id % 7) ELSE '' END || CASE WHEN contest_id % 2 = 0 THEN ' m<=' || (contest_id % 5) ELSE '' END AS rule FROM factors""".replace(
    "CAST(odds AS VARCHAR) || ',' || CAST(odds + 0.5 AS VARCHAR)", "(contest_id % 3) || ',' || (contest_id % 4)"))
def rule_text(spark, sf):
    f = v.factors(spark, sf)
    k = F.col("contest_id")
    rows = f.select("contest_id", "side", (k % 3).alias("lo"), (k % 4).alias("hi"), F.when(F.col("won") == 1, k % 7).alias("gap"), F.when(k % 2 == 0, k % 5).alias("mp"))
    return rows.select("contest_id", ru.rule_text(thresholds={"gap": ("g", ">="), "mp": ("m", "<=")}).alias("rule"))


# ---- sweeps -----------------------------------------------------------------------------------------------------------
_GRID_SQL = f"""steps AS (SELECT * FROM (SELECT unnest(range(7)) AS r), (SELECT unnest(range(5)) AS l_xg), (SELECT unnest(range(4)) AS l_elo), (SELECT unnest(range(4)) AS l_form), (SELECT unnest(range(4)) AS l_mkt), (SELECT unnest(['home', 'away']) AS side)),
grid AS (SELECT side, {[a for a, _ in sw.ODDS_RANGES]}[r + 1] AS lo, {[b for _, b in sw.ODDS_RANGES]}[r + 1] AS hi, CAST(l_xg AS INT) AS l_xg, CAST(l_elo AS INT) AS l_elo, CAST(l_form AS INT) AS l_form, CAST(l_mkt AS INT) AS l_mkt,
 {[0.0, *sw.XG_STEPS]}[l_xg + 1] AS xg_t, {[0, *sw.ELO_STEPS]}[l_elo + 1] AS elo_t, {[0.0, *sw.FORM_STEPS]}[l_form + 1] AS form_t, CASE side WHEN 'home' THEN {[0.0, *sw.MKT_STEPS['home']]}[l_mkt + 1] ELSE {[0.0, *sw.MKT_STEPS['away']]}[l_mkt + 1] END AS mkt_t FROM steps),
hits AS (SELECT f.*, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, l_xg, l_elo, l_form, l_mkt FROM factors f JOIN grid g ON f.side = g.side AND odds >= lo AND odds < hi AND (l_xg = 0 OR xg >= xg_t) AND (l_form = 0 OR form >= form_t) AND (l_mkt = 0 OR mkt >= mkt_t)
 AND (l_elo = 0 OR CASE f.side WHEN 'home' THEN elo >= elo_t ELSE elo <= -elo_t END))"""
_G = ", ".join(sw.GRID_KEYS)


@query("sweep_grid", f"""WITH {v.FACTORS_SQL}, {_GRID_SQL}, h AS (SELECT {_G}, {_HIT_SQL} FROM hits GROUP BY {_G} HAVING count(*) >= 3) SELECT {_G}, n, wins, {sql_rounded(HIT)} FROM h""")
def sweep_grid(spark, sf):
    """All 4,480 rules per league over the whole history."""
    return rounded(sw.rule_grid(v.factors(spark, sf), ["league"]), [*sw.GRID_KEYS, "n", "wins"], HIT)


_WIN_SQL = f"""{v.FACTORS_SQL}, {_GRID_SQL}, win AS (SELECT {_G}, date_trunc('quarter', ts) AS q, count(*) AS n, avg(won) AS wr, avg(odds) AS ao, {sql_rnd('avg(CASE WHEN won = 1 THEN odds - 1 ELSE -1 END) * 100', 1)} AS roi FROM hits GROUP BY {_G}, q HAVING count(*) >= 3),
stab AS (SELECT {_G}, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_windows, count(*) FILTER (roi > 0) AS n_positive, avg(roi) AS avg_roi, avg(wr) AS avg_win_rate, avg(ao) AS avg_odds FROM win GROUP BY {_G} HAVING sum(n) >= 10 AND count(*) >= 4),
kinds AS (SELECT *, n_positive / n_windows AS share_positive, CASE WHEN avg_roi > 0 AND n_positive / n_windows >= 0.6 THEN 'stable' WHEN avg_roi > 0 AND n_positive / n_windows >= 0.4 THEN 'moderate' WHEN avg_roi <= 0 THEN 'losing' ELSE 'weak' END AS kind FROM stab)"""


def rule_windows(spark, sf):
    rows = v.factors(spark, sf).withColumn("quarter", F.trunc(F.col("ts").cast("date"), "quarter"))
    return sw.rule_grid(rows, ["league", "quarter"], 3)


@query("window_stability", f"WITH {_WIN_SQL} SELECT {_G}, n_total, n_windows, n_positive, kind, {sql_rounded(['avg_roi', 'avg_win_rate', 'avg_odds', 'share_positive'])} FROM kinds")
def window_stability(spark, sf):
    got = sw.window_stability(rule_windows(spark, sf))
    return rounded(got, [*sw.GRID_KEYS, "n_total", "n_windows", "n_positive", "kind"], ["avg_roi", "avg_win_rate", "avg_odds", "share_positive"])


_LV = ["l_xg", "l_elo", "l_form", "l_mkt"]
_DEDUP_SQL = f"""stable AS (SELECT *, {sql_rnd('avg_roi', 4)} AS s FROM kinds WHERE kind = 'stable'),
dd AS (SELECT * FROM stable a WHERE NOT EXISTS (SELECT 1 FROM stable b WHERE a.league = b.league AND a.side = b.side AND a.lo = b.lo AND a.hi = b.hi AND {" AND ".join(f"b.{x} <= a.{x}" for x in _LV)}
 AND ({" + ".join(f"b.{x}" for x in _LV)} < {" + ".join(f"a.{x}" for x in _LV)}) AND b.s >= a.s))"""


@query("subsume_dedup", f"WITH {_WIN_SQL}, {_DEDUP_SQL} SELECT {_G}, s AS avg_roi FROM dd")
def subsume_dedup(spark, sf):
    stable = sw.window_stability(rule_windows(spark, sf)).where("kind = 'stable'").select(*sw.GRID_KEYS, rnd("avg_roi", 4).alias("avg_roi"))
    return sw.drop_subsumed(stable, ["league", "side", "lo", "hi"], _LV, "avg_roi")


@query("top_rules", f"WITH {_WIN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY {sql_rnd('avg_roi', 4)} DESC, side, lo, l_xg, l_elo, l_form, l_mkt) AS rn FROM kinds WHERE kind = 'stable') SELECT {_G}, CAST(rn AS INT) AS rank FROM r WHERE rn <= 5")
def top_rules(spark, sf):
    """Five best stable rules per league."""
    from pyspark.sql import Window as W
    stable = sw.window_stability(rule_windows(spark, sf)).where("kind = 'stable'").withColumn("s", rnd("avg_roi", 4))
    w = W.partitionBy("league").orderBy(F.col("s").desc(), "side", "lo", *_LV)
    return stable.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(*sw.GRID_KEYS, "rank")


HOLD = "2000-07-01"
_FOLDSEL = f"""{v.FACTORS_SQL}, {_GRID_SQL}, span AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM factors WHERE ts < TIMESTAMP '{HOLD}'),
folds AS (SELECT CAST(k AS INT) AS fold, a + INTERVAL 1 MONTH * (24 + 6 * k) AS t0, a + INTERVAL 1 MONTH * (30 + 6 * k) AS t1 FROM span, generate_series(0, 40) t(k) WHERE a + INTERVAL 1 MONTH * (24 + 6 * k) <= z),
qm AS (SELECT {_G}, date_trunc('month', ts) AS month, count(*) AS n, sum(CASE WHEN won = 1 THEN odds ELSE 0 END) AS payout FROM hits WHERE ts < TIMESTAMP '{HOLD}' GROUP BY {_G}, month),
per AS (SELECT {_G}, fold, sum(n) FILTER (month < t0) AS trn, sum(payout) FILTER (month < t0) AS trp, sum(n) FILTER (month >= t0) AS ten, sum(payout) FILTER (month >= t0) AS tep FROM qm JOIN folds ON month < t1 GROUP BY {_G}, fold),
sel AS (SELECT {_G}, fold, CAST(trn AS BIGINT) AS train_n, trp / trn - 1 AS train_roi, CAST(ten AS BIGINT) AS test_n, tep / ten - 1 AS test_roi FROM per WHERE trn >= 10 AND {sql_rnd('trp / trn - 1')} > 0.05 AND ten > 0)"""


def selected_folds(spark, sf):
    """Rules chosen on each fold's training months with their test metrics: one month cube, spread over folds."""
    rows = v.factors(spark, sf).where(F.col("ts") < F.lit(HOLD).cast("timestamp_ntz")).withColumn("month", F.trunc(F.col("ts").cast("date"), "month"))
    home = F.col("side") == "home"
    lead = F.when(home, F.col("elo")).otherwise(-F.col("elo"))
    dims = [sw.Dim("xg", F.col("xg"), sw.XG_STEPS), sw.Dim("elo", lead, sw.ELO_STEPS), sw.Dim("form", F.col("form"), sw.FORM_STEPS), sw.Dim("mkt", F.col("mkt"), sw.MKT_STEPS["home"])]
    mkt = F.when(home, sw.Dim("m", F.col("mkt"), sw.MKT_STEPS["home"]).level()).otherwise(sw.Dim("m", F.col("mkt"), sw.MKT_STEPS["away"]).level())
    keys = ["league", "side", "lo", "hi"]
    cube = sw.cells(sw.in_ranges(rows, "odds", sw.ODDS_RANGES), [*keys, "month"], dims, {"mkt": mkt})
    span = rows.select("month")
    by_fold = fl.spread_months(cube, "month", span, 24, 6, 6)
    lv = [f"l_{d.name}" for d in dims]
    sums = [F.sum(c).alias(c) for c in ("n", "wins", "sum_odds", "payout")]
    cells = by_fold.groupBy(*keys, *lv, "fold", "role").agg(*sums)
    points = sw.spread(cells, [*keys, "fold", "role"], dims)
    return sw.fold_selection(points, points, [*keys, *lv], 10, 0.05)


@query("fold_selection", f"WITH {_FOLDSEL} SELECT {_G}, fold, train_n, test_n, {sql_rounded(['train_roi', 'test_roi'])} FROM sel")
def fold_selection(spark, sf):
    return rounded(selected_folds(spark, sf), [*sw.GRID_KEYS, "fold", "train_n", "test_n"], ["train_roi", "test_roi"])


@query("fold_stability", f"""WITH {_FOLDSEL}, st AS (SELECT {_G}, count(*) AS folds, count(*) FILTER (test_roi > 0) AS positive, avg(test_n) AS avg_test_n, avg(test_roi) AS avg_test_roi FROM sel GROUP BY {_G} HAVING count(*) FILTER (test_roi > 0) >= 3),
ho AS (SELECT {_G}, count(*) AS oos_n, avg(CASE WHEN won = 1 THEN odds - 1 ELSE -1 END) AS oos_roi FROM hits WHERE ts >= TIMESTAMP '{HOLD}' GROUP BY {_G})
SELECT {_G}, folds, positive, CASE WHEN avg_test_n >= 8 THEN 'high' ELSE 'low' END AS volume, oos_n, oos_roi > 0 AS confirmed, {sql_rounded(['avg_test_n', 'avg_test_roi', 'oos_roi'])} FROM st JOIN ho USING ({_G})""")
def fold_stability(spark, sf):
    """Rules profitable in at least three test folds, confirmed or not on the holdout."""
    st = sw.fold_stability(selected_folds(spark, sf), sw.GRID_KEYS)
    late = sw.rule_grid(v.factors(spark, sf).where(F.col("ts") >= F.lit(HOLD).cast("timestamp_ntz")), ["league"], 1)
    got = st.join(late.select(*sw.GRID_KEYS, F.col("n").alias("oos_n"), F.col("roi").alias("oos_roi")), sw.GRID_KEYS).withColumn("confirmed", F.col("oos_roi") > 0)
    return rounded(got, [*sw.GRID_KEYS, "folds", "positive", "volume", "oos_n", "confirmed"], ["avg_test_n", "avg_test_roi", "oos_roi"])


# Fixed values of the candidate grid.
CAND_RANGES = [(1.40, 1.60), (1.55, 1.85), (1.70, 2.10), (1.85, 2.40), (2.10, 3.00)]
CAND = {"xg": ((1.1, 1.2, 1.4), ">="), "gap": ((60, 100, 150), ">="), "form": ((1.8, 2.2, 2.6), ">="), "mkt": ((0.70, 0.65, 0.60, 0.55), "<=")}
_CK = "league, side, lo, hi, c_xg, c_gap, c_form, c_mkt"
_CAND_SQL = f"""halves AS (SELECT *, CASE side WHEN 'home' THEN elo ELSE -elo END AS gap, CASE WHEN row_number() OVER (PARTITION BY league, side ORDER BY ts, contest_id) <= count(*) OVER (PARTITION BY league, side) // 2 THEN 1 ELSE 2 END AS half FROM factors),
csteps AS (SELECT * FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(4)) AS c_xg), (SELECT unnest(range(4)) AS c_gap), (SELECT unnest(range(4)) AS c_form), (SELECT unnest(range(5)) AS c_mkt) WHERE c_xg + c_gap + c_form > 0),
cgrid AS (SELECT {[a for a, _ in CAND_RANGES]}[r + 1] AS lo, {[b for _, b in CAND_RANGES]}[r + 1] AS hi, CAST(c_xg AS INT) AS c_xg, CAST(c_gap AS INT) AS c_gap, CAST(c_form AS INT) AS c_form, CAST(c_mkt AS INT) AS c_mkt,
 {", ".join(f"{list(s)}[c_{k}] AS {k}_t" for k, (s, _) in CAND.items())} FROM csteps),
chits AS (SELECT h.*, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, c_xg, c_gap, c_form, c_mkt FROM halves h JOIN cgrid g ON odds >= lo AND odds <= hi AND {" AND ".join(f"(c_{k} = 0 OR {k} {op} {k}_t)" for k, (_, op) in CAND.items())}),
ch AS (SELECT {_CK}, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, avg(odds) AS avg_odds, count(*) FILTER (half = 1) AS n1, sum(won) FILTER (half = 1) AS w1, count(*) FILTER (half = 2) AS n2, sum(won) FILTER (half = 2) AS w2 FROM chits GROUP BY {_CK}),
cw AS (SELECT *, {wilson_sql()} AS lower, CASE WHEN n1 > 0 THEN {wilson_sql('w1', 'n1')} ELSE 0 END AS lower1, CASE WHEN n2 > 0 THEN {wilson_sql('w2', 'n2')} ELSE 0 END AS lower2 FROM ch WHERE n >= 25),
cand AS (SELECT *, n1 >= 5 AND n2 >= 5 AND lower1 >= 0.10 AND lower2 >= 0.10 AS passes FROM cw WHERE lower >= 0.25)"""


def candidate_rules(spark, sf):
    """Candidate grid with both chronological halves in one cube; a rule needs a strength or form factor."""
    from touchline.functions.scalars import wilson
    rows = fl.chronological_halves(v.factors(spark, sf), ["league", "side"], ["ts", "contest_id"])
    gap = F.when(F.col("side") == "home", F.col("elo")).otherwise(-F.col("elo"))
    dims = [sw.Dim(k, gap if k == "gap" else F.col(k), steps, op) for k, (steps, op) in CAND.items()]
    keys = ["league", "side", "lo", "hi"]
    cube = sw.spread(sw.cells(sw.in_ranges(rows, "odds", CAND_RANGES, closed=True), [*keys, "half"], dims), [*keys, "half"], dims).where("l_xg + l_gap + l_form > 0")
    lv = [f"l_{k}" for k in CAND]

    def of(half, c):
        return F.coalesce(F.sum(F.when(F.col("half") == half, F.col(c))), F.lit(0))
    got = cube.groupBy(*keys, *lv).agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), (F.sum("sum_odds") / F.sum("n")).alias("avg_odds"), of(1, "n").alias("n1"), of(1, "wins").alias("w1"), of(2, "n").alias("n2"), of(2, "wins").alias("w2"))
    got = got.where("n >= 25").withColumn("lower", wilson("wins", "n")).where("lower >= 0.25")
    passes = (F.col("n1") >= 5) & (F.col("n2") >= 5) & (wilson("w1", "n1") >= 0.10) & (wilson("w2", "n2") >= 0.10)
    return got.select(*keys, *[F.col(f"l_{k}").alias(f"c_{k}") for k in CAND], "n", "wins", "avg_odds", "n1", "n2", "lower", passes.alias("passes"))


@query("candidate_rules", f"WITH {v.FACTORS_SQL}, {_CAND_SQL} SELECT {_CK}, n, wins, n1, n2, passes, {sql_rounded(['avg_odds', 'lower'])} FROM cand")
def candidate_rules_query(spark, sf):
    return rounded(candidate_rules(spark, sf), [*_CK.split(", "), "n", "wins", "n1", "n2", "passes"], ["avg_odds", "lower"])


COMBO = {"xg>=1.2": ("xg", "xg >= 1.2"), "xg>=1.4": ("xg", "xg >= 1.4"), "e>=50": ("elo", "elo >= 50"), "e>=100": ("elo", "elo >= 100"), "e<=-50": ("elo", "elo <= -50"), "f>=1.8": ("form", "form >= 1.8"), "f>=2.4": ("form", "form >= 2.4"),
         "f>=2.8": ("form", "form >= 2.8"), "m<=0.60": ("mkt", "mkt <= 0.60"), "m<=0.45": ("mkt", "mkt <= 0.45"), "m>=0.50": ("mkt", "mkt >= 0.50")}
_CF = " UNION ALL ".join(f"SELECT rid, '{n}' AS f, '{c}' AS c FROM r WHERE {cond}" for n, (c, cond) in COMBO.items())
_COMBO_SQL = f"""{v.FACTORS_SQL}, rr AS (SELECT * FROM (SELECT unnest([1.4, 1.55, 1.7, 1.85, 2.1]) AS lo, unnest([1.6, 1.85, 2.1, 2.4, 3.0]) AS hi)),
r AS (SELECT contest_id || '-' || lo AS rid, league, side, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, won, odds, xg, elo, form, mkt FROM factors JOIN rr ON odds >= lo AND odds <= hi), e AS ({_CF}),
k AS (SELECT rid, '' AS combo, 0 AS k FROM r UNION ALL SELECT rid, f, 1 FROM e UNION ALL SELECT a.rid, a.f || '; ' || b.f, 2 FROM e a JOIN e b ON a.rid = b.rid AND a.f < b.f AND a.c <> b.c
 UNION ALL SELECT a.rid, a.f || '; ' || b.f || '; ' || d.f, 3 FROM e a JOIN e b ON a.rid = b.rid AND a.f < b.f AND a.c <> b.c JOIN e d ON b.rid = d.rid AND b.f < d.f AND d.c <> a.c AND d.c <> b.c),
h AS (SELECT league, side, lo, hi, combo, CAST(k AS INT) AS k, {_HIT_SQL} FROM k JOIN r USING (rid) GROUP BY league, side, lo, hi, combo, k HAVING count(*) >= 10)"""


@query("combo_search", f"WITH {_COMBO_SQL} SELECT league, side, lo, hi, combo, k, n, wins, {sql_rounded(HIT)} FROM h")
def combo_search(spark, sf):
    """Every combination of up to three factors of distinct columns in five price ranges."""
    rows = sw.in_ranges(v.factors(spark, sf), "odds", CAND_RANGES, closed=True)
    got = sw.factor_combos(rows, ["league", "side", "lo", "hi"], {n: (c, F.expr(x)) for n, (c, x) in COMBO.items()}, 3, 10)
    return rounded(got, ["league", "side", "lo", "hi", "combo", "k", "n", "wins"], HIT)


# ---- scored contests --------------------------------------------------------------------------------------------------
_PROP_SQL = f"""prop AS (SELECT *, 1 / home_odds / t AS mh, 1 / away_odds / t AS ma FROM (SELECT *, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS t FROM scored WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL)),
fav AS (SELECT contest_id, league, ts, result, p_draw, CASE WHEN p_home >= p_away THEN p_home ELSE p_away END AS p_side, CASE WHEN p_home >= p_away THEN home_odds ELSE away_odds END AS odds,
CASE WHEN p_home >= p_away THEN p_home - mh ELSE p_away - ma END AS edge, CASE WHEN p_home >= p_away THEN result = 'H' ELSE result = 'A' END::INT AS won FROM prop)"""


def favoured(spark, sf, method="proportional"):
    return sw.favoured_side(with_probs(v.scored(spark, sf).dropna(subset=ODDS), method))


_SW = "max_draw, min_bet, min_edge"


@query("sweep_threshold", f"""WITH {v.SCORED_SQL}, {_PROP_SQL}, g AS (SELECT * FROM (SELECT unnest({list(sw.MAX_DRAW)}) AS max_draw), (SELECT unnest({list(sw.MIN_BET)}) AS min_bet), (SELECT unnest({list(sw.MIN_EDGE)}) AS min_edge)),
h AS (SELECT CAST(max_draw AS DOUBLE) AS max_draw, CAST(min_bet AS DOUBLE) AS min_bet, CAST(min_edge AS DOUBLE) AS min_edge, {_HIT_SQL} FROM fav JOIN g ON p_draw < max_draw AND p_side > min_bet AND edge > min_edge WHERE odds BETWEEN 1.5 AND 3.0 GROUP BY {_SW}),
w AS (SELECT *, {wilson_sql()} AS lower FROM h) SELECT {_SW}, n, wins, {sql_rounded([*HIT, 'lower'])} FROM w""")
def sweep_threshold(spark, sf):
    return rounded(sw.scored_sweep(favoured(spark, sf)), [*_SW.split(", "), "n", "wins"], [*HIT, "lower"])


@query("pick_filter_grid", f"""WITH {v.SCORED_SQL}, {_PROP_SQL}, g AS (SELECT * FROM (SELECT unnest([0.35, 0.30]) AS max_draw), (SELECT unnest([0.40, 0.45, 0.50]) AS min_bet)),
h AS (SELECT cluster, CAST(max_draw AS DOUBLE) AS max_draw, CAST(min_bet AS DOUBLE) AS min_bet, {_HIT_SQL} FROM fav JOIN (SELECT contest_id, cluster FROM scored) USING (contest_id) JOIN g ON p_draw < max_draw AND p_side > min_bet GROUP BY ALL)
SELECT cluster, max_draw, min_bet, n, wins, {sql_rounded(HIT)} FROM h""")
def pick_filter_grid(spark, sf):
    dims = [sw.Dim("max_draw", F.col("p_draw"), (0.35, 0.30), "<", False), sw.Dim("min_bet", F.col("p_side"), (0.40, 0.45, 0.50), ">", False)]
    return rounded(sw.sweep(favoured(spark, sf), ["cluster"], dims), ["cluster", "max_draw", "min_bet", "n", "wins"], HIT)


_LK = "cluster, devig, max_draw, min_bet, min_edge, odds_lo, odds_hi"
_LEAGUE_SQL = f"""WITH RECURSIVE {v.SCORED_SQL}, pr AS (SELECT * FROM scored WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL), {shin_cte('pr')},
mk AS (SELECT contest_id, 'shin' AS devig, p_home AS mh, p_away AS ma FROM shin UNION ALL SELECT contest_id, 'proportional', 1 / home_odds / (1 / home_odds + 1 / draw_odds + 1 / away_odds), 1 / away_odds / (1 / home_odds + 1 / draw_odds + 1 / away_odds) FROM pr),
fv AS (SELECT cluster, devig, p_draw, CASE WHEN p_home >= p_away THEN p_home ELSE p_away END AS p_side, CASE WHEN p_home >= p_away THEN home_odds ELSE away_odds END AS odds, CASE WHEN p_home >= p_away THEN p_home - mh ELSE p_away - ma END AS edge,
 CASE WHEN p_home >= p_away THEN result = 'H' ELSE result = 'A' END::INT AS won FROM pr JOIN mk USING (contest_id)),
lg AS (SELECT * FROM (SELECT unnest({list(sw.MAX_DRAW)}) AS max_draw), (SELECT unnest({list(sw.LEAGUE_MIN_BET)}) AS min_bet), (SELECT unnest({list(sw.LEAGUE_MIN_EDGE)}) AS min_edge), (SELECT unnest({list(sw.ODDS_LO)}) AS odds_lo), (SELECT unnest({list(sw.ODDS_HI)}) AS odds_hi)),
lh AS (SELECT cluster, devig, CAST(max_draw AS DOUBLE) AS max_draw, CAST(min_bet AS DOUBLE) AS min_bet, CAST(min_edge AS DOUBLE) AS min_edge, CAST(odds_lo AS DOUBLE) AS odds_lo, CAST(odds_hi AS DOUBLE) AS odds_hi, {_HIT_SQL}
 FROM fv JOIN lg ON p_draw < max_draw AND p_side > min_bet AND edge > min_edge AND odds >= odds_lo AND odds <= odds_hi GROUP BY {_LK} HAVING count(*) >= 12),
viable AS (SELECT * FROM (SELECT *, {wilson_sql()} AS lower, n / CAST({sw.YEARS!r} AS DOUBLE) * roi AS annual_units FROM lh) WHERE win_rate >= 0.55 AND roi >= 0.05 AND lower >= 0.40)"""


def league_points(spark, sf):
    """Viable grid points per cluster for both margin-removal methods."""
    rows = [favoured(spark, sf, m).withColumn("devig", F.lit(m)).select("cluster", "devig", "p_draw", "p_side", "odds", "edge", "won") for m in ("shin", "proportional")]
    return sw.league_sweep(rows[0].unionByName(rows[1]), ["cluster", "devig"])


@query("league_sweep", f"{_LEAGUE_SQL} SELECT {_LK}, n, wins, {sql_rounded([*HIT, 'lower', 'annual_units'])} FROM viable")
def league_sweep(spark, sf):
    return rounded(league_points(spark, sf), [*_LK.split(", "), "n", "wins"], [*HIT, "lower", "annual_units"])


_BEST_ORDER = f"{sql_rnd('annual_units')} DESC, {sql_rnd('lower')} DESC, devig, max_draw, min_bet, min_edge, odds_lo, odds_hi"


@query("league_best", f"{_LEAGUE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {_BEST_ORDER}) AS rn FROM viable) SELECT {_LK}, n, wins, {sql_rounded(['annual_units', 'lower'])} FROM r WHERE rn = 1")
def league_best(spark, sf):
    """The best viable grid point per cluster by yearly units, then lower bound."""
    pts = rounded(league_points(spark, sf), [*_LK.split(", "), "n", "wins"], ["annual_units", "lower"])
    order = [F.col("annual_units").desc(), F.col("lower").desc(), *[F.col(c) for c in _LK.split(", ")[1:]]]
    return first_rows(pts, ["cluster"], order)


LIMITS = [("Brand#1", 0.32, 0.40, 0.02, 1.4, 3.0), ("Brand#2", 0.35, 0.38, 0.0, 1.5, 3.5), ("Brand#7", 0.30, 0.42, 0.03, 1.6, 2.5), ("Brand#12", 0.35, 0.35, -0.05, 1.3, 3.5)]
_LIM_SQL = "lim(league, max_draw, min_bet, min_edge, odds_lo, odds_hi) AS (VALUES " + ", ".join(str(x) for x in LIMITS) + ")"
_PICK_SQL = f"""{v.SCORED_SQL}, {_PROP_SQL}, {_LIM_SQL}, sd AS (SELECT contest_id, league, 'home' AS side, p_home AS prob, home_odds AS odds, p_home - mh AS margin, p_draw, (result = 'H')::INT AS won FROM prop UNION ALL SELECT contest_id, league, 'away', p_away, away_odds, p_away - ma, p_draw, (result = 'A')::INT FROM prop),
pk AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY margin DESC, side DESC) AS rn FROM sd JOIN lim USING (league) WHERE p_draw < max_draw AND prob > min_bet AND odds BETWEEN odds_lo AND odds_hi AND margin > min_edge)"""


def limit_picks(spark, sf):
    limits = spark.createDataFrame(LIMITS, "league string, max_draw double, min_bet double, min_edge double, odds_lo double, odds_hi double")
    return ru.threshold_picks(with_probs(v.scored(spark, sf).dropna(subset=ODDS)), limits)


@query("threshold_pick", f"WITH {_PICK_SQL} SELECT contest_id, side, odds, won, {sql_rounded(['prob', 'margin'])} FROM pk WHERE rn = 1")
def threshold_pick(spark, sf):
    """Picks under per-league limits; leagues without limits give none."""
    return rounded(limit_picks(spark, sf), ["contest_id", "side", "odds", "won"], ["prob", "margin"])


@query("replay_picks", f"WITH {_PICK_SQL} SELECT contest_id, side, odds, won FROM pk JOIN scored USING (contest_id) WHERE rn = 1 AND ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2001-01-01' AND contest_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def replay_picks(spark, sf):
    """The same picks over a past window, without contests the ledger already holds."""
    window = limit_picks(spark, sf).where((F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2001-01-01").cast("timestamp_ntz")))
    held = v.ledger(spark, sf).where("result = 'win'").select(F.col("id").alias("contest_id"))
    return window.join(held, "contest_id", "left_anti").select("contest_id", "side", "odds", "won")


@query("two_model_agreement", f"""WITH {_PICK_SQL}, a AS (SELECT contest_id, side, won, odds FROM pk WHERE rn = 1), b AS (SELECT contest_id, CASE WHEN p_home >= p_away THEN 'home' ELSE 'away' END AS side, CASE WHEN p_home >= p_away THEN result = 'H' ELSE result = 'A' END::INT AS won, CASE WHEN p_home >= p_away THEN home_odds ELSE away_odds END AS odds FROM prop WHERE greatest(p_home, p_away) > 0.45),
x AS (SELECT CASE WHEN a.side IS NULL THEN 'only_b' WHEN b.side IS NULL THEN 'only_a' WHEN a.side = b.side THEN 'agree' ELSE 'differ' END AS kind, coalesce(a.won, b.won) AS won, coalesce(a.odds, b.odds) AS odds FROM a FULL JOIN b ON a.contest_id = b.contest_id),
h AS (SELECT kind, {_HIT_SQL} FROM x GROUP BY kind) SELECT kind, n, wins, {sql_rounded(HIT)} FROM h""")
def two_model_agreement(spark, sf):
    b = favoured(spark, sf).where("p_side > 0.45").select("contest_id", "side", "won", "odds")
    return rounded(ru.agreement(limit_picks(spark, sf), b), ["kind", "n", "wins"], HIT)


# ---- overlap ----------------------------------------------------------------------------------------------------------
_OV = "league, side"
_PAIR_SQL = f"""{_M}, sz AS (SELECT {_OV}, rule, count(*) AS n FROM m GROUP BY ALL), pr AS (SELECT a.league, a.side, a.rule AS a, b.rule AS b, count(*) AS shared FROM m a JOIN m b ON a.contest_id = b.contest_id AND a.rule < b.rule GROUP BY ALL),
ov AS (SELECT pr.*, x.n AS size_a, y.n AS size_b, shared / (x.n + y.n - shared) AS jaccard, shared / least(x.n, y.n) AS coverage FROM pr JOIN sz x ON x.league = pr.league AND x.side = pr.side AND x.rule = a JOIN sz y ON y.league = pr.league AND y.side = pr.side AND y.rule = b)"""


@query("overlap_pairs", f"WITH {_PAIR_SQL} SELECT league, side, a, b, shared, size_a, size_b, {sql_rounded(['jaccard', 'coverage'])} FROM ov")
def overlap_pairs(spark, sf):
    return rounded(ru.overlap_pairs(matched(spark, sf), ["league", "side"]), ["league", "side", "a", "b", "shared", "size_a", "size_b"], ["jaccard", "coverage"])


@query("covering_rules", f"""WITH {_PAIR_SQL}, c AS (SELECT league, side, a AS rule, shared / size_b AS c FROM ov UNION ALL SELECT league, side, b, shared / size_a FROM ov) SELECT league, side, rule, count(*) AS covers FROM c WHERE c >= 0.5 GROUP BY ALL""")
def covering_rules(spark, sf):
    return ru.covering(ru.overlap_pairs(matched(spark, sf), ["league", "side"]), ["league", "side"])


@query("unique_members", f"""WITH {_M}, u AS (SELECT league, side, rule, count(*) OVER (PARTITION BY contest_id) AS holders, CASE WHEN won = 1 THEN odds - 1 ELSE -1 END AS unit FROM m),
g AS (SELECT league, side, rule, count(*) AS n, count(*) FILTER (holders = 1) AS n_unique, avg(unit) AS roi, avg(unit) FILTER (holders = 1) AS roi_unique, avg(unit) FILTER (holders > 1) AS roi_shared FROM u GROUP BY ALL)
SELECT league, side, rule, n, n_unique, {sql_rounded(['roi', 'roi_unique', 'roi_shared'])} FROM g""")
def unique_members(spark, sf):
    return rounded(ru.unique_members(matched(spark, sf), ["league", "side"]), ["league", "side", "rule", "n", "n_unique"], ["roi", "roi_unique", "roi_shared"])


@query("overlap_dedup", f"""WITH RECURSIVE {_PAIR_SQL}, {_STATS_SQL}, rk AS MATERIALIZED (SELECT league, side, rule, {sql_rnd('lower')} AS lower, row_number() OVER (PARTITION BY league, side ORDER BY {sql_rnd('lower')} DESC, rule) AS rn FROM stats WHERE lower IS NOT NULL),
near AS MATERIALIZED (SELECT league, side, a AS x, b AS y FROM ov WHERE coverage > 0.6 UNION ALL SELECT league, side, b, a FROM ov WHERE coverage > 0.6),
step(league, side, rn, kept) AS (SELECT DISTINCT league, side, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM rk UNION ALL
 SELECT s.league, s.side, r.rn, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.league = r.league AND n.side = r.side AND n.x = r.rule AND list_contains(s.kept, n.y)) THEN s.kept ELSE list_append(s.kept, r.rule) END
 FROM step s JOIN rk r ON r.league = s.league AND r.side = s.side AND r.rn = s.rn + 1),
fin AS (SELECT league, side, arg_max(kept, rn) AS kept FROM step GROUP BY ALL) SELECT rk.league, rk.side, rk.rule, rk.lower FROM rk JOIN fin USING (league, side) WHERE list_contains(kept, rk.rule)""")
def overlap_dedup(spark, sf):
    """Rules kept from the best lower bound down, unless covered beyond 60% by or of a kept one."""
    m = matched(spark, sf)
    stats = ru.rule_stats(m, ["league", "side", "rule"], CUT).where("lower IS NOT NULL").select("league", "side", "rule", rnd("lower").alias("lower"))
    return ru.greedy_dedup(stats, ru.overlap_pairs(m, ["league", "side"]), ["league", "side"], "lower", 0.6, "coverage")


# ---- a rule grid at full size: 17 thresholds, 44,800 rules ------------------------------------------------------------

GRID_RULES, GRID_RANGES = 4480, [(1.3, 1.8), (1.55, 2.0), (1.7, 2.1), (1.85, 2.4), (2.1, 3.0)]
_OWN = {"min_xg_diff": ("xg", 0.8, 0.2), "min_glicko_gap": ("elo", -60.0, 40.0), "min_form_advantage": ("form", 1.0, 0.4), "max_market_prob": ("mkt", 0.6, -0.05)}


def _grid_columns():
    """(threshold column, feature, feature as an expression, lowest threshold, step): four features of the factor table, the others spread over contests."""
    for i, (col, _) in enumerate(ru.LABELS.values()):
        own, low, step = _OWN.get(col, (f"CASE WHEN contest_id % {i + 11} <> 0 THEN CAST((contest_id * {2 * i + 3} + {7 * i}) % 101 AS DOUBLE) / 100 END", 0.2, 0.15))
        yield col, "x" + col[3:], own, low, step


def _grid_threshold(i: int, low: float, step: float) -> str:
    return f"CASE WHEN (j * {2 * i + 3} + {i}) % 5 = 0 THEN CAST({low} AS DOUBLE) + CAST({step} AS DOUBLE) * ((j + {i}) % 4) END"


_GRID_BOUND = {n: "CASE j % 5 " + " ".join(f"WHEN {k} THEN CAST({r[n]} AS DOUBLE)" for k, r in enumerate(GRID_RANGES)) + " END" for n in (0, 1)}
_GRID_COLS = list(_grid_columns())


@query("rule_match_grid", f"""WITH {v.FACTORS_SQL}, c AS (SELECT league, side, odds, won, {", ".join(f"{e} AS {f}" for _, f, e, _, _ in _GRID_COLS)} FROM factors),
r AS (SELECT s.side || '#' || j AS rule, l.league, s.side, {_GRID_BOUND[0]} AS lo, {_GRID_BOUND[1]} AS hi, {", ".join(f"{_grid_threshold(i, low, step)} AS {t}" for i, (t, _, _, low, step) in enumerate(_GRID_COLS))}
 FROM range({GRID_RULES}) g(j), (SELECT unnest({LEAGUES}) AS league) l, (SELECT unnest(['home', 'away']) AS side) s)
SELECT r.league, r.side, rule, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, {sql_rnd('sum(odds)', 2)} AS odds FROM c JOIN r ON r.league = c.league AND r.side = c.side AND c.odds >= lo AND c.odds <= hi
 AND {" AND ".join(f"({t} IS NULL OR coalesce({f} {'<=' if t.startswith('max') else '>='} {t}, false))" for t, f, _, _, _ in _GRID_COLS)} GROUP BY ALL""")
def rule_match_grid(spark, sf):
    """Hits of 44,800 rules of up to 17 thresholds, closed price ranges, missing features failing."""
    feats = [F.expr(e).alias(f) for _, f, e, _, _ in _GRID_COLS]
    cands = v.factors(spark, sf).select("league", "side", "odds", "won", *feats)
    groups = spark.range(GRID_RULES).withColumnRenamed("id", "j").select("j", F.explode(F.array(*map(F.lit, LEAGUES))).alias("league")).select(
        "j", "league", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    rules = groups.select("league", "side", F.concat("side", F.lit("#"), F.col("j").cast("string")).alias("rule"), F.expr(_GRID_BOUND[0]).alias("lo"), F.expr(_GRID_BOUND[1]).alias("hi"),
                          *[F.expr(_grid_threshold(i, low, step)).alias(t) for i, (t, _, _, low, step) in enumerate(_GRID_COLS)])
    least = {f: t for t, f, _, _, _ in _GRID_COLS if t.startswith("min")}
    most = {f: t for t, f, _, _, _ in _GRID_COLS if t.startswith("max")}
    got = ri.match_index(cands, rules, ["league", "side"], least, most, {"n": F.count(F.lit(1)), "wins": F.sum("won"), "odds": F.sum("odds")})
    return got.select("league", "side", "rule", "n", "wins", rnd("odds", 2).alias("odds"))
