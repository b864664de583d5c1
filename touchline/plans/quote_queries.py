"""Queries over the quote view."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import devig
from touchline.functions.scalars import odds_move
from touchline.operators import quotes as qt
from touchline.plans import views as v
from touchline.plans.registry import query, rounded, sql_rounded

ODDS = ["home_odds", "draw_odds", "away_odds"]


def best_sql(cond: str) -> str:
    cols = ", ".join(f"max(price) FILTER (outcome = '{s}' AND price > 1.0) AS {s}_odds" for s in devig.SIDES)
    return f"SELECT contest_id, {cols} FROM quotes WHERE {cond} GROUP BY contest_id"


for _name, _flag, _cond in (("best_price", None, "true"), ("best_price_open", False, "NOT is_closing"), ("best_price_closing", True, "is_closing")):
    query(_name, f"WITH {v.QUOTES_SQL} {best_sql(_cond)}")(lambda spark, sf, f=_flag: qt.best_price(v.quotes(spark, sf), f))

_PREF = f"""{v.QUOTES_SQL}, flagged AS (SELECT *, bool_or(is_closing) OVER (PARTITION BY contest_id) AS has_closing FROM quotes),
pref AS (SELECT contest_id, bool_or(has_closing) AS has_closing, {", ".join(f"max(price) FILTER (outcome = '{s}' AND price > 1.0) AS {s}_odds" for s in devig.SIDES)}
  FROM flagged WHERE is_closing OR NOT has_closing GROUP BY contest_id)"""


@query("closing_preferred", f"WITH {_PREF} SELECT * FROM pref WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL")
def closing_preferred(spark, sf):
    return qt.closing_preferred(v.quotes(spark, sf))


@query("double_chance_best", f"""WITH {v.QUOTES_SQL} SELECT contest_id, max(price) FILTER (outcome = 'home') AS dc_1x_odds,
max(price) FILTER (outcome = 'away') AS dc_2x_odds FROM quotes WHERE outcome <> 'draw' GROUP BY contest_id""")
def double_chance(spark, sf):
    q = v.quotes(spark, sf).withColumn("outcome", F.when(F.col("outcome") == "home", "1X").when(F.col("outcome") == "away", "2X").otherwise("12"))
    return qt.double_chance(q)


_PROP = ["p_home", "p_draw", "p_away", "overround", "certainty", "home_edge"]


@query("devig_prop", f"""WITH {v.QUOTES_SQL}, b AS ({best_sql('true')}), s AS (SELECT *, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS t FROM b),
p AS (SELECT *, 1 / home_odds / t AS p_home, 1 / draw_odds / t AS p_draw, 1 / away_odds / t AS p_away, t - 1 AS overround FROM s),
x AS (SELECT *, greatest(p_home, p_away) AS certainty, p_home - p_away AS home_edge FROM p) SELECT contest_id, {sql_rounded(_PROP)} FROM x""")
def devig_prop(spark, sf):
    best = qt.best_price(v.quotes(spark, sf), None)
    wide = best.select("contest_id", *[c.alias(n) for n, c in devig.market_features().items()])
    return rounded(wide, ["contest_id"], _PROP)


def _shin_term(z: str, q: str) -> str:
    return f"(sqrt({z} * {z} + 4.0 * (1.0 - {z}) * {q} * {q} / t) - {z}) / (2.0 * (1.0 - {z}))"


def shin_cte(source: str) -> str:
    """Sixty bisection steps as a recursive CTE over `source` (id, home_odds, draw_odds, away_odds)."""
    def total(z):
        return " + ".join(_shin_term(z, f"q{i}") for i in (1, 2, 3))
    return f"""q AS (SELECT contest_id, 1 / home_odds AS q1, 1 / draw_odds AS q2, 1 / away_odds AS q3, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS t FROM {source}),
bis(contest_id, q1, q2, q3, t, lo, hi, step) AS (SELECT contest_id, q1, q2, q3, t, CAST(1e-6 AS DOUBLE), CAST(0.5 AS DOUBLE), 0 FROM q UNION ALL
  SELECT contest_id, q1, q2, q3, t, CASE WHEN s > 1 THEN mid ELSE lo END, CASE WHEN s > 1 THEN hi ELSE mid END, step + 1
  FROM (SELECT *, {total('mid')} AS s FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE step < 60))),
fin AS (SELECT *, (lo + hi) / 2 AS z, t > 1 AND {total('CAST(1e-6 AS DOUBLE)')} > 1 AND {total('CAST(0.5 AS DOUBLE)')} < 1 AS ok FROM bis WHERE step = 60),
shin AS (SELECT contest_id, {", ".join(f"CASE WHEN ok THEN {_shin_term('z', f'q{i}')} ELSE q{i} / t END AS p_{s}" for i, s in ((1, 'home'), (2, 'draw'), (3, 'away')))} FROM fin)"""


@query("devig_shin", f"WITH RECURSIVE {v.QUOTES_SQL}, b AS ({best_sql('true')}), {shin_cte('b')} SELECT contest_id, {sql_rounded(['p_home', 'p_draw', 'p_away'])} FROM shin")
def devig_shin(spark, sf):
    wide = devig.with_probs(qt.best_price(v.quotes(spark, sf), None), "shin", "")
    return rounded(wide, ["contest_id"], ["p_home", "p_draw", "p_away"])


_MOVE_SQL = f"""{v.QUOTES_SQL}, num AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY contest_id, outcome, source) AS snaps
  FROM quotes WINDOW w AS (PARTITION BY contest_id, outcome, source ORDER BY recorded_at, snap_id, snap_no, raw)),
ends AS (SELECT contest_id, outcome, source, any_value(snaps) AS snaps, max(price) FILTER (rn = snaps) AS latest, max(recorded_at) FILTER (rn = snaps) AS last_at,
  coalesce(max(opening) FILTER (rn = 1), max(price) FILTER (rn = 1)) AS base FROM num GROUP BY ALL),
prior AS (SELECT n.contest_id, n.outcome, n.source, arg_max(n.price, n.rn) AS before FROM num n JOIN ends e USING (contest_id, outcome, source)
  WHERE n.rn < n.snaps AND n.recorded_at <= e.last_at - INTERVAL 30 MINUTE GROUP BY ALL),
moves AS (SELECT contest_id, outcome, median((latest - base) / base) AS drift, median((latest - before) / base) AS velocity,
  CASE WHEN count(*) >= 2 THEN stddev_pop(latest) / avg(latest) END AS dispersion, CAST(count(*) AS INT) AS n_sources, CAST(max(snaps) AS INT) AS n_snaps
  FROM ends LEFT JOIN prior USING (contest_id, outcome, source) GROUP BY ALL)"""
_MOVE = ["drift", "velocity", "dispersion"]


@query("line_movement", f"WITH {_MOVE_SQL} SELECT contest_id, outcome, n_sources, n_snaps, {sql_rounded(_MOVE)} FROM moves")
def line_movement(spark, sf):
    return rounded(qt.line_movement(v.quotes(spark, sf)), ["contest_id", "outcome", "n_sources", "n_snaps"], _MOVE)


@query("movement_gate", f"""WITH {_MOVE_SQL}, m AS (SELECT *, max(n_snaps) OVER (PARTITION BY contest_id) AS n_snapshots FROM moves),
g AS (SELECT contest_id, outcome, CASE WHEN outcome = 'draw' OR n_snapshots < 3 THEN NULL WHEN drift > 0.05 THEN 'drift' WHEN velocity > 0.03 THEN 'velocity'
  WHEN n_sources >= 2 AND dispersion > 0.10 THEN 'dispersion' END AS reason FROM m) SELECT *, reason IS NOT NULL AS skip FROM g""")
def movement_gate(spark, sf):
    return qt.movement_gate(qt.line_movement(v.quotes(spark, sf))).select("contest_id", "outcome", "reason", "skip")


@query("opening_carry", f"""WITH {v.QUOTES_SQL} SELECT contest_id, outcome, recorded_at, snap_id, snap_no, raw, coalesce(min(opening) OVER w, opening, price) AS opening_carried
FROM quotes WINDOW w AS (PARTITION BY contest_id, outcome ORDER BY recorded_at, snap_id, snap_no, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def opening_carry(spark, sf):
    return qt.opening_carry(v.quotes(spark, sf)).select("contest_id", "outcome", *qt.TIE, "opening_carried")


@query("latest_quote", f"""WITH {v.QUOTES_SQL} SELECT contest_id, outcome, arg_max(price, (recorded_at, snap_id, snap_no, raw)) AS price, max(recorded_at) AS recorded_at
FROM quotes WHERE NOT is_closing GROUP BY ALL""")
def latest_quote(spark, sf):
    return qt.latest_quote(v.quotes(spark, sf))


PRIORITY = [7, 3, 11, 42, 58, 90]
_RANK = "CASE source " + " ".join(f"WHEN {s} THEN {i}" for i, s in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"


@query("reference_source", f"""WITH {v.QUOTES_SQL}, r AS (SELECT *, {_RANK} AS rank FROM quotes),
c AS (SELECT contest_id, arg_min(source, (rank, CASE WHEN rank = {len(PRIORITY)} THEN recorded_at END, CASE WHEN rank = {len(PRIORITY)} THEN snap_id END,
  CASE WHEN rank = {len(PRIORITY)} THEN snap_no END, CASE WHEN rank = {len(PRIORITY)} THEN raw END, source)) AS source FROM r GROUP BY contest_id)
SELECT contest_id, source, outcome, price, recorded_at FROM quotes SEMI JOIN c USING (contest_id, source)""")
def reference_source(spark, sf):
    return qt.reference_source(v.quotes(spark, sf), PRIORITY).select("contest_id", "source", "outcome", "price", "recorded_at")


@query("source_counts", f"""WITH {v.QUOTES_SQL}, p AS (SELECT contest_id, source, count(*) AS n FROM quotes GROUP BY ALL)
SELECT contest_id, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_quotes, max(n) AS most_from_one FROM p GROUP BY contest_id""")
def source_counts(spark, sf):
    return qt.source_counts(v.quotes(spark, sf))


@query("quote_moves", f"""WITH {v.QUOTES_SQL}, x AS (SELECT contest_id, outcome, snap_id, snap_no, raw, price - opening AS move_abs, (price - opening) / opening AS move_pct FROM quotes WHERE opening IS NOT NULL)
SELECT contest_id, outcome, snap_id, snap_no, raw, CAST(move_pct < -0.1 AS INT) AS sharp, {sql_rounded(['move_abs', 'move_pct'])} FROM x""")
def quote_moves(spark, sf):
    q = v.quotes(spark, sf).where(F.col("opening").isNotNull())
    wide = q.select("contest_id", "outcome", "snap_id", "snap_no", "raw", *[c.alias(n) for n, c in odds_move("opening", "price").items()])
    return rounded(wide, ["contest_id", "outcome", "snap_id", "snap_no", "raw", "sharp"], ["move_abs", "move_pct"])


_LOSS = ["model_loss", "market_loss", "model_better"]


@query("market_vs_model", f"""WITH {v.SCORED_SQL}, x AS (SELECT *, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS t FROM scored),
l AS (SELECT -ln(greatest(CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1e-15)) AS model,
 -ln(greatest(CASE result WHEN 'H' THEN 1 / home_odds WHEN 'D' THEN 1 / draw_odds ELSE 1 / away_odds END / t, 1e-15)) AS market FROM x WHERE t IS NOT NULL),
a AS (SELECT count(*) AS n, avg(model) AS model_loss, avg(market) AS market_loss, avg((model < market)::INT) AS model_better FROM l) SELECT n, {sql_rounded(_LOSS)} FROM a""")
def market_vs_model(spark, sf):
    priced = v.scored(spark, sf).dropna(subset=ODDS)
    return rounded(qt.model_vs_market(devig.with_probs(priced)), ["n"], _LOSS)
