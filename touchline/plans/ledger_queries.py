"""Queries over the ledger view."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import scalars as sc
from touchline.operators import ledger as lg
from touchline.operators import metrics as mx
from touchline.operators import quotes as qt
from touchline.operators import scan as sn
from touchline.plans import views as v
from touchline.plans.quote_queries import PRIORITY, _RANK
from touchline.plans.registry import query, rounded, sql_rounded
from touchline.plans.views import sql_rnd
from touchline.sources.tables import read_table

BY = ["strategy"]
MARKETS = ["1x2", "total", "btts", "double_chance", "handicap", "corners"]
PICKS = ["home", "draw", "away", "over 2.5", "under 4", "under 3.5", "yes", "no", "YES", "home/draw", "draw_away", "12", "home -1", "away +0.5",
         "home x", "over 9", "Home", "odd"]
_MARKET_SQL = "list_extract([" + ", ".join(f"'{m}'" for m in MARKETS) + "], CAST(id % 6 AS INT) + 1)"
_PICK_SQL = ("list_extract([" + ", ".join(f"'{p}'" for p in PICKS) + "], CAST((id % 6) * 3 + (id // 6) % 3 AS INT) + 1)")
KELLY_SQL = """k AS (SELECT *, least(CASE WHEN odds <= 1 THEN 0 ELSE greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * 0.25) END, 0.04) AS fraction FROM ledger)"""
CURVE_SQL = f"""{v.LEDGER_SQL}, {KELLY_SQL}, g AS (SELECT *, CASE WHEN result = 'win' THEN fraction * (odds - 1) ELSE -fraction END AS gain FROM k WHERE result IS NOT NULL),
c AS (SELECT *, ln(1000.0) + sum(ln(1 + gain)) OVER w AS ln_balance FROM g WINDOW w AS (PARTITION BY strategy ORDER BY ts, id)),
d AS (SELECT *, greatest(ln(1000.0), max(ln_balance) OVER (PARTITION BY strategy ORDER BY ts, id)) AS ln_peak FROM c),
curve AS (SELECT *, exp(ln_balance - ln_peak) - 1 AS drawdown FROM d)"""


def kelly_ledger(spark, sf):
    return lg.with_kelly(v.ledger(spark, sf))


@query("equity_curve", f"WITH {CURVE_SQL} SELECT strategy, id, {sql_rounded(['ln_balance', 'ln_peak', 'drawdown'])} FROM curve")
def equity_curve(spark, sf):
    return rounded(lg.compound_equity(kelly_ledger(spark, sf), BY), ["strategy", "id"], ["ln_balance", "ln_peak", "drawdown"])


_SUM = ["win_rate", "avg_odds", "ln_final", "max_drawdown", "ln_growth"]


@query("equity_summary", f"""WITH {CURVE_SQL}, s AS (SELECT strategy, count(*) AS n, avg((result = 'win')::INT) AS win_rate, avg(odds) AS avg_odds,
arg_max(ln_balance, (ts, id)) AS ln_final, min(drawdown) AS max_drawdown, arg_max(ln_balance, (ts, id)) - ln(1000.0) AS ln_growth FROM curve GROUP BY strategy)
SELECT strategy, n, {sql_rounded(_SUM)} FROM s""")
def equity_summary(spark, sf):
    return rounded(lg.summary(lg.compound_equity(kelly_ledger(spark, sf), BY), BY), ["strategy", "n"], _SUM)


FLAT_SQL = f"""{v.LEDGER_SQL}, u AS (SELECT *, CASE WHEN result = 'win' THEN odds - 1 ELSE -1 END AS unit FROM ledger WHERE result IS NOT NULL)"""


def flat(spark, sf):
    done = v.ledger(spark, sf).where(F.col("result").isNotNull())
    return done.withColumn("unit", F.when(F.col("result") == "win", F.col("odds") - 1).otherwise(F.lit(-1.0)))


@query("flat_equity", f"""WITH {FLAT_SQL}, x AS (SELECT strategy, id, sum(unit) OVER (PARTITION BY strategy ORDER BY ts, id) AS balance FROM u)
SELECT strategy, id, {sql_rounded(['balance'])} FROM x""")
def flat_equity(spark, sf):
    return rounded(lg.flat_equity(v.ledger(spark, sf), BY), ["strategy", "id"], ["balance"])


@query("weekly_sharpe", f"""WITH {FLAT_SQL}, w AS (SELECT strategy, date_trunc('week', ts) AS week, sum(unit) AS pnl, count(*) AS n FROM u GROUP BY ALL),
x AS (SELECT strategy, count(*) AS weeks, avg(n) AS per_week, avg(pnl) / stddev_samp(pnl) * sqrt(52) AS sharpe FROM w GROUP BY strategy)
SELECT strategy, weeks, {sql_rounded(['per_week', 'sharpe'])} FROM x""")
def weekly_sharpe(spark, sf):
    return rounded(lg.weekly(flat(spark, sf), BY), ["strategy", "weeks"], ["per_week", "sharpe"])


@query("month_dense", f"""WITH {v.LEDGER_SQL}, m AS (SELECT owner, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, count(*) FILTER (result = 'win') AS wins FROM ledger GROUP BY ALL),
s AS (SELECT owner, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY owner)
SELECT s.owner, s.month, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins FROM s LEFT JOIN m ON m.owner = s.owner AND m.month = s.month""")
def month_dense(spark, sf):
    return lg.months_dense(v.ledger(spark, sf), ["owner"], {"n": F.count(F.lit(1)), "wins": F.count(F.when(F.col("result") == "win", 1))})


_MONTHLY = ["flat", "flat_total", "ln_balance"]


@query("monthly_balance", f"""WITH {CURVE_SQL}, h AS (SELECT strategy, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n,
sum(CASE WHEN result = 'win' THEN odds - 1 ELSE -1 END) AS flat, sum(ln(1 + gain)) AS lg FROM curve GROUP BY ALL),
s AS (SELECT strategy, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM h GROUP BY strategy),
m AS (SELECT s.strategy, s.month, coalesce(n, 0) AS n, coalesce(flat, 0) AS flat, coalesce(lg, 0) AS lg FROM s LEFT JOIN h ON h.strategy = s.strategy AND h.month = s.month),
x AS (SELECT strategy, month, n, month >= DATE '2000-01-01' AS oos, flat, sum(flat) OVER w AS flat_total, ln(1000.0) + sum(lg) OVER w AS ln_balance FROM m WINDOW w AS (PARTITION BY strategy ORDER BY month))
SELECT strategy, month, n, oos, {sql_rounded(_MONTHLY)} FROM x""")
def monthly_balance(spark, sf):
    return rounded(lg.monthly_balance(kelly_ledger(spark, sf), BY, "2000-01-01"), ["strategy", "month", "n", "oos"], _MONTHLY)


MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
_PIV = ", ".join(f"count(*) FILTER (m = '{x}') AS \"{x}_n\", sum(unit) FILTER (m = '{x}') AS \"{x}_pnl\"" for x in [*MONTHS, "other"])
_PIV_OUT = ", ".join(f"CASE WHEN \"{x}_n\" > 0 THEN \"{x}_n\" END AS \"{x}_n\", {sql_rnd(f'\"{x}_pnl\"')} AS \"{x}_pnl\"" for x in [*MONTHS, "other"])


@query("month_pivot", f"WITH {FLAT_SQL}, t AS (SELECT *, CASE WHEN list_contains({MONTHS}, strftime(ts, '%Y-%m')) THEN strftime(ts, '%Y-%m') ELSE 'other' END AS m FROM u), p AS (SELECT strategy, {_PIV} FROM t GROUP BY strategy) SELECT strategy, {_PIV_OUT} FROM p")
def month_pivot(spark, sf):
    wide = lg.month_pivot(flat(spark, sf), BY, MONTHS)
    return wide.select("strategy", *[c for x in [*MONTHS, "other"] for c in (F.col(f"{x}_n"), sc.rnd(F.col(f"{x}_pnl")).alias(f"{x}_pnl"))])


def _restake_sql(tail: str) -> str:
    """One recursion step per ledger row of a strategy, balance carried along."""
    put = sql_rnd("least(r.bank * n.fraction, r.bank * 0.1)", 2)
    pnl = f"CASE n.result WHEN 'win' THEN {sql_rnd('s.put * (n.odds - 1.0)', 2)} WHEN 'loss' THEN -s.put END"
    return f"""WITH RECURSIVE {v.LEDGER_SQL}, {KELLY_SQL}, num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts, id) AS rn FROM k WHERE fraction > 0),
r(strategy, rn, id, stake, pnl, bank) AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(1000 AS DOUBLE) FROM num
UNION ALL SELECT p.strategy, p.rn, p.id, p.put, p.pnl, CASE WHEN p.pnl IS NULL THEN p.bank ELSE {sql_rnd('p.bank + p.pnl', 2)} END FROM (
  SELECT n.strategy, n.rn, n.id, s.put, {pnl} AS pnl, r.bank FROM r JOIN num n ON n.strategy = r.strategy AND n.rn = r.rn + 1, LATERAL (SELECT {put} AS put) s) p)
{tail}"""


@query("restake_fold", _restake_sql("SELECT strategy, id, stake, pnl, bank AS bank_after FROM r WHERE rn > 0"))
def restake_fold(spark, sf):
    return lg.restake(kelly_ledger(spark, sf), BY, at_most=v.rows_in(spark, sf, "orders"))[0]


@query("current_balance", _restake_sql("SELECT strategy, arg_max(bank, rn) AS bank FROM r GROUP BY strategy"))
def current_balance(spark, sf):
    return lg.restake(kelly_ledger(spark, sf), BY, at_most=v.rows_in(spark, sf, "orders"))[1]


@query("rebalance_open", _restake_sql(f""", fin AS (SELECT strategy, arg_max(bank, rn) AS bank FROM r GROUP BY strategy)
SELECT id, strategy, {sql_rnd('least(bank * fraction, bank * 0.1)', 2)} AS stake FROM k JOIN fin USING (strategy) WHERE result IS NULL AND fraction > 0""").replace("\n, fin", ", fin"))
def rebalance_open(spark, sf):
    book = kelly_ledger(spark, sf)
    return lg.rebalance_open(book, lg.restake(book, BY, at_most=v.rows_in(spark, sf, "orders"))[1], BY).select("id", "strategy", "stake")


def picks(spark, sf):
    """The ledger with a market and a pick, on the contest of the same number."""
    at = F.col("id")
    mk = F.element_at(F.array(*[F.lit(m) for m in MARKETS]), (at % 6 + 1).cast("int"))
    pk = F.element_at(F.array(*[F.lit(p) for p in PICKS]), ((at % 6) * 3 + F.floor(at / 6) % 3 + 1).cast("int"))
    return v.ledger(spark, sf).select("*", at.alias("contest_id"), mk.alias("market"), pk.alias("pick"), F.lit(10.0).alias("stake"))


_SETTLE = """CASE WHEN market = '1x2' THEN lower(pick) = actual
  WHEN market = 'total' AND pick LIKE 'over %' THEN home_score + away_score > TRY_CAST(split_part(pick, ' ', 2) AS DOUBLE)
  WHEN market = 'total' AND pick LIKE 'under %' THEN home_score + away_score < TRY_CAST(split_part(pick, ' ', 2) AS DOUBLE)
  WHEN market = 'btts' AND lower(pick) = 'yes' THEN home_score > 0 AND away_score > 0
  WHEN market = 'btts' AND lower(pick) = 'no' THEN NOT (home_score > 0 AND away_score > 0)
  WHEN market = 'double_chance' THEN CASE pick WHEN 'home/draw' THEN actual <> 'away' WHEN 'draw_away' THEN actual <> 'home' WHEN '12' THEN actual <> 'draw' END
  WHEN market = 'handicap' AND lower(pick) LIKE 'home %' THEN home_score + TRY_CAST(split_part(pick, ' ', 2) AS DOUBLE) > away_score
  WHEN market = 'handicap' AND lower(pick) LIKE 'away %' THEN away_score + TRY_CAST(split_part(pick, ' ', 2) AS DOUBLE) > home_score END"""
PICKS_SQL = f"picks AS (SELECT *, id AS contest_id, {_MARKET_SQL} AS market, {_PICK_SQL} AS pick FROM ledger)"
_GRADED = f"""{v.CONTESTS_SQL}, {v.LEDGER_SQL}, {PICKS_SQL},
j AS (SELECT p.*, home_score, away_score, CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END AS actual FROM picks p JOIN contests c USING (contest_id)),
graded AS (SELECT *, CASE ({_SETTLE}) WHEN true THEN 'win' WHEN false THEN 'loss' END AS outcome FROM j)"""


@query("settle_markets", f"WITH {_GRADED} SELECT id, market, pick, outcome AS graded FROM graded")
def settle_markets(spark, sf):
    rows = picks(spark, sf).join(v.contests(spark, sf).select("contest_id", "home_score", "away_score"), "contest_id")
    return rows.select("id", "market", "pick", sc.settle("market", "pick", "home_score", "away_score").alias("graded"))


@query("settle_open", f"""WITH {_GRADED} SELECT id, outcome AS result, CASE outcome WHEN 'win' THEN {sql_rnd('10.0 * (odds - 1.0)', 2)} ELSE -10.0 END AS pnl
FROM graded WHERE result IS NULL AND outcome IS NOT NULL""")
def settle_open(spark, sf):
    games = v.contests(spark, sf).select("contest_id", "home_score", "away_score")
    return lg.settle_open(picks(spark, sf), games).select("id", "result", "pnl")


@query("settled_profit_by_strategy", f"""WITH {_GRADED} SELECT strategy, {sql_rnd(f"sum(CASE outcome WHEN 'win' THEN {sql_rnd('10.0 * (odds - 1.0)', 2)} ELSE -10.0 END)", 2)} AS new_profit
FROM graded WHERE result IS NULL AND outcome IS NOT NULL AND strategy IN ('1-URGENT', '2-HIGH') GROUP BY strategy""")
def settled_profit(spark, sf):
    """Newly settled profit of the canonical strategies, to be appended as balance snapshots."""
    games = v.contests(spark, sf).select("contest_id", "home_score", "away_score")
    book = picks(spark, sf).where(F.col("strategy").isin("1-URGENT", "2-HIGH"))
    return lg.settle_open(book, games).groupBy("strategy").agg(sc.rnd(F.sum("pnl"), 2).alias("new_profit"))


def clv_ledger(spark, sf):
    """1x2 picks priced against a reference source's closing quotes of one part's market."""
    book = v.ledger(spark, sf).withColumn("contest_id", F.col("owner")).withColumn(
        "pick", F.element_at(F.array(F.lit("home"), F.lit("draw"), F.lit("away")), (F.col("id") % 3 + 1).cast("int")))
    closing = qt.reference_source(v.quotes(spark, sf).where("is_closing"), PRIORITY)
    return lg.attach_clv(book, closing.groupBy("contest_id", "outcome").agg(F.max("price").alias("price")))


CLV_SQL = f"""{v.QUOTES_SQL}, {v.LEDGER_SQL}, r AS (SELECT *, {_RANK} AS rank FROM quotes WHERE is_closing),
src AS (SELECT contest_id, arg_min(source, (rank, CASE WHEN rank = {len(PRIORITY)} THEN (recorded_at, snap_id, snap_no, raw) END, source)) AS source FROM r GROUP BY contest_id),
ref AS (SELECT contest_id, outcome, max(price) AS closing FROM r SEMI JOIN src USING (contest_id, source) GROUP BY ALL),
b AS (SELECT *, owner AS contest_id, list_extract(['home', 'draw', 'away'], CAST(id % 3 AS INT) + 1) AS pick FROM ledger),
clv AS (SELECT b.*, closing, prob / (1 / closing) - 1 AS clv FROM b LEFT JOIN ref ON ref.contest_id = b.contest_id AND ref.outcome = b.pick)"""


@query("clv", f"WITH {CLV_SQL} SELECT id, pick, closing, {sql_rounded(['clv'])} FROM clv")
def clv(spark, sf):
    return rounded(clv_ledger(spark, sf), ["id", "pick", "closing"], ["clv"])


AS_OF = "2001-08-01"


@query("clv_health", f"""WITH {v.CONTESTS_SQL}, {CLV_SQL}, t AS (SELECT clv.*, coalesce(g.ts, clv.ts) AS placed FROM clv LEFT JOIN contests g ON g.contest_id = clv.id + 3000),
h AS (SELECT strategy, count(*) AS n, avg(clv) AS avg_clv, avg((clv > 0)::INT) AS positive FROM t
WHERE clv IS NOT NULL AND placed >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY strategy HAVING count(*) >= 5)
SELECT strategy, n, CASE WHEN avg_clv >= 0 THEN 'healthy' WHEN avg_clv >= -0.02 THEN 'warning' ELSE 'alert' END AS status, {sql_rounded(['avg_clv', 'positive'])} FROM h""")
def clv_health(spark, sf):
    """Rolling line value per strategy; rows without a contest are placed by their own date."""
    games = v.contests(spark, sf).select((F.col("contest_id") - 3000).alias("contest_id"), "ts")
    book = clv_ledger(spark, sf).withColumn("contest_id", F.col("id"))
    return rounded(lg.clv_health(book, BY, AS_OF, games), ["strategy", "n", "status"], ["avg_clv", "positive"])


@query("clv_transitions", f"""WITH {CLV_SQL}, d AS (SELECT strategy, CAST(ts AS DATE) AS day, avg(clv) AS a, count(*) AS n FROM clv WHERE clv IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN a >= 0 THEN 'healthy' WHEN a >= -0.02 THEN 'warning' ELSE 'alert' END AS status FROM d),
t AS (SELECT *, lag(status) OVER (PARTITION BY strategy ORDER BY day) AS was FROM s)
SELECT strategy, day, n, status, was, CASE status WHEN 'alert' THEN 'alert' ELSE 'recovery' END AS event FROM t
WHERE (status = 'alert' AND coalesce(was, '') <> 'alert') OR (status <> 'alert' AND was = 'alert')""")
def clv_transitions(spark, sf):
    return lg.clv_transitions(clv_ledger(spark, sf), BY).select("strategy", "day", "n", "status", "was", "event")


TODAY = "2001-07-20"


@query("reprice_open", f"""WITH {v.QUOTES_SQL}, {v.LEDGER_SQL}, b AS (SELECT *, owner AS contest_id, list_extract(['home', 'draw', 'away'], CAST(id % 3 AS INT) + 1) AS pick FROM ledger
WHERE result IS NULL AND CAST(ts AS DATE) BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7),
l AS (SELECT contest_id, outcome, arg_max(price, (recorded_at, snap_id, snap_no, raw)) AS price FROM quotes WHERE NOT is_closing GROUP BY ALL),
e AS (SELECT b.id, b.ts, coalesce(prob * price - 1, prob * odds - 1) AS ev FROM b LEFT JOIN l ON l.contest_id = b.contest_id AND l.outcome = b.pick)
SELECT id, ev >= 0 AS is_active, CASE WHEN ev < 0 THEN NULL WHEN CAST(ts AS DATE) = DATE '{TODAY}' THEN 'final' ELSE 'early' END AS timing, {sql_rounded(['ev'])} FROM e""")
def reprice_open(spark, sf):
    book = v.ledger(spark, sf).withColumn("contest_id", F.col("owner")).withColumn("match_ts", F.col("ts")).withColumn(
        "pick", F.element_at(F.array(F.lit("home"), F.lit("draw"), F.lit("away")), (F.col("id") % 3 + 1).cast("int")))
    return rounded(lg.reprice(book, qt.latest_quote(v.quotes(spark, sf)), TODAY), ["id", "is_active", "timing"], ["ev"])


@query("strategy_stats", f"""WITH {CLV_SQL}, p AS (SELECT *, 10.0 AS stake, CASE result WHEN 'win' THEN {sql_rnd('10.0 * (odds - 1)', 2)} WHEN 'loss' THEN -10.0 END AS pnl FROM clv),
s AS (SELECT strategy, count(*) AS n, avg((result = 'win')::INT) AS win_rate, sum(pnl) / sum(stake) AS roi, avg(odds) AS avg_odds, avg(clv) AS avg_clv, sum(pnl) AS profit FROM p WHERE result IS NOT NULL GROUP BY strategy)
SELECT strategy, n, {sql_rounded(['win_rate', 'roi', 'avg_odds', 'avg_clv', 'profit'])} FROM s""")
def strategy_stats(spark, sf):
    book = clv_ledger(spark, sf).withColumn("stake", F.lit(10.0)).withColumn("pnl", sc.profit("result", "stake", "odds"))
    return rounded(mx.settled_roi(book, BY), ["strategy", "n"], ["win_rate", "roi", "avg_odds", "avg_clv", "profit"])


DAYS = 365


@query("report_by_league", f"""WITH {v.LEDGER_SQL}, j AS (SELECT c_mktsegment AS league, result, odds, ts FROM ledger LEFT JOIN customer ON c_custkey = owner),
w AS (SELECT * FROM j WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) FROM ledger) - {DAYS})
SELECT league, count(*) AS n, count(result) AS settled, count(*) FILTER (result = 'win') AS wins, {sql_rnd("avg((result = 'win')::INT)")} AS win_rate,
{sql_rnd("sum(CASE result WHEN 'win' THEN odds - 1 WHEN 'loss' THEN -1 END)")} AS units, {sql_rnd("avg(odds)")} AS avg_odds FROM w GROUP BY league""")
def report_by_league(spark, sf, days: int = DAYS):
    """Picks, settled picks, hit rate and units per league over the last `days` days before the newest entry."""
    book = v.ledger(spark, sf)
    newest = F.lit(book.agg(F.max("ts")).first()[0]).cast("date")
    owner = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("league"))
    rows = book.where(F.col("ts").cast("date") > F.date_sub(newest, days)).join(owner, "owner", "left")
    won = F.col("result") == "win"
    got = rows.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count("result").alias("settled"), F.count(F.when(won, 1)).alias("wins"), F.avg(won.cast("double")).alias("win_rate"),
                                     F.sum(F.when(won, F.col("odds") - 1).when(F.col("result") == "loss", F.lit(-1.0))).alias("units"), F.avg("odds").alias("avg_odds"))
    return rounded(got, ["league", "n", "settled", "wins"], ["win_rate", "units", "avg_odds"])


@query("last20_results", f"""WITH {v.LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, id DESC) AS rn FROM ledger WHERE result IS NOT NULL)
SELECT strategy, string_agg(upper(result[1]), '' ORDER BY rn DESC) AS last, count(*) AS n FROM r WHERE rn <= 20 GROUP BY strategy""")
def last20(spark, sf):
    return lg.last_results(v.ledger(spark, sf), BY, 20)


@query("day_picks", f"WITH {v.LEDGER_SQL} SELECT id, strategy, odds, prob, result FROM ledger WHERE CAST(ts AS DATE) = DATE '2000-03-01'")
def day_picks(spark, sf):
    """Picks of one day; the half-open range reaches the parquet scan as a pushed filter."""
    day = F.lit("2000-03-01").cast("timestamp_ntz")
    rows = v.ledger(spark, sf).where((F.col("ts") >= day) & (F.col("ts") < F.lit("2000-03-02").cast("timestamp_ntz")))
    return rows.select("id", "strategy", "odds", "prob", "result")


@query("history_by_date", f"""WITH {v.LEDGER_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (result = 'win') AS wins,
{sql_rnd("sum(CASE result WHEN 'win' THEN odds - 1 WHEN 'loss' THEN -1 END)")} AS units FROM ledger GROUP BY 1""")
def history_by_date(spark, sf, days: int | None = None):
    """Totals per day, of the whole ledger or of the last `days` days before its newest entry."""
    units = F.when(F.col("result") == "win", F.col("odds") - 1).when(F.col("result") == "loss", F.lit(-1.0))
    rows = v.ledger(spark, sf)
    if days is not None:
        newest = rows.agg(F.max("ts")).first()[0]
        rows = rows.where(F.lit(newest is not None) & (F.col("ts").cast("date") > F.date_sub(F.lit(newest).cast("date"), days)))
    return rows.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("result") == "win", 1)).alias("wins"), sc.rnd(F.sum(units)).alias("units"))


@query("closed_form_growth", f"""WITH {v.LEDGER_SQL}, h AS (SELECT strategy, CAST(id % 30 AS INT) AS grp, count(*) AS n, avg((result = 'win')::INT) AS win_rate, avg(odds) AS avg_odds FROM ledger WHERE result IS NOT NULL GROUP BY ALL),
f AS (SELECT *, least(greatest(0.0, (win_rate * (avg_odds - 1) - (1 - win_rate)) / (avg_odds - 1) * 0.25), 0.04) AS fraction FROM h),
g AS (SELECT strategy, grp, n, fraction, exp(n * (win_rate * ln(1 + fraction * (avg_odds - 1)) + (1 - win_rate) * ln(1 - fraction))) AS growth FROM f)
SELECT strategy, grp, n, {sql_rounded(['fraction', 'growth'])} FROM g""")
def closed_form(spark, sf):
    done = flat(spark, sf).withColumn("won", (F.col("result") == "win").cast("int")).withColumn("grp", (F.col("id") % 30).cast("int"))
    return rounded(lg.closed_form_growth(mx.hit_block(done, ["strategy", "grp"])), ["strategy", "grp", "n"], ["fraction", "growth"])


CAPS, FRACTIONS = [0.02, 0.04, 0.10], [0.10, 0.25, 0.50]


@query("stake_sweep", f"""WITH {v.LEDGER_SQL}, p AS (SELECT *, unnest({CAPS}) AS cap FROM ledger WHERE result IS NOT NULL), q AS (SELECT *, unnest({FRACTIONS}) AS share FROM p),
f AS (SELECT *, least(greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * share), cap) AS fr FROM q),
g AS (SELECT strategy, CAST(cap AS DOUBLE) AS cap, CAST(share AS DOUBLE) AS share, count(*) AS n, sum(ln(1 + CASE WHEN result = 'win' THEN fr * (odds - 1) ELSE -fr END)) AS ln_growth FROM f WHERE fr > 0 GROUP BY ALL)
SELECT strategy, cap, share, n, {sql_rounded(['ln_growth'])} FROM g""")
def stake_sweep(spark, sf):
    return rounded(lg.stake_sweep(v.ledger(spark, sf), BY, CAPS, FRACTIONS), ["strategy", "cap", "share", "n"], ["ln_growth"])


LEAST_EV = [0.05, 0.08, 0.10, 0.12, 0.14, 0.16, 0.17, 0.18, 0.20, 0.22, 0.25, 0.28, 0.30, 0.35, 0.40]


@query("stake_offsets", f"""WITH {v.LEDGER_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts, id) AS rn FROM ledger WHERE result IS NOT NULL),
f AS (SELECT d.*, CAST(c.cap AS DOUBLE) AS cap, CAST(h.share AS DOUBLE) AS share, least(greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * h.share), c.cap) AS fr
 FROM d, (SELECT unnest({CAPS}) AS cap) c, (SELECT unnest({FRACTIONS}) AS share) h),
g AS (SELECT strategy, ts, id, rn, cap, share, prob * odds - 1 AS ev, result, ln(1 + CASE WHEN result = 'win' THEN fr * (odds - 1) ELSE -fr END) AS x FROM f WHERE fr > 0),
e AS (SELECT g.*, CAST(t.min_ev AS DOUBLE) AS min_ev, CAST(o.start AS INT) AS start FROM g JOIN (SELECT unnest({LEAST_EV}) AS min_ev) t ON g.ev >= t.min_ev JOIN range(10) o(start) ON g.rn > 50 * o.start),
s AS (SELECT *, sum(x) OVER (PARTITION BY strategy, cap, share, min_ev, start ORDER BY ts, id) AS total FROM e),
p AS (SELECT *, greatest(0.0, max(total) OVER (PARTITION BY strategy, cap, share, min_ev, start ORDER BY ts, id)) AS peak FROM s),
r AS (SELECT strategy, cap, share, min_ev, start, count(*) AS n, count(*) FILTER (result = 'win') AS wins, sum(x) AS ln_growth, exp(min(total - peak)) - 1 AS max_drawdown FROM p GROUP BY ALL)
SELECT strategy, cap, share, min_ev, start, n, wins, {sql_rounded(['ln_growth', 'max_drawdown'])} FROM r""")
def stake_offsets(spark, sf):
    """Growth and deepest fall for every cap, share, least EV and start offset."""
    got = sn.stake_offsets(v.ledger(spark, sf), BY, CAPS, FRACTIONS, LEAST_EV)
    return rounded(got, ["strategy", "cap", "share", "min_ev", "start", "n", "wins"], ["ln_growth", "max_drawdown"])
