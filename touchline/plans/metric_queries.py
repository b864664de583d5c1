"""Queries of the scalar, aggregation, window and set families."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import scalars as sc
from touchline.operators import folds as fl
from touchline.operators import ledger as lg
from touchline.operators import metrics as mx
from touchline.operators.prefix import day_block, quantiles, running
from touchline.plans import views as v
from touchline.plans.registry import query, rounded, sql_rounded
from touchline.plans.views import sql_rnd
from touchline.sources.tables import read_table

NAMES = ["xg", "elo", "form", "mkt", "odds"]
HIT = ["win_rate", "avg_odds", "roi", "ev"]
_HIT_SQL = ("count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, avg(won) AS win_rate, avg(odds) AS avg_odds, avg(CASE WHEN won = 1 THEN odds - 1 ELSE -1 END) AS roi, "
            "avg(won) * avg(odds) - 1 AS ev")


def wilson_sql(wins: str = "wins", n: str = "n", upper: bool = False) -> str:
    return (f"(({wins} / {n} + 3.8416 / (2 * {n})) {'+' if upper else '-'} 1.96 * sqrt({wins} / {n} * (1 - {wins} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) "
            f"/ (1 + 3.8416 / {n})")


@query("hit_block", f"""WITH {v.FACTORS_SQL}, h AS (SELECT league, side, {_HIT_SQL} FROM factors GROUP BY ALL), w AS (SELECT *, {wilson_sql()} AS lower, {wilson_sql(upper=True)} AS upper FROM h)
SELECT league, side, n, wins, {sql_rounded([*HIT, 'lower', 'upper'])} FROM w""")
def hit_block(spark, sf):
    return rounded(mx.hit_block(v.factors(spark, sf), ["league", "side"]), ["league", "side", "n", "wins"], [*HIT, "lower", "upper"])


_EDGES, _LABELS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.6], ["1.0-1.5", "1.5-2.0", "2.0-2.5", "2.5-3.0", "3.0+"]
_BUCKET = "CASE " + " ".join(f"WHEN odds > {a} AND odds <= {b} THEN '{c}'" for a, b, c in zip(_EDGES, _EDGES[1:], _LABELS)) + " END"


@query("breakdown_cube", f"""WITH {v.FACTORS_SQL}, f AS (SELECT *, {_BUCKET} AS band, strftime(ts, '%Y-%m') AS month FROM factors),
h AS (SELECT league, band, month, CAST(grouping_id(league, band, month) AS INT) AS level, {_HIT_SQL} FROM f GROUP BY GROUPING SETS ((league), (band), (month), ()) HAVING count(*) >= 20)
SELECT league, band, month, level, n, wins, {sql_rounded(HIT)} FROM h""")
def breakdown_cube(spark, sf):
    rows = v.factors(spark, sf).withColumn("band", sc.bucket("odds", _EDGES, _LABELS)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    dims = ["league", "band", "month"]
    return rounded(mx.breakdown(rows, dims, 20), [*dims, "level", "n", "wins"], HIT)


@query("top_groups", f"""WITH {v.FACTORS_SQL}, h AS (SELECT league, CAST(date_trunc('month', ts) AS DATE) AS month, {_HIT_SQL} FROM factors GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY {sql_rnd('roi')} DESC, month) AS rank FROM h) SELECT league, month, n, CAST(rank AS INT) AS rank, {sql_rounded(['roi'])} FROM r WHERE rank <= 5""")
def top_groups(spark, sf):
    """Five best months per league."""
    h = mx.hit_block(v.factors(spark, sf).withColumn("month", F.trunc(F.col("ts").cast("date"), "month")), ["league", "month"])
    h = h.withColumn("roi", sc.rnd("roi"))
    w = W.partitionBy("league").orderBy(F.col("roi").desc(), "month")
    return h.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("league", "month", "n", "rank", "roi")


@query("best_per_owner", f"""WITH {v.LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY prob * odds - 1 DESC, id) AS rn FROM ledger)
SELECT owner, id, {sql_rnd('prob * odds - 1')} AS ev FROM r WHERE rn = 1""")
def best_per_owner(spark, sf):
    """One pick of highest expected value per key, ties by id."""
    rows = v.ledger(spark, sf).withColumn("ev", sc.expected_value("prob", "odds"))
    return rounded(lg.first_rows(rows, ["owner"], [F.col("ev").desc(), F.col("id")]), ["owner", "id"], ["ev"])


@query("first_of_day", f"""WITH {v.LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy, ts ORDER BY odds DESC, id) AS rn FROM ledger) SELECT strategy, ts, id FROM r WHERE rn = 1""")
def first_of_day(spark, sf):
    return lg.first_rows(v.ledger(spark, sf), ["strategy", "ts"], [F.col("odds").desc(), F.col("id")]).select("strategy", "ts", "id")


@query("target_encode", f"""WITH {v.SCORED_SQL}, f AS (SELECT *, CASE WHEN ts < TIMESTAMP '1999-06-01' THEN 1 END AS f1, CASE WHEN ts < TIMESTAMP '2000-06-01' THEN 1 END AS f2 FROM scored),
t AS (SELECT 1 AS fold, league, result FROM f WHERE f1 = 1 UNION ALL SELECT 2, league, result FROM f WHERE f2 = 1),
g AS (SELECT fold, count(*) AS gn, avg((result = 'H')::INT) AS gh, avg((result = 'D')::INT) AS gd, avg((result = 'A')::INT) AS ga FROM t GROUP BY fold),
l AS (SELECT fold, league, count(*) AS n, avg((result = 'H')::INT) AS h, avg((result = 'D')::INT) AS d, avg((result = 'A')::INT) AS a FROM t GROUP BY ALL),
e AS (SELECT l.fold, l.league, l.n, n / (n + 50.0) * h + 50.0 / (n + 50.0) * gh AS "rate_H", n / (n + 50.0) * d + 50.0 / (n + 50.0) * gd AS "rate_D", n / (n + 50.0) * a + 50.0 / (n + 50.0) * ga AS "rate_A"
FROM l JOIN g ON g.fold = l.fold) SELECT fold, league, n, {", ".join(f'{sql_rnd(chr(34) + c + chr(34))} AS "{c}"' for c in ("rate_H", "rate_D", "rate_A"))} FROM e""")
def target_encode(spark, sf):
    ends = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(d).cast("timestamp_ntz").alias("until")) for i, d in ((1, "1999-06-01"), (2, "2000-06-01"))]),
                              lambda f: F.col("ts") < f["until"])).alias("f")
    train = v.scored(spark, sf).select("league", "result", "ts", ends).select("league", "result", F.col("f.fold").alias("fold"))
    return rounded(mx.target_encode(train, "league", ["H", "D", "A"], "result", ["fold"]), ["fold", "league", "n"], ["rate_H", "rate_D", "rate_A"])


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS value, won, league FROM factors WHERE {n} IS NOT NULL" for n in NAMES) + ")"


@query("effect_size", f"""WITH {v.FACTORS_SQL}, {_LONG}, s AS (SELECT feature, count(*) FILTER (won = 1) AS n1, count(*) FILTER (won = 0) AS n0, avg(value) FILTER (won = 1) AS mean1,
avg(value) FILTER (won = 0) AS mean0, var_samp(value) FILTER (won = 1) AS v1, var_samp(value) FILTER (won = 0) AS v0 FROM long GROUP BY feature),
d AS (SELECT feature, n1, n0, mean1, mean0, (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM s) SELECT feature, n1, n0, {sql_rounded(['mean1', 'mean0', 'd'])} FROM d""")
def effect_size(spark, sf):
    return rounded(mx.effect_size(v.factors(spark, sf), "won", NAMES), ["feature", "n1", "n0"], ["mean1", "mean0", "d"])


@query("inventory", f"""WITH {v.FACTORS_SQL}, {_LONG}, q AS (SELECT feature, count(*) AS n, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
FROM long GROUP BY feature) SELECT feature, n, {sql_rounded(['min', 'q25', 'median', 'q75', 'max'])} FROM q""")
def inventory(spark, sf):
    return rounded(mx.inventory(v.factors(spark, sf), NAMES), ["feature", "n"], ["min", "q25", "median", "q75", "max"])


@query("median_position", f"""WITH {v.FACTORS_SQL}, {_LONG}, m AS (SELECT feature, quantile_cont(value, 0.5) AS group_median FROM long WHERE won = 1 GROUP BY feature),
p AS (SELECT feature, group_median, avg((value <= group_median)::INT) AS position FROM long JOIN m USING (feature) GROUP BY ALL) SELECT feature, {sql_rounded(['group_median', 'position'])} FROM p""")
def median_position(spark, sf):
    return rounded(mx.position_of_median(v.factors(spark, sf), F.col("won") == 1, NAMES), ["feature"], ["group_median", "position"])


_QC = [f"{t}_{n}" for t in ("low", "high") for n in ("win_rate", "roi")]


@query("quartile_contrast", f"""WITH {v.FACTORS_SQL}, x AS (SELECT *, CASE WHEN won = 1 THEN odds - 1 ELSE -1 END AS unit FROM factors WHERE elo IS NOT NULL),
q AS (SELECT league, quantile_cont(elo, 0.25) AS a, quantile_cont(elo, 0.75) AS b FROM x GROUP BY league),
r AS (SELECT league, count(*) FILTER (elo <= a) AS low_n, count(*) FILTER (elo >= b) AS high_n, avg(won) FILTER (elo <= a) AS low_win_rate, avg(won) FILTER (elo >= b) AS high_win_rate,
avg(unit) FILTER (elo <= a) AS low_roi, avg(unit) FILTER (elo >= b) AS high_roi FROM x JOIN q USING (league) GROUP BY league) SELECT league, low_n, high_n, {sql_rounded(_QC)} FROM r""")
def quartile_contrast(spark, sf):
    rows = v.factors(spark, sf).where(F.col("elo").isNotNull())
    return rounded(mx.quartile_contrast(rows, "elo", ["league"]), ["league", "low_n", "high_n"], _QC)


@query("correlation", f"WITH {v.FACTORS_SQL}, c AS (SELECT league, corr(form, odds) AS r_form, corr(elo, won) AS r_elo FROM factors GROUP BY league) SELECT league, {sql_rounded(['r_form', 'r_elo'])} FROM c")
def correlation(spark, sf):
    got = v.factors(spark, sf).groupBy("league").agg(F.corr("form", "odds").alias("r_form"), F.corr("elo", "won").alias("r_elo"))
    return rounded(got, ["league"], ["r_form", "r_elo"])


FLAGS = {"xg_high": "xg >= 1.3", "elo_up": "elo >= 30", "elo_down": "elo <= -30", "form_high": "form >= 2.4", "form_low": "form < 1.8",
         "mkt_high": "mkt >= 0.5", "short_price": "odds < 1.8", "long_price": "odds >= 2.8", "home": "side = 'home'"}
_ACTIVE = "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FLAGS.items()) + "]"


def flagged(spark, sf):
    active = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in FLAGS.items()]))
    return v.factors(spark, sf).select("contest_id", "league", "won", "odds", active.alias("active"))


_FLAGGED = f"{v.FACTORS_SQL}, fl AS (SELECT contest_id, won, odds, {_ACTIVE} AS active FROM factors)"


@query("factor_lift", f"""WITH {_FLAGGED}, b AS (SELECT count(*) AS bn, sum(won) AS bw FROM fl), e AS (SELECT * FROM (SELECT unnest(active) AS factor, won, odds FROM fl) WHERE factor IS NOT NULL),
g AS (SELECT factor, count(*) AS n, sum(won) AS w, avg(won) AS win_rate, avg(CASE WHEN won = 1 THEN odds - 1 ELSE -1 END) AS roi FROM e GROUP BY factor),
x AS (SELECT factor, n, win_rate, roi, win_rate / (bw / bn) - 1 AS lift, win_rate - (bw - w) / (bn - n) AS difference FROM g, b) SELECT factor, n, {sql_rounded(['win_rate', 'lift', 'roi', 'difference'])} FROM x""")
def factor_lift(spark, sf):
    return rounded(mx.factor_lift(flagged(spark, sf)), ["factor", "n"], ["win_rate", "lift", "roi", "difference"])


@query("factor_pairs", f"""WITH {_FLAGGED}, e AS (SELECT * FROM (SELECT contest_id, unnest(active) AS f, won, odds FROM fl) WHERE f IS NOT NULL),
p AS (SELECT x.f AS a, y.f AS b, x.won, x.odds FROM e x JOIN e y ON x.contest_id = y.contest_id AND x.f < y.f),
h AS (SELECT a, b, {_HIT_SQL} FROM p GROUP BY ALL HAVING count(*) >= greatest(4, (SELECT count(*) FROM fl) * 0.05)) SELECT a, b, n, wins, {sql_rounded(HIT)} FROM h""")
def factor_pairs(spark, sf):
    return rounded(mx.factor_pairs(flagged(spark, sf)), ["a", "b", "n", "wins"], HIT)


@query("named_predicates", f"""WITH {_FLAGGED}, e AS (SELECT * FROM (SELECT unnest(active) AS label, won, odds FROM fl) WHERE label IS NOT NULL), h AS (SELECT label, {_HIT_SQL} FROM e GROUP BY label HAVING count(*) >= 30),
w AS (SELECT *, {wilson_sql()} AS lower FROM h) SELECT label, n, wins, {sql_rounded([*HIT, 'lower'])} FROM w""")
def named_predicates(spark, sf):
    got = mx.named_predicates(v.factors(spark, sf), {n: F.expr(c) for n, c in FLAGS.items()}, 30)
    return rounded(got, ["label", "n", "wins"], [*HIT, "lower"])


@query("pattern_alarms", f"""WITH {_FLAGGED}, e AS (SELECT * FROM (SELECT unnest(active) AS label, won, odds FROM fl) WHERE label IS NOT NULL), h AS (SELECT label, {_HIT_SQL} FROM e GROUP BY label HAVING count(*) >= 10 AND avg(won) < 0.34)
SELECT label, n, wins, {sql_rounded(HIT)} FROM h""")
def pattern_alarms(spark, sf):
    """Named conditions whose hit rate is low."""
    got = mx.named_predicates(v.factors(spark, sf), {n: F.expr(c) for n, c in FLAGS.items()}, 10).where("win_rate < 0.34")
    return rounded(got, ["label", "n", "wins"], HIT)


@query("loss_metrics", f"""WITH {v.SCORED_SQL}, l AS (SELECT count(*) AS n, avg(-ln(greatest(CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1e-15))) AS log_loss,
avg(power(p_home - (result = 'H')::INT, 2) + power(p_draw - (result = 'D')::INT, 2) + power(p_away - (result = 'A')::INT, 2)) AS brier FROM scored) SELECT n, {sql_rounded(['log_loss', 'brier'])} FROM l""")
def loss_metrics(spark, sf):
    return rounded(mx.loss_metrics(v.scored(spark, sf)), ["n"], ["log_loss", "brier"])


_CLS = "cls AS (" + " UNION ALL ".join(f"SELECT league, '{c}' AS cls, {p} AS p, (result = '{c}')::INT AS y FROM scored" for c, p in (("H", "p_home"), ("D", "p_draw"), ("A", "p_away"))) + ")"


@query("ranking_metrics", f"""WITH {v.SCORED_SQL}, {_CLS}, r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS rk FROM cls),
auc AS (SELECT cls, CAST(sum(y) AS BIGINT) AS positives, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc FROM r GROUP BY cls),
c AS (SELECT cls, p, sum(y) AS y, count(*) AS n FROM cls GROUP BY ALL), u AS (SELECT cls, y, sum(y) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY cls ORDER BY p DESC)),
ap AS (SELECT cls, sum(y * tp / seen) / sum(y) AS avg_precision FROM u GROUP BY cls) SELECT cls, positives, {sql_rounded(['auc', 'avg_precision'])} FROM auc JOIN ap USING (cls)""")
def ranking_metrics(spark, sf):
    return rounded(mx.ranking_metrics(mx.class_rows(v.scored(spark, sf)), ["cls"]), ["cls", "positives"], ["auc", "avg_precision"])


@query("class_prior", f"WITH {v.SCORED_SQL}, g AS (SELECT result, count(*) AS n FROM scored GROUP BY result) SELECT result, n, {sql_rnd('n / sum(n) OVER ()')} AS prior FROM g")
def class_prior(spark, sf):
    got = v.scored(spark, sf).groupBy("result").agg(F.count(F.lit(1)).alias("n"))  # three rows
    return got.select("result", "n", sc.rnd(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("prior"))


@query("coverage", f"""WITH {v.CONTESTS_SQL}, q AS (SELECT DISTINCT l_partkey AS contest_id FROM lineitem WHERE l_quantity > 25)
SELECT pool, count(*) AS contests, count(q.contest_id) AS with_quotes FROM contests g LEFT JOIN q USING (contest_id) GROUP BY pool""")
def coverage(spark, sf):
    q = read_table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("contest_id"))
    return mx.coverage(v.contests(spark, sf), q)


@query("half_split", f"""WITH {v.FACTORS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts, contest_id) AS rn, count(*) OVER (PARTITION BY league) AS total FROM factors),
h AS (SELECT league, CASE WHEN rn <= total // 2 THEN 1 ELSE 2 END AS half, {_HIT_SQL} FROM r GROUP BY ALL), w AS (SELECT *, {wilson_sql()} AS lower FROM h) SELECT league, half, n, wins, {sql_rounded([*HIT, 'lower'])} FROM w""")
def half_split(spark, sf):
    got = mx.hit_block(fl.chronological_halves(v.factors(spark, sf), ["league"], ["ts", "contest_id"]), ["league", "half"])
    return rounded(got, ["league", "half", "n", "wins"], [*HIT, "lower"])


@query("percentile_cut", f"""WITH {v.LEDGER_SQL}, f AS (SELECT *, CAST(year(ts) AS INT) AS fold FROM ledger), q AS (SELECT fold, quantile_cont(prob, 0.8) AS cut FROM f GROUP BY fold)
SELECT id, fold FROM f JOIN q USING (fold) WHERE prob >= cut""")
def percentile_cut(spark, sf):
    """Rows in the top fifth of their fold by probability."""
    rows = v.ledger(spark, sf).withColumn("fold", F.year("ts"))
    return rows.join(quantiles(rows, ["fold"], "prob", {"cut": 0.8}), "fold").where("prob >= cut").select("id", "fold")


FOLD = {"train_months": 12, "test_months": 3, "step_months": 3}
_FOLDS_SQL = """span AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM contests),
folds AS (SELECT CAST(k AS INT) AS fold, a, a + INTERVAL 1 MONTH * (12 + 3 * k) AS test_from, a + INTERVAL 1 MONTH * (15 + 3 * k) AS test_to FROM span, generate_series(0, 200) t(k)
  WHERE a + INTERVAL 1 MONTH * (12 + 3 * k) <= z)"""


@query("folds_expand", f"""WITH {v.CONTESTS_SQL}, {_FOLDS_SQL}
SELECT fold, CASE WHEN ts < test_from THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(sum(home_score) AS BIGINT) AS goals FROM contests JOIN folds ON ts < test_to GROUP BY ALL""")
def folds_expand(spark, sf):
    """Rows and goals per expanding fold and role; months are summed before being spread over folds."""
    games = v.contests(spark, sf)
    months = games.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("goals"))
    rows = fl.expanding_folds(months, "month", **FOLD)
    return rows.groupBy("fold", "role").agg(F.sum("n").alias("n"), F.sum("goals").alias("goals"))


@query("folds_assign", f"""WITH {v.CONTESTS_SQL}, {_FOLDS_SQL} SELECT contest_id, fold FROM contests JOIN folds ON ts >= test_from AND ts < test_to""")
def folds_assign(spark, sf):
    """The fold in which each contest is tested."""
    return fl.expanding_folds(v.contests(spark, sf).select("contest_id", "ts"), "ts", **FOLD, roles=("test",)).select("contest_id", "fold")


@query("folds_reverse", f"""WITH {v.CONTESTS_SQL}, span AS (SELECT min(ts) AS a, max(ts) + INTERVAL 1 DAY AS z FROM contests),
f AS (SELECT k, z - INTERVAL 1 MONTH * (2 * k) AS val_from, z - INTERVAL 1 MONTH * (2 * (k - 1)) AS val_to, a FROM span, generate_series(1, 12) t(k)),
c AS (SELECT k, count(*) FILTER (ts < val_from - INTERVAL 10 DAY) AS n_train, count(*) FILTER (ts >= val_from AND ts < val_to) AS n_val, any_value(val_from) AS vf, any_value(a) AS a FROM contests, f GROUP BY k)
SELECT CAST(row_number() OVER (ORDER BY k DESC) AS INT) AS fold, n_train, n_val FROM c WHERE n_val >= 30 AND n_train >= 300 AND vf - INTERVAL 10 DAY > a + INTERVAL 18 MONTH""")
def folds_reverse(spark, sf):
    return fl.reverse_folds(v.contests(spark, sf).select("ts"), "ts")


@query("folds_rows", f"""WITH {v.CONTESTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY ts, contest_id) AS rn FROM contests)
SELECT contest_id, CAST((rn - 1001) // 50 AS INT) AS step FROM r WHERE rn > 1000""")
def folds_rows(spark, sf):
    return fl.row_count_steps(v.contests(spark, sf).select("contest_id", "ts"), ["ts", "contest_id"], 1000, 50).select("contest_id", "step")


@query("quarters", f"""WITH {v.CONTESTS_SQL} SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter, pool, count(*) AS n FROM contests GROUP BY ALL""")
def quarters(spark, sf):
    return v.contests(spark, sf).groupBy(F.trunc(F.col("ts").cast("date"), "quarter").alias("quarter"), "pool").agg(F.count(F.lit(1)).alias("n"))


@query("scalar_block", f"""WITH {v.LEDGER_SQL}, x AS (SELECT id, 1 / odds AS implied, prob * odds - 1 AS ev, prob - 1 / odds AS edge, prob / (1 / odds) - 1 AS clv,
least(greatest(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1) * 0.25), 0.04) AS kelly FROM ledger)
SELECT id, {sql_rounded(['implied', 'ev', 'edge', 'clv', 'kelly'])}, {sql_rnd('least(1000 * kelly, 1000 * 0.04)', 2)} AS stake FROM x""")
def scalar_block(spark, sf):
    """Implied chance, expected value, edge, line value, Kelly share and stake of every pick."""
    rows = lg.with_kelly(v.ledger(spark, sf)).select(
        "id", sc.implied_probability("odds").alias("implied"), sc.expected_value("prob", "odds").alias("ev"),
        (F.col("prob") - sc.implied_probability("odds")).alias("edge"), sc.closing_line_value("prob", "odds").alias("clv"),
        F.col("fraction").alias("kelly"), sc.stake(F.lit(1000.0), "fraction").alias("stake"))
    return rounded(rows, ["id", "stake"], ["implied", "ev", "edge", "clv", "kelly"])


@query("value_filter", f"""WITH {v.LEDGER_SQL} SELECT id, strategy, odds FROM ledger WHERE odds >= 1.5 AND odds <= 3.0 AND prob * odds - 1 >= 0.05 AND prob - 1 / odds >= 0.02 AND prob >= 0.4""")
def value_filter(spark, sf):
    ok = F.col("odds").between(1.5, 3.0) & (sc.expected_value("prob", "odds") >= 0.05) & (F.col("prob") - sc.implied_probability("odds") >= 0.02) & (F.col("prob") >= 0.4)
    return v.ledger(spark, sf).where(ok).select("id", "strategy", "odds")


@query("ratio_block", f"""WITH {v.LOG_SQL}, x AS (SELECT contest_id, side, score - score_ag AS diff, sign(score - score_ag) AS sgn, sot / nullif(sot_ag, 0) AS ratio, sot / greatest(sot_ag, 0.1) AS floored,
CASE WHEN sot_ag > 0 THEN sot / sot_ag ELSE 1.0 END AS one FROM log) SELECT contest_id, side, diff, CAST(sgn AS INT) AS sgn, {sql_rnd('ratio')} AS ratio, CASE WHEN floored IS NOT NULL AND ratio0 THEN {sql_rnd('floored')} END AS floored, {sql_rnd('one')} AS one
FROM (SELECT x.*, l.sot_ag IS NOT NULL AND l.sot IS NOT NULL AS ratio0 FROM x JOIN log l USING (contest_id, side))""")
def ratio_block(spark, sf):
    """Null-propagating difference, sign and three ratio rules."""
    log = v.team_log(spark, sf, ["score", "sot"])
    known = F.col("sot").isNotNull() & F.col("sot_ag").isNotNull()
    return log.select("contest_id", "side", (F.col("score") - F.col("score_ag")).alias("diff"), F.signum(F.col("score") - F.col("score_ag")).cast("int").alias("sgn"),
                      sc.rnd(sc.safe_div("sot", F.col("sot_ag"))).alias("ratio"), F.when(known, sc.rnd(sc.floor_ratio("sot", "sot_ag"))).alias("floored"),
                      sc.rnd(sc.ratio_or_one("sot", "sot_ag")).alias("one"))


@query("labels_and_keys", f"""WITH {v.LEDGER_SQL}, n AS (SELECT c_custkey, 'REGION: ' || r_name || ' ' || n_name AS key, lower(replace(replace(r_name || ': ' || n_name, ': ', '_'), ' ', '_')) AS slug
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT id, key, 'pool_' || slug AS slug, CASE WHEN odds < 2 THEN 'BTTS YES' ELSE 'OVER 2.5' END AS label, CASE WHEN result IS NOT NULL THEN 'finished' WHEN ts <= TIMESTAMP '2000-01-01' THEN 'live' ELSE 'pending' END AS phase
FROM ledger JOIN n ON owner = c_custkey""")
def labels_and_keys(spark, sf):
    """Canonical pool key, sanitised column name, market label and contest phase."""
    nations = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = read_table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.concat_ws(" ", F.concat_ws(": ", F.lit("REGION"), F.col("r_name")), "n_name")
    slug = F.concat(F.lit("pool_"), F.lower(F.regexp_replace(F.regexp_replace(F.concat_ws(": ", "r_name", "n_name"), ": ", "_"), " ", "_")))
    market = F.when(F.col("odds") < 2, "btts").otherwise("total")
    pick = F.when(F.col("odds") < 2, "yes").otherwise("over 2.5")
    status = F.when(F.col("result").isNotNull(), "Finished").otherwise("1H")
    return v.ledger(spark, sf).join(who, F.col("owner") == F.col("c_custkey")).select(
        "id", key.alias("key"), slug.alias("slug"), sc.market_label(market, pick).alias("label"),
        sc.phase_label(status, "ts", F.lit("2000-01-01").cast("timestamp_ntz")).alias("phase"))


@query("one_hot", "SELECT c_custkey AS id, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS seg_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark, sf):
    segs = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg_{s.lower()}") for s in segs])


@query("weight_rescale", f"""WITH {_FLAGGED}, e AS (SELECT * FROM (SELECT unnest(active) AS factor, won FROM fl) WHERE factor IS NOT NULL), g AS (SELECT factor, avg(won) - (SELECT avg(won) FROM fl) AS coef FROM e GROUP BY factor)
SELECT factor, CAST(CASE WHEN coef <= 0 THEN 0 ELSE greatest(1, floor(coef / max(coef) OVER () * 20 + 0.5)) END AS INT) AS weight FROM g""")
def weight_rescale(spark, sf):
    """Positive coefficients to integer weights 1..20 by their ratio to the largest."""
    lift = mx.factor_lift(flagged(spark, sf))
    coef = lift.select("factor", (F.col("win_rate") - F.col("win_rate") / (F.col("lift") + 1)).alias("coef"))
    return fl.rescale_weights(coef, "coef").select("factor", "weight")


@query("alias_match", """WITH q AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS word, p_size % 25 AS nk, p_size FROM part),
c AS (SELECT q.id, word, n_nationkey, n_name, row_number() OVER (PARTITION BY q.id ORDER BY n_nationkey) AS rn FROM q JOIN nation ON n_nationkey % 5 = q.nk % 5 AND n_name ILIKE '%' || q.nk || '%')
SELECT id, n_nationkey, n_name FROM c WHERE rn = 1""")
def alias_match(spark, sf):
    """Text contained in an entity's name within the same block (equi key first), first of the hits kept."""
    q = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("nk"))
    from touchline.operators.resolve import contains_match
    left = q.withColumn("blk", F.col("nk") % 5).withColumn("text", F.col("nk").cast("string"))
    right = read_table(spark, sf, "nation").withColumn("blk", F.col("n_nationkey") % 5)
    return contains_match(left, right, ["blk"], "text", "n_name", "id", "n_nationkey").select("id", "n_nationkey", "n_name")


@query("set_compare", """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.05), b AS (SELECT l_partkey, count(*) AS holders, min(l_suppkey) AS one FROM a GROUP BY l_partkey)
SELECT s.l_suppkey AS supplier, count(*) AS members, count(*) FILTER (holders = 1) AS unique_members FROM a s JOIN b USING (l_partkey) GROUP BY s.l_suppkey""")
def set_compare(spark, sf):
    """Members held by one set only against shared members."""
    a = read_table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_suppkey", "l_partkey").agg(F.lit(1).alias("one"))
    holders = a.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("holders"))
    return (a.join(holders, "l_partkey").groupBy(F.col("l_suppkey").alias("supplier"))
            .agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("holders") == 1, 1)).alias("unique_members")))


@query("running_count", f"WITH {v.LOG_SQL} SELECT contest_id, team, count(*) OVER (PARTITION BY team ORDER BY ts, contest_id) AS played FROM log")
def running_count(spark, sf):
    return running(v.team_log(spark, sf), ["team"], ["ts", "contest_id"], day_block("ts"), {"played": ("count", F.lit(1))}).select("contest_id", "team", "played")


@query("running_count_nulls", """SELECT event_id, count(*) OVER w AS seen, sum(value) OVER w AS total FROM (
  SELECT event_id, value, CASE WHEN event_id % 7 <> 0 THEN user_id % 5 END AS k, CASE WHEN event_id % 11 <> 0 THEN ts END AS t FROM events)
WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_count_nulls(spark, sf):
    """Running totals of few hot keys, with NULL keys and NULL times among them."""
    e = read_table(spark, sf, "events")
    rows = e.select("event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 5).alias("k"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("t"))
    got = running(rows, ["k"], ["t", "event_id"], day_block("t"), {"seen": ("count", F.lit(1)), "total": ("sum", F.col("value"))})
    return got.select("event_id", "seen", "total")
