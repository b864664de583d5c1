"""Queries of the learning and calibration family."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.devig import with_probs
from touchline.functions.scalars import expected_value, kelly_fraction, rnd
from touchline.operators import calibrate as cb
from touchline.operators import folds as fl
from touchline.operators import form as fm
from touchline.operators import learn as ln
from touchline.operators import ledger as lg
from touchline.operators import metrics as mx
from touchline.operators import ratings as rt
from touchline.operators import rules as ru
from touchline.operators import sweep as sw
from touchline.operators.factor_table import FACTORS
from touchline.operators.prefix import quantiles
from touchline.plans import matrix as mt
from touchline.plans import views as v
from touchline.plans.form_queries import _FORM, _W
from touchline.plans.quote_queries import ODDS
from touchline.plans.registry import query, rounded, sql_rounded
from touchline.plans.rule_queries import STRUCTURE, score_sql
from touchline.plans.views import sql_rnd
from touchline.session import cut, stored

FEATURES = ["strength", "size", "mkt_p_home", "mkt_p_away", "home_odds", "away_odds"]
FOLDS = [("2000-01-01", "2000-07-01"), ("2000-07-01", "2001-01-01"), ("2001-01-01", "2001-11-01")]


def learn_rows(spark, sf):
    """Scored contests as a training table (base chances renamed, labels, market chances)."""
    rows = with_probs(v.scored(spark, sf).dropna(subset=ODDS))
    base = rows.select(*[F.col(c).alias(f"base_{c}") if c in ln.PROBS else F.col(c) for c in rows.columns])
    return cut(ln.with_label(base).withColumn("size", F.col("size").cast("double")))


BASE = [f"base_{p}" for p in ln.PROBS]


def oof(rows, features):
    return ln.walk_forward(rows, FOLDS, lambda train: ln.logistic(features))


@query("logit_walk_forward")
def logit_walk_forward(spark, sf):
    """Out-of-fold chances of a standardised logistic model, with league rates encoded on each fold's training rows."""
    rows = learn_rows(spark, sf)

    def encode(train, test):
        rates = mx.target_encode(train, "league", ["H", "D", "A"], "result")
        whole = rates.limit(1).select("global_H", "global_D", "global_A")  # the same on every row
        base = whole.first()
        per = rates.select("league", "rate_H", "rate_D", "rate_A")
        fill = {f"rate_{c}": base[f"global_{c}"] for c in ("H", "D", "A")} if base else {}
        return tuple(x.join(per, "league", "left").fillna(fill) for x in (train, test))

    got = ln.walk_forward(rows, FOLDS, lambda train: ln.logistic([*FEATURES, *BASE, "rate_H", "rate_D", "rate_A"]), encode=encode)
    return rounded(ln.covered(rows, got), ["contest_id", "fold"], ln.PROBS, 4)


@query("boosted_trees")
def boosted_trees(spark, sf):
    rows = learn_rows(spark, sf)
    start = F.lit(FOLDS[-1][0]).cast("timestamp_ntz")
    got = ln.boosted(rows.where(F.col("ts") < start), rows.where(F.col("ts") >= start), [*FEATURES, *BASE])
    return rounded(got, ["contest_id"], ln.PROBS, 4)


@query("stacking")
def stacking(spark, sf):
    """Two base models, a multinomial stack on their chances and a weighted mean, by log loss."""
    rows = learn_rows(spark, sf)
    a = cut(oof(rows, FEATURES))
    b = cut(ln.walk_forward(rows, FOLDS, lambda train: ln.forest([*FEATURES, *BASE], 10, 4)))
    bases = ln.base_columns({"lr": a, "rf": b}).join(rows.select("contest_id", "ts", "label", "result"), "contest_id")
    cols = [f"{m}_{p}" for m in ("lr", "rf") for p in ln.PROBS]
    stack = ln.walk_forward(cut(bases), FOLDS[1:], lambda train: ln.logistic(cols))
    mean = ln.weighted_average(bases, {"lr": 0.6, "rf": 0.4})
    out = [mx.loss_metrics(df).withColumn("model", F.lit(n)) for n, df in (("stack", stack), ("mean", mean), ("lr", a), ("rf", b))]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]), ["model", "n"], ["log_loss", "brier"], 5)


def _iso(prefix: str) -> str:
    return f"""pts AS (SELECT head, cls, p, count(*) AS n, sum(y) AS s, row_number() OVER (PARTITION BY head, cls ORDER BY p) AS i FROM {prefix} GROUP BY head, cls, p),
cum AS (SELECT *, sum(n) OVER (PARTITION BY head, cls ORDER BY i) AS cn, sum(s) OVER (PARTITION BY head, cls ORDER BY i) AS cs FROM pts),
mm AS (SELECT a.head, a.cls, a.i AS j, b.i AS i, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.head, a.cls, a.i ORDER BY b.i DESC) AS m FROM cum a JOIN cum b ON a.head = b.head AND a.cls = b.cls AND b.i >= a.i),
iso AS (SELECT head, cls, i, max(m) AS value FROM mm GROUP BY head, cls, i), fit AS (SELECT pts.head, pts.cls, pts.p, value FROM pts JOIN iso USING (head, cls, i))"""


@query("isotonic_heads", f"""WITH {v.SCORED_SQL}, cut AS (SELECT quantile_cont(epoch(ts), 0.85) AS c FROM scored), tail AS (SELECT * FROM scored, cut WHERE epoch(ts) >= c),
lh AS (SELECT league, 'league:' || league AS head FROM tail GROUP BY league HAVING count(*) >= 15), chd AS (SELECT cluster, 'cluster:' || cluster AS head FROM tail GROUP BY cluster HAVING count(*) >= 50),
tr AS (SELECT 'global' AS head, * FROM tail UNION ALL SELECT head, tail.* FROM tail JOIN lh USING (league) UNION ALL SELECT head, tail.* FROM tail JOIN chd USING (cluster)),
cls AS ({" UNION ALL ".join(f"SELECT head, '{c}' AS cls, {p} AS p, (result = '{c}')::INT AS y FROM tr" for c, p in (("H", "p_home"), ("D", "p_draw"), ("A", "p_away")))}), {_iso('cls')},
asg AS (SELECT s.*, coalesce(lh.head, chd.head, 'global') AS head FROM scored s LEFT JOIN lh USING (league) LEFT JOIN chd USING (cluster)),
ask AS ({" UNION ALL ".join(f"SELECT contest_id, head, '{c}' AS cls, {p} AS p FROM asg" for c, p in (("H", "p_home"), ("D", "p_draw"), ("A", "p_away")))}),
lo AS (SELECT ask.*, f.p AS p0, f.value AS v0 FROM ask ASOF LEFT JOIN fit f ON ask.head = f.head AND ask.cls = f.cls AND ask.p >= f.p),
hi AS (SELECT lo.*, f.p AS p1, f.value AS v1 FROM lo ASOF LEFT JOIN fit f ON lo.head = f.head AND lo.cls = f.cls AND lo.p <= f.p),
val AS (SELECT contest_id, head, cls, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (p - p0) / (p1 - p0) * (v1 - v0) END AS c FROM hi),
w AS (SELECT contest_id, head, max(c) FILTER (cls = 'H') AS h, max(c) FILTER (cls = 'D') AS d, max(c) FILTER (cls = 'A') AS a FROM val GROUP BY ALL),
z AS (SELECT contest_id, head, h / greatest(h + d + a, 1e-9) AS c_home, d / greatest(h + d + a, 1e-9) AS c_draw, a / greatest(h + d + a, 1e-9) AS c_away FROM w) SELECT contest_id, head, {sql_rounded(['c_home', 'c_draw', 'c_away'])} FROM z""")
def isotonic(spark, sf):
    """Calibrated chances by league, cluster or global head."""
    return rounded(cb.calibrate(v.scored(spark, sf), min_league=15), ["contest_id", "head"], ["c_home", "c_draw", "c_away"])


@query("kmeans_profile")
def kmeans_profile(spark, sf):
    return rounded(cb.league_profiles(v.scored(spark, sf), 3), ["league", "label"], ln.PROBS)


@query("cluster_calibration")
def cluster_calibration(spark, sf):
    """Calibration with k-means clusters as the middle head."""
    return rounded(cb.calibrate(cut(cb.with_clusters(v.scored(spark, sf), "kmeans-3")), tail=0.10, min_league=20), ["contest_id", "head"], ["c_home", "c_draw", "c_away"], 4)


@query("platt_scaling")
def platt_scaling(spark, sf):
    rows = v.scored(spark, sf).withColumn("home_win", (F.col("result") == "H").cast("int"))
    return rounded(ln.platt(rows, "p_home", "home_win"), ["contest_id"], ["calibrated"], 4)


@query("filtered_model")
def filtered_model(spark, sf):
    """A rule-filtered binary model per fold, its top 35% by chance with positive value, one compounded balance."""
    rows = cut(v.factors(spark, sf).where("side = 'home' AND xg >= 1.2 AND odds BETWEEN 2.4 AND 3.5 AND elo IS NOT NULL").withColumn("label", F.col("won").cast("double")))
    folds = [("1998-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-08-01")]
    got = ln.walk_forward(rows, folds, lambda train: ln.logistic(["xg", "elo", "form"], binary=True), ["p_loss", "p_win"])
    got = cut(got.select("contest_id", "ts", "fold", "odds", "won", "p_win"))
    top = got.join(quantiles(got, ["fold"], "p_win", {"cut": 0.65}), "fold").where("p_win >= cut").withColumn("ev", expected_value("p_win", "odds")).where("ev >= 0")
    bets = top.select(F.lit("all").alias("strategy"), F.col("contest_id").alias("id"), "ts", "fold", "odds", F.when(F.col("won") == 1, "win").otherwise("loss").alias("result"),
                      F.least(kelly_fraction("p_win", "odds", 0.25), F.lit(0.04)).alias("fraction"))
    return rounded(lg.compound_equity(bets, ["strategy"]), ["id", "fold", "result"], ["ln_balance", "drawdown"], 4)


@query("confidence_sweep")
def confidence_sweep(spark, sf):
    """Confidence x edge grid on out-of-fold chances, with closed-form growth per stake cap."""
    picks = sw.favoured_side(oof(learn_rows(spark, sf), [*FEATURES, *BASE]))
    dims = [sw.Dim("min_bet", F.col("p_side"), (0.35, 0.40, 0.45, 0.50), ">", False), sw.Dim("min_edge", F.col("edge"), (-0.20, -0.10, 0.0, 0.05), ">", False)]
    points = cut(sw.sweep(picks, [], dims, 5))
    caps = [lg.closed_form_growth(points, 0.25, c).withColumn("cap", F.lit(c)) for c in (0.02, 0.04, 0.10)]
    return rounded(caps[0].unionByName(caps[1]).unionByName(caps[2]), ["min_bet", "min_edge", "cap", "n"], ["win_rate", "roi", "growth"], 4)


GROUPS = {"market": ["mkt_p_home", "mkt_p_away", "home_odds", "away_odds"], "base": BASE, "entity": ["strength", "size"]}


def _halves(rows):
    start = F.lit(FOLDS[0][0]).cast("timestamp_ntz")
    return rows.where(F.col("ts") < start), rows.where(F.col("ts") >= start)


@query("ablation")
def ablation(spark, sf):
    train, test = _halves(learn_rows(spark, sf))
    return rounded(ln.ablation(train, test, GROUPS, lambda keep, tr: ln.logistic(keep)), ["without", "features", "n"], ["log_loss", "brier"], 5)


@query("importance")
def importance(spark, sf):
    """Tree importance per feature with its group total and permutation rise of the log loss."""
    train, test = _halves(learn_rows(spark, sf))
    feats = [f for fs in GROUPS.values() for f in fs]
    tree = ln.tree_importance(train, feats, {f: g for g, fs in GROUPS.items() for f in fs})
    perm = ln.permutation_importance(test, feats, ln.logistic(feats).fit(train))
    totals = tree.groupBy("grp").agg(F.sum("importance").alias("grp_total"))
    return rounded(tree.join(totals, "grp").join(perm, "feature"), ["feature", "grp"], ["importance", "grp_total", "rise"], 5)


def flag_rows(spark, sf, side="home"):
    """0/1 factor flags of one side of every priced contest."""
    m = ru.with_defaults(mt.contest_matrix(spark, sf)).where(F.col(f"{side}_odds").isNotNull())
    names = [n for s, n, _, _, _ in FACTORS if s == side]
    flags = [F.expr(c).cast("int").alias(n) for s, n, c, _, _ in FACTORS if s == side]
    return m.select("contest_id", "ts", (F.col("target") == side).cast("int").alias("won"), F.col(f"{side}_odds").alias("odds"), *flags), names


@query("factor_weights")
def factor_weights(spark, sf):
    """Integer factor weights from a class-balanced logistic model on the factor flags."""
    rows, names = flag_rows(spark, sf)
    return fl.rescale_weights(ln.factor_coefficients(stored(rows), names), "coef").select("factor", "weight", rnd("coef", 4).alias("coef"))


@query("flag_model")
def flag_model(spark, sf):
    """A model whose features are the factor flags."""
    rows, names = flag_rows(spark, sf)
    rows = stored(rows.withColumn("label", F.col("won").cast("double")))
    start = F.lit("1999-06-01").cast("timestamp_ntz")
    fitted = ln.logistic(names, binary=True).fit(rows.where(F.col("ts") < start))
    got = ln.probabilities(fitted.transform(rows.where(F.col("ts") >= start)), ["p_loss", "p_win"])
    return rounded(got, ["contest_id", "won", "odds"], ["p_win"], 4)


@query("rating_logit")
def rating_logit(spark, sf):
    """Baseline: logistic on three chances with mean imputation, by log loss per fold."""
    rows = learn_rows(spark, sf)
    holed = rows.withColumn("base_p_draw", F.when(F.col("contest_id") % 10 != 0, F.col("base_p_draw")))
    filled = [f"i_{c}" for c in BASE]

    def model(train):
        pipe = ln.logistic(filled)
        return pipe.setStages([Imputer(strategy="mean", inputCols=BASE, outputCols=filled), *pipe.getStages()])
    got = ln.walk_forward(holed, FOLDS, model)
    parts = [mx.loss_metrics(got.where(F.col("fold") == i)).withColumn("fold", F.lit(i)) for i in range(len(FOLDS))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["fold", "n"], ["log_loss", "brier"], 5)


_STORE = " UNION ALL ".join(f"SELECT contest_id, '{s}' AS side, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 0 ELSE 1 END AS fold, {score_sql(s)} AS score, {score_sql(s, STRUCTURE)} AS part, (target = '{s}')::INT AS won FROM d2" for s in ("home", "away"))


@query("factor_store", f"WITH {mt.MATRIX_SQL}, d2 AS (SELECT contest_id, ts, target, " + ", ".join(
    f"coalesce({c}, {x}) AS {c}" for c, x in ru.DEFAULTS.items()) + f" FROM matrix), a AS ({_STORE}) SELECT contest_id, side, fold, score, part, won FROM a")
def factor_store(spark, sf):
    """One row per (contest, side) written by fold and read back."""
    from touchline.sources.tables import write_features
    from touchline.streaming.streams import work_folder
    m = ru.with_defaults(mt.contest_matrix(spark, sf))
    fold = F.when(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"), 0).otherwise(1)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), ru.score(s).alias("score"), ru.score(s, STRUCTURE).alias("part"), ru.active_factors(s).alias("active"), (F.col("target") == s).cast("int").alias("won")) for s in ("home", "away")])
    rows = m.select("contest_id", fold.alias("fold"), F.explode(sides).alias("v")).select("contest_id", "fold", "v.*")
    path = work_folder(spark, "factor-store")
    write_features(rows, path, ["fold"])
    return spark.read.parquet(path).select("contest_id", "side", F.col("fold").cast("int").alias("fold"), "score", "part", "won")


def _variant(name: str, part: str) -> str:
    return f"SELECT '{name}' AS variant, side, count(*) AS n, {sql_rnd('avg(points)')} AS points, {sql_rnd('corr(points, pts)')} AS r FROM (WITH {v.LOG_SQL}, x AS ({_FORM}{_W.format(p=part, n=5)}) SELECT x.*, l.pts FROM x JOIN log l ON l.contest_id = x.contest_id AND l.team = x.team) GROUP BY side"


@query("form_variants", f"{_variant('all', 'team')} UNION ALL {_variant('same_pool', 'team, pool')}")
def form_variants(spark, sf):
    """Form over all contests against form inside one pool, by how well it goes with the points won."""
    log = v.team_log(spark, sf)
    hot = v.hot_teams(spark, sf)
    parts = [fm.form(log, 5, within, hot if not within else (None if hot else [])).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("points")).alias("points"), rnd(F.corr("points", "pts")).alias("r")).withColumn("variant", F.lit(name))
        for name, within in (("all", []), ("same_pool", ["pool"]))]
    return parts[0].unionByName(parts[1])


@query("goal_model")
def goal_model(spark, sf):
    """Goal-model chances of every contest from factors fitted on earlier ones."""
    games = stored(v.contests(spark, sf).select("contest_id", "ts", "home_id", "away_id", "home_score", "away_score"))
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    train = games.where(F.col("ts") < start)
    params, home = ln.goal_strengths(train)
    rho = ln.best_rho(ln.goal_means(train, params, home))
    test = ln.goal_means(games.where(F.col("ts") >= start), params, home)
    return rounded(rt.goal_grid(test, "lam", "mu", rho), ["contest_id"], ["lam", "mu", "p_home", "p_draw", "p_away"], 4)


@query("agreement_runner")
def agreement_runner(spark, sf):
    """Walk-forward picks that need the feature model and the goal model to agree on the side."""
    games = stored(v.contests(spark, sf, ["score", "rating"]))
    rows = stored(ln.with_label(games.withColumn("result", F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") == F.col("away_score"), "D").otherwise("A"))
                             .withColumn("gap", F.col("home_rating") - F.col("away_rating"))))
    folds = [("2000-01-01", "2000-10-01"), ("2000-10-01", "2001-09-01")]
    model = ln.walk_forward(rows, folds, lambda train: ln.logistic(["gap", "home_rating", "away_rating"]))
    parts = []
    for start, end in folds:  # the goal model is fitted anew on what lies before each fold
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
        train = games.where(F.col("ts") < lo)
        params, home = ln.goal_strengths(train)
        rho = ln.best_rho(ln.goal_means(train, params, home))
        parts.append(rt.goal_grid(ln.goal_means(rows.where((F.col("ts") >= lo) & (F.col("ts") < hi)), params, home), "lam", "mu", rho))
    other = reduce(DataFrame.unionByName, parts)
    both = ln.base_columns({"m": model, "g": other})
    joint = ln.weighted_average(both, {"m": 0.5, "g": 0.5}).where("agree = 2")
    return rounded(joint, ["contest_id", "agree"], ln.PROBS, 4)
