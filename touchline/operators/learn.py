"""Models on Spark ML: walk-forward predictions, stacking, trees, importance, ablation and the goal model."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.metrics import loss_metrics
from touchline.operators.prefix import quantiles
from touchline.session import cut, cut_placed, stored

CLASSES = ("H", "D", "A")
PROBS = ["p_home", "p_draw", "p_away"]


def with_label(df: DataFrame) -> DataFrame:
    """label 0 / 1 / 2 for H / D / A."""
    return df.withColumn("label", F.when(F.col("result") == "H", 0.0).when(F.col("result") == "D", 1.0).otherwise(2.0))


def logistic(features: list[str], n_train: int | None = None, weight: str | None = None, binary: bool = False) -> Pipeline:
    """Standardised L2 logistic model; small training sets are regularised more."""
    reg = 0.01 if n_train is None else 0.1 if n_train < 500 else 0.02 if n_train < 2000 else 0.01
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=reg, maxIter=60, family="binomial" if binary else "multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep"),
                            StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True), lr])


def forest(features: list[str], trees: int = 20, depth: int = 5, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="scaled", handleInvalid="keep"),
                            RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)])


def probabilities(df: DataFrame, names: list[str] = PROBS) -> DataFrame:
    arr = vector_to_array("probability")
    return df.select(*[c for c in df.columns if c not in {"probability", "rawPrediction", "prediction", "raw_features", "scaled", *names}],
                     *[arr[i].alias(n) for i, n in enumerate(names)])


def boosted(train: DataFrame, test: DataFrame, features: list[str], rounds: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """Gradient-boosted trees per class, early-stopped on the newest fifth, chances renormalised."""
    assembler = VectorAssembler(inputCols=features, outputCol="scaled", handleInvalid="keep")
    timed = train.withColumn("_t", F.col("ts").cast("timestamp").cast("double")).withColumn("_all", F.lit(0))
    cutoff = quantiles(timed.select("_all", "_t"), ["_all"], "_t", {"c": 0.8}).first()["c"]
    fit_rows = cut(assembler.transform(timed.withColumn("hold", F.col("_t") > cutoff)).select("scaled", "label", "hold"))
    out = assembler.transform(test)
    for i, name in enumerate(PROBS):
        gbt = GBTClassifier(featuresCol="scaled", labelCol="is_class", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="hold", stepSize=0.1)
        model = gbt.fit(fit_rows.withColumn("is_class", (F.col("label") == i).cast("double")))
        out = model.transform(out).withColumn(f"_b_{name}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    total = sum(F.col(f"_b_{n}") for n in PROBS)
    return out.select(*[c for c in test.columns if c not in PROBS], *[(F.col(f"_b_{n}") / total).alias(n) for n in PROBS])


def walk_forward(df: DataFrame, folds: list[tuple[str, str]], model: Callable[[DataFrame], Estimator], names: list[str] = PROBS,
                 encode: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, min_train: int = 30) -> DataFrame:
    """Out-of-fold chances: for each (from, to) a model from `model` is fitted on rows before `from` and
    applied to rows in [from, to). `encode` may add features fitted on the training rows. Any Spark ML estimator fits.
    """
    out = []
    for i, (start, end) in enumerate(folds):
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
        train, test = df.where(F.col("ts") < lo), df.where((F.col("ts") >= lo) & (F.col("ts") < hi))
        if encode is not None:
            train, test = encode(train, test)
        if train.limit(min_train).count() < min_train:
            continue
        fitted = model(train).fit(train)
        out.append(probabilities(fitted.transform(test), names).withColumn("fold", F.lit(i)))
    if not out:  # every fold was too thin
        return df.select("*", *[F.lit(None).cast("double").alias(n) for n in names], F.lit(None).cast("int").alias("fold")).limit(0)
    return reduce(DataFrame.unionByName, out)


def covered(all_rows: DataFrame, oof: DataFrame) -> DataFrame:
    """Every row; those in no fold get 1/3 each."""
    got = oof.select("contest_id", "fold", *[F.col(p).alias(f"o_{p}") for p in PROBS])
    rows = all_rows.drop(*PROBS).join(got, "contest_id", "left")
    return rows.select(*[c for c in rows.columns if not c.startswith("o_")], *[F.coalesce(f"o_{p}", F.lit(1 / 3)).alias(p) for p in PROBS])


def base_columns(models: dict[str, DataFrame]) -> DataFrame:
    """One row per contest with every model's chances side by side."""
    out = None
    for name, df in models.items():
        part = df.select("contest_id", *[F.col(p).alias(f"{name}_{p}") for p in PROBS])
        out = part if out is None else out.join(part, "contest_id")
    return out


def weighted_average(bases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the models, renormalised, with how many agree on the likeliest class."""
    mixed = {p: sum(F.col(f"{m}_{p}") * w for m, w in weights.items()) for p in PROBS}
    total = mixed["p_home"] + mixed["p_draw"] + mixed["p_away"]
    top = {m: F.when((F.col(f"{m}_p_home") >= F.col(f"{m}_p_draw")) & (F.col(f"{m}_p_home") >= F.col(f"{m}_p_away")), "H")
           .when(F.col(f"{m}_p_draw") >= F.col(f"{m}_p_away"), "D").otherwise("A") for m in weights}
    counts = [sum((t == c).cast("int") for t in top.values()) for c in CLASSES]
    return bases.select("*", *[(c / total).alias(p) for p, c in mixed.items()], F.greatest(*counts).alias("agree"))


def platt(scored: DataFrame, score: str, label: str, order: str = "ts", tail: float = 0.2) -> DataFrame:
    """Logistic calibration of a score: fitted on the last but one `tail` of time, applied to the rows after it, so no row is scored by a fit on itself."""
    timed = scored.withColumn("_t", F.col(order).cast("timestamp").cast("double")).withColumn("_all", F.lit(0)).withColumn("label", F.col(label).cast("double"))
    rows = timed.join(quantiles(timed.select("_all", "_t"), ["_all"], "_t", {"_c": 1 - tail, "_from": 1 - 2 * tail}), "_all")
    assembler = VectorAssembler(inputCols=[score], outputCol="scaled")
    model = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=50).fit(assembler.transform(rows.where("_t >= _from AND _t < _c")))
    got = model.transform(assembler.transform(rows.where("_t >= _c")))
    return got.select(*scored.columns, vector_to_array("probability")[1].alias("calibrated"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Row weights n / (classes * class count); the class table has a handful of rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return df.join(counts, label).withColumn("weight", F.lit(total["t"] / total["k"]) / F.col("_n")).drop("_n")


def factor_coefficients(flags: DataFrame, names: list[str]) -> DataFrame:
    """Coefficients of a class-balanced logistic model on 0/1 factors."""
    rows = balanced_weights(flags.withColumn("label", F.col("won").cast("double")))
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=0.001, maxIter=60, standardization=False)
    model = lr.fit(VectorAssembler(inputCols=names, outputCol="scaled").transform(rows))
    return flags.sparkSession.createDataFrame([(n, float(c)) for n, c in zip(names, model.coefficients)], "factor string, coef double")


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], model: Callable[[list[str], DataFrame], Estimator]) -> DataFrame:
    """Log loss and Brier score with all features and without each group. A short list of refits."""
    every = sorted({f for fs in groups.values() for f in fs})
    rows = []
    for name, gone in {"(all)": [], **groups}.items():
        keep = [f for f in every if f not in gone]
        fitted = model(keep, train).fit(train)
        rows.append(loss_metrics(probabilities(fitted.transform(test))).select(F.lit(name).alias("without"), F.lit(len(keep)).alias("features"), "n", "log_loss", "brier"))
    return reduce(DataFrame.unionByName, rows)


def tree_importance(train: DataFrame, features: list[str], groups: dict[str, str] | None = None) -> DataFrame:
    fitted = forest(features).fit(train)
    vals = fitted.stages[-1].featureImportances
    rows = [(f, (groups or {}).get(f, "other"), float(vals[i])) for i, f in enumerate(features)]
    return train.sparkSession.createDataFrame(rows, "feature string, grp string, importance double")


def permutation_importance(test: DataFrame, features: list[str], fitted, seed: int = 11) -> DataFrame:
    """Rise of the log loss when one feature is replaced by that of another row.

    The other row is found by a keyed join on shuffled row numbers within blocks: no global sort, no collect.
    """
    plain = loss_metrics(probabilities(fitted.transform(test))).select(F.col("log_loss").alias("base"), F.lit(1).alias("one"))
    n_blocks = max(8, test.count() // 50_000)
    keyed = test.withColumn("_b", F.pmod(F.xxhash64("contest_id", F.lit(seed)), F.lit(n_blocks)))
    numbered = keyed.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy("contest_id"))).withColumn(
        "_j", F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64("contest_id", F.lit(seed + 1)), "contest_id")))
    numbered = cut(numbered)
    rows = []
    for f in features:
        donor = numbered.select("_b", F.col("_j").alias("_i"), F.col(f).alias("_new"))
        mixed = numbered.join(donor, ["_b", "_i"]).withColumn(f, F.col("_new")).drop("_new", "_b", "_i", "_j")
        rows.append(loss_metrics(probabilities(fitted.transform(mixed))).select(F.lit(f).alias("feature"), "log_loss", F.lit(1).alias("one")))
    return reduce(DataFrame.unionByName, rows).join(plain, "one").select("feature", (F.col("log_loss") - F.col("base")).alias("rise"))


# ---- goal model ------------------------------------------------------------------------------------------------------

#: Pairs of a cell and teams of a block: a task of a round holds about so many.
CELL_ROWS, BLOCK_TEAMS = 500_000, 500_000


def _doubles(x: np.ndarray) -> bytes:
    return np.asarray(x, "<f8").tobytes()


def _packed_cell(pairs: pd.DataFrame, teams: pd.DataFrame) -> pd.DataFrame:
    """One row of a cell: its pairs as places in the two blocks' teams, and their weights."""
    if not len(pairs):
        return pd.DataFrame(columns=["cell", "home", "away", "w"])
    of = {at_home: x for at_home, x in zip(teams["at_home"], teams["teams"])}
    home, away = (pd.Index(of[at_home]).get_indexer(pairs[c]).astype("<i4") for at_home, c in ((True, "home_id"), (False, "away_id")))
    return pd.DataFrame({"cell": pairs["cell"][:1], "home": [home.tobytes()], "away": [away.tobytes()], "w": [_doubles(pairs["w"])]})


def _weighted_sums(sides: int):
    """The step on one cell: the sums of weight times the partners' value, for the teams of its home block and of its away block."""
    def sums(cells: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        of = {at_home: np.frombuffer(x, "<f8") for at_home, x in zip(values["at_home"], values["value"])}
        for cell, home, away, w in zip(cells["cell"], cells["home"], cells["away"], cells["w"]):
            home, away, w = np.frombuffer(home, "<i4"), np.frombuffer(away, "<i4"), np.frombuffer(w, "<f8")
            out.append((cell // sides, True, _doubles(np.bincount(home, w * of[False][away], len(of[True])))))
            out.append((cell % sides, False, _doubles(np.bincount(away, w * of[True][home], len(of[False])))))
        return pd.DataFrame(out, columns=["block", "at_home", "sums"])

    return sums


def _to_cells(blocks: DataFrame, sides: int, *cols: str) -> DataFrame:
    """The columns of every block for each cell that has its teams at home (block * sides + other) or away (other * sides + block)."""
    spread = blocks.select("block", *cols, F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("_o")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("at_home"))
    cell = F.when(F.col("at_home"), F.col("block") * sides + F.col("_o")).otherwise(F.col("_o") * sides + F.col("block"))
    return spread.select(cell.cast("long").alias("cell"), "at_home", *cols)


def _pair_sums(pairs: DataFrame, sides: int, values: DataFrame) -> DataFrame:
    """(block, at_home, sums): parts of the sums over partners' values of every team of a block, at home and away, from values(block, value).

    The pairs lie by cell and stay there, a row each. A block's values go to the cells of its teams, and as many arrays of sums come back.
    """
    return pairs.groupBy("cell").cogroup(_to_cells(values, sides, "value").groupBy("cell")).applyInPandas(_weighted_sums(sides), "block long, at_home boolean, sums binary")


def _added(parts: pd.DataFrame, at_home: bool, n: int) -> np.ndarray:
    """The parts of one side added up, in the order of their bytes, so that a repeated task gives the same sums."""
    return sum((np.frombuffer(x, "<f8") for x in sorted(parts["sums"][parts["at_home"] == at_home])), np.zeros(n))


def _by_block(blocks: DataFrame, parts: DataFrame, step: Callable[[dict, pd.DataFrame], dict], schema: str) -> DataFrame:
    """step(block, its parts) for every block; a block is a dict of arrays."""
    def run(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = [step(_arrays(r), parts) for r in own.to_dict("records")]
        return pd.DataFrame([{k: _doubles(x) if isinstance(x, np.ndarray) else x for k, x in r.items()} for r in rows], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(run, schema)


def _arrays(row: dict) -> dict:
    return {k: np.frombuffer(x, "<f8") if isinstance(x, (bytes, bytearray)) else x for k, x in row.items()}


def goal_strengths(games: DataFrame, half_scale_days: float = 365.0, tolerance: float = 1e-4, rounds: int = 200, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, float]:
    """Attack and defence factors per team and the home factor of a time-weighted Poisson goal model.

    Goals of i against j have mean attack_i * defence_j (* home). The likelihood equations are solved by fitting the
    margins in turn: each round is two sums over (home, away) totals, a table that is aggregated
    once. There is no design matrix, so the number of teams is not limited. Rounds go on until no factor moves by more than `tolerance`
    (attack is scaled to mean one, as only its product with defence counts); not reaching it within `rounds` is an error.
    The totals are cut into cells, blocks of teams by blocks of opponents, and packed by cell once, a row of arrays each; a round moves only factors and sums, an array
    a block and cell. What a side's partners sum up to is the same table read by rows and by columns, so a contest is stored once.
    Factors are stored as tables, whose size Spark knows: behind a checkpoint its estimate would be the product of all rounds' sizes, a number of twice as many digits in each.
    The home factor needs no sum of its own: it follows from those that the next attack factors are taken from.
    """
    known = games.agg(F.max("ts").alias("t"), F.count(F.lit(1)).alias("n")).first()
    days = (F.lit(known["t"].isoformat()).cast("timestamp_ntz").cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")) / 86400
    w = F.exp(-F.floor(days) / F.lit(half_scale_days))
    rows = games.where("home_id IS NOT NULL AND away_id IS NOT NULL").select(w.alias("w"), "home_id", "away_id", "home_score", "away_score")
    both = F.explode(F.array(*[F.struct(F.col(f"{me}_id").alias("team"), F.col(f"{me}_score").alias("scored"), F.col(f"{you}_score").alias("conceded"))
                               for me, you in (("home", "away"), ("away", "home"))])).alias("v")
    goals = cut(rows.select("w", both).select("w", "v.*").groupBy("team").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("scored", "conceded")]))
    at_home = rows.agg(F.sum(F.col("w") * F.col("home_score")).alias("g")).first()["g"]
    n_teams, kind = goals.count(), goals.schema["team"].dataType
    sides = max(math.ceil(math.sqrt(known["n"] / cell_rows)), math.ceil(n_teams / BLOCK_TEAMS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    state = "scored binary, conceded binary, attack binary, defence binary, moved double"

    def gathered(own: pd.DataFrame) -> pd.DataFrame:
        own, ones = own.sort_values("team"), _doubles(np.ones(len(own)))
        return pd.DataFrame({"block": own["block"][:1], "teams": [own["team"].to_numpy()], "scored": [_doubles(own["scored"])], "conceded": [_doubles(own["conceded"])],
                             "attack": [ones], "defence": [ones], "moved": [np.nan]})

    blocks = cut(goals.withColumn("block", block("team")).groupBy("block").applyInPandas(gathered, f"block long, teams array<{kind.simpleString()}>, {state}"))
    placed = rows.select("w", F.col("home_id").cast(kind), F.col("away_id").cast(kind)).withColumn("cell", block("home_id") * sides + block("away_id")).repartition(sides * sides, "cell")
    totals = placed.groupBy("cell", "home_id", "away_id").agg(F.sum("w").alias("w"))
    packed = totals.groupBy("cell").cogroup(_to_cells(blocks, sides, "teams").groupBy("cell")).applyInPandas(_packed_cell, "cell long, home binary, away binary, w binary")
    pairs = cut_placed(packed.repartition(sides * sides, "cell"))
    params, home = blocks.drop("teams"), 1.1

    def summed(own, parts):
        sums = {s: _added(parts, at, len(own["attack"])) for s, at in (("s0", False), ("s1", True))}
        return {**own, **sums, "fit": float((own["attack"] * sums["s1"]).sum())}

    def attack(own, mean):  # fmax: a team without any known score counts like one without goals
        return np.fmax(own["scored"] / (own["s0"] + own["s1"] * home), 1e-3) / mean

    for done in range(rounds + 1):
        against = stored(_by_block(params, _pair_sums(pairs, sides, params.select("block", F.col("defence").alias("value"))), summed, f"block long, {state}, s0 binary, s1 binary, fit double"))
        if done:
            got = against.agg(F.sum("fit").alias("fit"), F.max("moved").alias("moved")).first()
            old, home = home, at_home / got["fit"]
            if max(got["moved"] or 0.0, abs(home - old)) < tolerance:
                break

        def shares(batches):
            for b in batches:
                yield pd.DataFrame({"s": [float(attack(_arrays(r), 1.0).sum()) for r in b.to_dict("records")]})

        def scaled(batches, mean):
            for b in batches:
                yield pd.DataFrame({"block": b["block"], "value": [_doubles(attack(_arrays(r), mean)) for r in b.to_dict("records")]})

        def refreshed(own, parts, mean):
            new, n = attack(own, mean), len(own["attack"])
            # away at an opponent is at home for the opponent: the sides change places
            defence = np.fmax(own["conceded"] / (_added(parts, True, n) + _added(parts, False, n) * home), 1e-3)
            moved = max(np.abs(new - own["attack"]).max(), np.abs(defence - own["defence"]).max())
            return {"block": own["block"], "scored": own["scored"], "conceded": own["conceded"], "attack": new, "defence": defence, "moved": float(moved)}

        mean = against.mapInPandas(shares, "s double").agg(F.sum("s").alias("s")).first()["s"] / n_teams
        value = against.mapInPandas(lambda bs, m=mean: scaled(bs, m), "block long, value binary")
        params = stored(_by_block(against, _pair_sums(pairs, sides, value), lambda own, parts, m=mean: refreshed(own, parts, m), f"block long, {state}"))
    else:
        raise RuntimeError(f"the goal model still moves after {rounds} rounds")

    def rows_of(batches):
        for b in batches:
            for teams, a, d in zip(b["teams"], b["attack"], b["defence"]):
                yield pd.DataFrame({"team": teams, "attack": np.frombuffer(a, "<f8"), "defence": np.frombuffer(d, "<f8")})

    found = blocks.select("block", "teams").join(params.select("block", "attack", "defence"), "block")
    return found.mapInPandas(rows_of, f"team {kind.simpleString()}, attack double, defence double"), float(home)


def goal_means(games: DataFrame, params: DataFrame, home: float) -> DataFrame:
    """Expected goals of both sides; unknown teams count as average."""
    out = games
    for s in ("home", "away"):
        out = out.join(params.select(F.col("team").alias(f"{s}_id"), F.col("attack").alias(f"_{s}_a"), F.col("defence").alias(f"_{s}_d")), f"{s}_id", "left")
    out = out.fillna(1.0, ["_home_a", "_home_d", "_away_a", "_away_d"])
    return out.withColumn("lam", F.col("_home_a") * F.col("_away_d") * F.lit(home)).withColumn("mu", F.col("_away_a") * F.col("_home_d")).drop("_home_a", "_home_d", "_away_a", "_away_d")


def best_rho(rows: DataFrame, low: float = -0.5, high: float = 0.5, steps: int = 20, digits: int = 4) -> float:
    """Low-score correction with the highest likelihood: a grid over the whole range, refined around its best point to so many digits; one aggregation a level."""
    lam, mu, h, a = F.col("lam"), F.col("mu"), F.col("home_score"), F.col("away_score")

    def corr(r: float):
        c = (F.when((h == 0) & (a == 0), 1 - lam * mu * r).when((h == 0) & (a == 1), 1 + lam * r).when((h == 1) & (a == 0), 1 + mu * r).when((h == 1) & (a == 1), F.lit(1.0 - r)))
        return F.sum(F.log(F.greatest(c, F.lit(1e-10))))
    few = cut(rows.where((h <= 1) & (a <= 1)).select("lam", "mu", "home_score", "away_score"))
    while True:
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        got = few.agg(*[F.coalesce(corr(r), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(grid)]).first()
        best = max(range(len(grid)), key=lambda i: (got[i], -abs(grid[i])))
        if grid[1] - grid[0] < 10 ** -digits:
            return round(grid[best], digits)
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, steps)]
