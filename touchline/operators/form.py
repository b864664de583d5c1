"""Pre-contest features of each participant, built on the participant log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.history import streaks, trailing

ORDER = ["ts", "contest_id"]

# Neutral defaults when an entity has no history.
FORM_DEFAULTS = {"points": 0.5, "goals_for": 1.3, "goals_against": 1.3, "wins": 0.33, "draws": 0.25, "losses": 0.33}
STAT_DEFAULTS = {"sot_for": 3.5, "sot_against": 3.5, "box_for": 5.0, "box_against": 5.0, "possession": 50.0,
                 "corners": 4.5, "saves": 2.5, "passes_acc": 250.0}
RATE_DEFAULTS = {"conversion": 0.30, "accuracy": 0.35, "box_ratio": 0.50, "save_pct": 0.70, "pass_pct": 0.82}
ADVANCED_DEFAULTS = {"clean_sheet": 0.25, "failed_to_score": 0.2, "both_scored": 0.5, "goals_std": 1.0}


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _fill(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.fillna(defaults)


def form(log: DataFrame, n: int = 5, within: list[str] = (), hot=None) -> DataFrame:
    """Points share, goals and win/draw/loss shares of the last n contests (optionally per pool or side)."""
    feats = {"points": (F.avg(F.col("pts") / 3.0), n, 1), "goals_for": (F.avg("score"), n, 1),
             "goals_against": (F.avg("score_ag"), n, 1), "wins": (_share(F.col("pts") == 3), n, 1),
             "draws": (_share(F.col("pts") == 1), n, 1), "losses": (_share(F.col("pts") == 0), n, 1)}
    wide = trailing(log, ["team", *within], ORDER, feats, hot=hot)
    return _fill(wide, FORM_DEFAULTS)


def advanced_form(log: DataFrame, n: int = 10, hot=None) -> DataFrame:
    """Clean-sheet, blank and both-scored rates, goal spread, and win / loss streaks over the last n."""
    f, a = F.col("score"), F.col("score_ag")
    feats = {"clean_sheet": (_share(a == 0), n, 1), "failed_to_score": (_share(f == 0), n, 1),
             "both_scored": (_share((f > 0) & (a > 0)), n, 1), "goals_std": (F.stddev_samp("score"), n, 1)}
    wide = _fill(trailing(log, ["team"], ORDER, feats, hot=hot), ADVANCED_DEFAULTS)
    return result_streaks(wide, n, hot)


def result_streaks(log: DataFrame, far: int = 20, hot=None) -> DataFrame:
    return streaks(log, ["team"], ORDER, {"win_streak": F.col("pts") == 3, "loss_streak": F.col("pts") == 0}, far, hot)


def rest_days(log: DataFrame, default: float | None = 7, cap: float | None = 30, hot=None) -> DataFrame:
    """Whole days since the previous contest."""
    wide = trailing(log, ["team"], ORDER, {"_prev": (F.max("ts"), 1, 1)}, hot=hot)
    seconds = F.col("ts").cast("timestamp").cast("long") - F.col("_prev").cast("timestamp").cast("long")
    days = F.floor(seconds / 86400).cast("int")
    if cap is not None:
        days = F.when(days.isNotNull(), F.least(days, F.lit(int(cap))))
    if default is not None:
        days = F.coalesce(days, F.lit(int(default)))
    return wide.withColumn("rest", days).drop("_prev")


def xg_history(log: DataFrame, windows=(5, 10), hot=None) -> DataFrame:
    """Trailing expected goals; contests without them are skipped before the last n are taken."""
    feats = {}
    for n in windows:
        feats[f"xg_for_{n}"] = (F.avg("xg"), n, 1)
        feats[f"xg_against_{n}"] = (F.avg("xg_ag"), n, 1)
    feats["xg_over"] = (F.avg(F.col("score") - F.col("xg")), 10, 1)
    known = F.col("xg").isNotNull() & F.col("xg_ag").isNotNull()
    wide = trailing(log, ["team"], ORDER, feats, counts_if=known, hot=hot)
    out = {"xg_over": F.coalesce("xg_over", F.lit(0.0))}
    for n in windows:
        a, b = F.coalesce(f"xg_for_{n}", F.lit(1.3)), F.coalesce(f"xg_against_{n}", F.lit(1.3))
        out |= {f"xg_for_{n}": a, f"xg_against_{n}": b, f"xg_diff_{n}": a - b,
                f"xg_ratio_{n}": F.when(b > 0, a / b).otherwise(F.lit(1.0))}
    return wide.withColumns(out)


def stat_averages(log: DataFrame, n: int = 5, hot=None) -> DataFrame:
    """Eight match-stat averages over the last n contests that have stats."""
    src = {"sot_for": "sot", "sot_against": "sot_ag", "box_for": "box", "box_against": "box_ag", "possession": "poss",
           "corners": "corners", "saves": "saves", "passes_acc": "pass_acc"}
    known = F.col("sot").isNotNull() & F.col("sot_ag").isNotNull()
    wide = trailing(log, ["team"], ORDER, {f"avg_{k}": (F.avg(c), n, 1) for k, c in src.items()}, counts_if=known, hot=hot)
    return _fill(wide, {f"avg_{k}": v for k, v in STAT_DEFAULTS.items()})


def efficiency(log: DataFrame, n: int = 10, hot=None) -> DataFrame:
    """Means of per-contest ratios over the last n contests with stats; zero denominators are skipped."""
    def ratio(a, b):
        return F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    feats = {"conversion": (ratio("score", "sot"), n, 1), "accuracy": (ratio("sot", "shots"), n, 1),
             "box_ratio": (ratio("box", "shots"), n, 1), "save_pct": (ratio("saves", "sot_ag"), n, 1),
             "pass_pct": (ratio("pass_acc", "pass_tot"), n, 1)}
    known = F.col("sot").isNotNull() & F.col("sot_ag").isNotNull()
    return _fill(trailing(log, ["team"], ORDER, feats, counts_if=known, hot=hot), RATE_DEFAULTS)


def rolling_matrix(log: DataFrame, metrics: list[str], windows=(5, 10), scope: str = "all", hot=None) -> DataFrame:
    """Metric x window trailing means (NULL entries skipped), over all contests or one side's only."""
    keys = ["team"] if scope == "all" else ["team", "side"]
    feats = {f"{m}_{scope}_{n}": (F.avg(m), n, 1) for m in metrics for n in windows}
    return trailing(log, keys, ORDER, feats, hot=_side_hot(hot, scope))


def _side_hot(hot, scope):
    if hot is None or scope == "all":
        return hot
    return [(*k, s) for k in hot for s in ("home", "away")]


def team_state(log: DataFrame, hot=None) -> DataFrame:
    """State vector before each contest: last-10 means, last-5 form, trend, momentum, streaks."""
    n = 10
    acc = F.when(F.col("pass_tot") > 0, F.col("pass_acc") / F.col("pass_tot"))
    feats = {"xg_for_10": (F.avg("xg"), n, 1), "xg_against_10": (F.avg("xg_ag"), n, 1), "ppg_10": (F.avg("pts"), n, 1),
             "form_5": (F.avg("pts"), 5, 1), "_xg5": (F.avg("xg"), 5, 1), "possession_10": (F.avg("poss"), n, 1),
             "sot_10": (F.avg("sot"), n, 1), "pass_acc_10": (F.avg(acc), n, 1), "_rating_5": (F.max("rating"), 5, 5),
             "last_ts": (F.max("ts"), 1, 1)}
    wide = trailing(log, ["team"], ORDER, feats, hot=hot)
    wide = (wide.withColumn("xg_trend", F.col("_xg5") - F.col("xg_for_10"))
            .withColumn("rating_momentum", F.col("rating") - F.col("_rating_5")).drop("_xg5", "_rating_5"))
    return result_streaks(wide, 20, hot)


def side_splits(log: DataFrame, hot=None, block=None) -> DataFrame:
    """Home-only and away-only last-10 means of the team, whichever side it plays today."""
    src = log
    for s in ("home", "away"):
        here = F.col("side") == s
        got = trailing(src, ["team"], ORDER, {f"xg_for_{s}_10": (F.avg("xg"), 10, 1), f"ppg_{s}_10": (F.avg("pts"), 10, 1)},
                       counts_if=here, hot=hot)
        src = got
    return src


def momentum(log: DataFrame, value: str, n: int = 5, hot=None) -> DataFrame:
    """Newest prior value minus the n-th prior; NULL with fewer than n."""
    wide = trailing(log, ["team"], ORDER, {"_new": (F.max(value), 1, 1), "_old": (F.max(value), n, n)}, hot=hot)
    return wide.withColumn(f"{value}_momentum", F.col("_new") - F.col("_old")).drop("_new", "_old")


def head_to_head(games: DataFrame, n: int = 5, hot=()) -> DataFrame:
    """Earlier meetings of the same two, counted from today's home side."""
    pairs = (games.withColumn("_a", F.least("home_id", "away_id")).withColumn("_b", F.greatest("home_id", "away_id"))
             .withColumn("_diff", F.when(F.col("home_id") == F.col("_a"), F.col("home_score") - F.col("away_score"))
                         .otherwise(F.col("away_score") - F.col("home_score"))))
    d = F.col("_diff")
    feats = {"h2h_n": (F.count(F.lit(1)), n, 1), "_a_wins": (_share(d > 0), n, 1), "h2h_draws": (_share(d == 0), n, 1),
             "_b_wins": (_share(d < 0), n, 1), "h2h_goals": (F.avg(F.col("home_score") + F.col("away_score")), n, 1),
             "_last": (F.max(F.signum(d)), 1, 1)}
    hot = None if hot is None else list(hot)
    wide = trailing(pairs, ["_a", "_b"], ORDER, feats, hot=hot)
    home_is_a = F.col("home_id") == F.col("_a")
    return wide.select(*games.columns, F.col("h2h_n").cast("int").alias("h2h_n"),
                       F.when(home_is_a, F.col("_a_wins")).otherwise(F.col("_b_wins")).alias("h2h_home_wins"), "h2h_draws",
                       F.when(home_is_a, F.col("_b_wins")).otherwise(F.col("_a_wins")).alias("h2h_away_wins"), "h2h_goals",
                       F.when(home_is_a, F.col("_last")).otherwise(-F.col("_last")).cast("int").alias("h2h_last"))


def pair_deltas(games: DataFrame, names: list[str]) -> DataFrame:
    """home_x - away_x for every named feature."""
    return games.select("*", *[(F.col(f"home_{n}") - F.col(f"away_{n}")).alias(f"delta_{n}") for n in names])


def to_contest(log: DataFrame, names: list[str]) -> DataFrame:
    """Two side rows back to one contest row with home_ / away_ columns."""
    return log.groupBy("contest_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s}_{n}") for n in names for s in ("home", "away")])


def absences(games: DataFrame, reports: DataFrame) -> DataFrame:
    """Absent players per side, their difference and any-flags. reports(contest_id, team).

    Both sides' counts are joined by contest alone, the team is tested on the pairs: the games, which may be wide, stay where one shuffle by contest has put them.
    """
    counts = reports.groupBy("contest_id", "team").agg(F.count(F.lit(1)).alias("n"))
    out = games
    for s in ("home", "away"):
        of = counts.select(F.col("contest_id").alias("_contest"), F.col("team").alias("_team"), F.col("n").alias(f"{s}_absent"))
        # not written as team = side, which would be a second join key
        out = out.join(of, (F.col("contest_id") == F.col("_contest")) & F.array_contains(F.array(f"{s}_id"), F.col("_team")), "left").drop("_contest", "_team")
    out = out.fillna(0, ["home_absent", "away_absent"])
    return out.select("*", (F.col("home_absent") - F.col("away_absent")).alias("absent_diff"),
                      (F.col("home_absent") > 0).cast("int").alias("home_any_absent"),
                      (F.col("away_absent") > 0).cast("int").alias("away_any_absent"))


def share_of_total(players: DataFrame, group: list[str], member: str, value: str) -> DataFrame:
    """Each member's share of its group's total (0 when the total is 0)."""
    per = players.groupBy(*group, member).agg(F.sum(value).alias("amount"))
    total = per.groupBy(*group).agg(F.sum("amount").alias("total"))
    return per.join(total, group).withColumn(
        "share", F.when(F.col("total") > 0, F.col("amount") / F.col("total")).otherwise(F.lit(0.0)))


def missing_share(reports: DataFrame, shares: DataFrame, member: str) -> DataFrame:
    """Sum of absent members' shares per (contest, side); unknown members add nothing."""
    return (reports.join(shares.select(member, "share"), member, "left")
            .groupBy("contest_id").pivot("side", ["home", "away"])
            .agg(F.sum(F.coalesce("share", F.lit(0.0))))
            .select("contest_id", F.coalesce("home", F.lit(0.0)).alias("home_missing"),
                    F.coalesce("away", F.lit(0.0)).alias("away_missing")))


def gated_strength(rosters: DataFrame, at_least: int, listed: Column | None = None) -> DataFrame:
    """Strength only where enough starters are listed (size of `starters`, or a given count); the difference needs both sides."""
    gate = F.when((F.size("starters") if listed is None else listed) >= at_least, F.col("strength"))
    return rosters.groupBy("contest_id").agg(
        F.max(F.when(F.col("side") == "home", gate)).alias("home_strength"),
        F.max(F.when(F.col("side") == "away", gate)).alias("away_strength")).withColumn(
        "strength_diff", F.col("home_strength") - F.col("away_strength"))


def interactions(m: DataFrame) -> DataFrame:
    """Composite columns of a contest matrix; any missing part gives NULL."""
    return m.select(
        "*", (F.col("rating_gap") * F.col("xg_diff_gap")).alias("dominance"),
        ((F.col("home_xg_for_10") - F.col("away_xg_against_10")) - (F.col("away_xg_for_10") - F.col("home_xg_against_10"))).alias("quality_gap"),
        (F.signum("form_gap") + F.signum("xg_trend_gap") + F.signum("momentum_gap")).cast("int").alias("alignment"),
        (F.col("home_ppg_home_10") - F.col("prior_home_wr") * 3.0).alias("home_edge"),
        (F.col("away_win_streak") * F.col("away_xg_trend")).alias("away_hotness"))

