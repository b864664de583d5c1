"""Hit-rate blocks, breakdowns, lifts, effect sizes, inventories and classification metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import wilson
from touchline.operators.prefix import quantiles, running, same, value_block


def hit_aggs(won: str = "won", odds: str = "odds") -> list[Column]:
    """Additive parts of a hit-rate block; partial sums combine map-side."""
    return [F.count(F.lit(1)).alias("n"), F.sum(won).cast("long").alias("wins"), F.sum(odds).alias("sum_odds"),
            F.sum(F.col(won) * F.col(odds)).alias("payout")]


def hit_rates(parts: DataFrame) -> DataFrame:
    """Win rate, average price, mean unit return and expected value from the additive parts."""
    n = F.col("n")
    wr, avg = F.col("wins") / n, F.col("sum_odds") / n
    return (parts.withColumn("win_rate", wr).withColumn("avg_odds", avg)
            .withColumn("roi", (F.col("payout") - n) / n).withColumn("ev", wr * avg - 1.0).drop("sum_odds", "payout"))


def hit_block(df: DataFrame, by: list[str] = (), min_n: int = 0) -> DataFrame:
    parts = df.groupBy(*by).agg(*hit_aggs()).where(F.col("n") >= min_n)
    return hit_rates(parts).withColumn("lower", wilson("wins", "n")).withColumn("upper", wilson("wins", "n", upper=True))


def breakdown(df: DataFrame, dims: list[str], min_n: int = 0) -> DataFrame:
    """Every single dimension and the grand total in one pass of grouping sets."""
    sets = [[F.col(d)] for d in dims] + [[]]
    parts = df.groupingSets(sets, *dims).agg(F.grouping_id(*[F.col(d) for d in dims]).cast("int").alias("level"), *hit_aggs())
    return hit_rates(parts.where(F.col("n") >= min_n))


def settled_roi(ledger: DataFrame, by: list[str]) -> DataFrame:
    done = ledger.where(F.col("result").isNotNull() & F.col("stake").isNotNull())
    return done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("result") == "win").cast("double")).alias("win_rate"),
        (F.sum("pnl") / F.sum("stake")).alias("roi"), F.avg("odds").alias("avg_odds"), F.avg("clv").alias("avg_clv"), F.sum("pnl").alias("profit"))


def target_encode(train: DataFrame, key: str, classes: list[str], label: str, by: list[str] = (), weight: float = 50.0) -> DataFrame:
    """Smoothed class rates per key, pulled toward the global rate of its fold. A NULL key row holds the global rate."""
    parts = train.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(label) == c).cast("long")).alias(f"n_{c}") for c in classes])
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row per key: a small table
    out = parts.select("*", F.sum("n").over(whole).alias("_n"), *[F.sum(f"n_{c}").over(whole).alias(f"_n_{c}") for c in classes])
    w = F.col("n") / (F.col("n") + F.lit(weight))
    return out.select(*by, key, "n", *[(w * F.col(f"n_{c}") / F.col("n") + (1 - w) * F.col(f"_n_{c}") / F.col("_n")).alias(f"rate_{c}") for c in classes],
                      *[(F.col(f"_n_{c}") / F.col("_n")).alias(f"global_{c}") for c in classes])


def long_features(df: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row per (ids, feature) with a present value."""
    return df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(ids, names, "feature", "value").where(F.col("value").isNotNull())


def effect_size(df: DataFrame, group: str, names: list[str], min_n: int = 2) -> DataFrame:
    """Cohen's d per feature between group = 1 and group = 0, pooled sample variance."""
    def part(g: int):
        v = F.when(F.col(group) == g, F.col("value"))
        return F.count(v).alias(f"n{g}"), F.avg(v).alias(f"mean{g}"), F.var_samp(v).alias(f"var{g}")
    agg = long_features(df, [group], names).groupBy("feature").agg(*part(1), *part(0)).where((F.col("n1") >= min_n) & (F.col("n0") >= min_n))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n1") + F.col("n0") - 2))
    return agg.select("feature", "n1", "n0", "mean1", "mean0", F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / pooled).alias("d"))


def inventory(df: DataFrame, names: list[str]) -> DataFrame:
    """Count, minimum, quartiles and maximum of every column."""
    long = long_features(df.withColumn("_one", F.lit(1)), ["_one"], names)
    ends = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(quantiles(long, ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "feature")


def position_of_median(df: DataFrame, group: Column, names: list[str]) -> DataFrame:
    """Per feature: median of the group, and the share of the whole population at or below it."""
    long = long_features(df.withColumn("_g", group), ["_g"], names)
    mid = quantiles(long.where("_g"), ["feature"], "value", {"group_median": 0.5})
    return (long.join(mid, "feature").groupBy("feature")
            .agg(F.max("group_median").alias("group_median"), F.avg((F.col("value") <= F.col("group_median")).cast("double")).alias("position")))


def quartile_contrast(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Win rate and mean return in the lowest and highest quarter of a value."""
    cuts = quantiles(df, by, value, {"q25": 0.25, "q75": 0.75})
    rows = same(df, cuts, by)
    unit = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(F.lit(-1.0))
    low, high = F.col(value) <= F.col("q25"), F.col(value) >= F.col("q75")
    return rows.groupBy(*by).agg(*[fn.alias(f"{tag}_{n}") for tag, cond in (("low", low), ("high", high)) for n, fn in (
        ("n", F.count(F.when(cond, 1))), ("win_rate", F.avg(F.when(cond, F.col("won").cast("double")))), ("roi", F.avg(F.when(cond, unit))))])


def factor_lift(df: DataFrame, factors: str = "active", min_n: int = 1) -> DataFrame:
    """Win rate, lift over the baseline and return with each factor; rate difference with against without.

    Rows are first counted by factor set, so the explode works on sets, not on rows.
    """
    sets = df.groupBy(factors).agg(*hit_aggs())
    names = F.array_append(F.array_distinct(F.col(factors)), F.lit("(all)"))
    per = (sets.select(F.explode(names).alias("factor"), "n", "wins", "sum_odds", "payout").groupBy("factor")
           .agg(*[F.sum(c).alias(c) for c in ("n", "wins", "sum_odds", "payout")]))
    one = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per factor name
    whole = {c: F.max(F.when(F.col("factor") == "(all)", F.col(c))).over(one) for c in ("n", "wins")}
    out = per.select("*", whole["n"].alias("all_n"), whole["wins"].alias("all_wins")).where("factor <> '(all)'").where(F.col("n") >= min_n)
    rate = F.col("wins") / F.col("n")
    without = (F.col("all_wins") - F.col("wins")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    return out.select("factor", "n", rate.alias("win_rate"), (rate / (F.col("all_wins") / F.col("all_n")) - 1).alias("lift"),
                      ((F.col("payout") - F.col("n")) / F.col("n")).alias("roi"), (rate - without).alias("difference"))


def factor_pairs(df: DataFrame, factors: str = "active", min_n: int = 4, min_share: float = 0.05) -> DataFrame:
    """Two-factor combinations that occur at least max(min_n, share of rows) times."""
    sets = df.groupBy(factors).agg(*hit_aggs()).withColumn("_f", F.array_sort(F.array_distinct(F.col(factors))))
    pairs = F.flatten(F.transform("_f", lambda a: F.transform(F.filter("_f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    total = F.struct(F.lit("(all)").alias("a"), F.lit("(all)").alias("b"))
    per = (sets.select(F.explode(F.array_append(pairs, total)).alias("p"), "n", "wins", "sum_odds", "payout").groupBy("p.a", "p.b")
           .agg(*[F.sum(c).alias(c) for c in ("n", "wins", "sum_odds", "payout")]))
    one = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per factor pair
    out = per.withColumn("all_n", F.max(F.when(F.col("a") == "(all)", F.col("n"))).over(one)).where("a <> '(all)'")
    floor = F.greatest(F.lit(float(min_n)), F.col("all_n") * min_share)
    return hit_rates(out.where(F.col("n") >= floor)).drop("all_n")


def class_rows(scored: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per (contest, class) with its chance `p` and truth `y`."""
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(p).alias("p"), (F.col("result") == c).cast("int").alias("y"))
                                  for c, p in (("H", "p_home"), ("D", "p_draw"), ("A", "p_away"))])).alias("v")
    return scored.select(*keep, classes).select(*keep, "v.*")


def loss_metrics(scored: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Mean log loss and three-class Brier score."""
    p = F.when(F.col("result") == "H", F.col("p_home")).when(F.col("result") == "D", F.col("p_draw")).otherwise(F.col("p_away"))
    brier = sum((F.col(c) - (F.col("result") == r).cast("double")) ** 2 for r, c in (("H", "p_home"), ("D", "p_draw"), ("A", "p_away")))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.greatest(p, F.lit(eps)))).alias("log_loss"), F.avg(brier).alias("brier"))


def ranking_metrics(rows: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """Exact AUC and average precision per key, from counts of equal scores and running totals."""
    at = rows.groupBy(*by, score).agg(F.sum(label).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    at = at.withColumn("neg", F.col("n") - F.col("pos")).withColumn("_desc", -F.col(score))
    banded, band = value_block(at, by, "_desc")
    run = running(banded, by, ["_desc"], band,
                  {"tp": ("sum", F.col("pos")), "seen": ("sum", F.col("n")), "fp": ("sum", F.col("neg"))})
    neg_above = F.col("fp") - F.col("neg")
    agg = run.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.col("pos") * (neg_above + F.col("neg") * 0.5)).alias("lost"),
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("precision_sum"))
    return agg.select(*by, F.col("p").alias("positives"),
                      (1 - F.col("lost") / F.nullif(F.col("p").cast("double") * F.col("q"), F.lit(0.0))).alias("auc"),
                      (F.col("precision_sum") / F.nullif(F.col("p"), F.lit(0))).alias("avg_precision"))


def coverage(games: DataFrame, quotes: DataFrame, pool: str = "pool") -> DataFrame:
    """Contests and contests with quotes per pool."""
    have = quotes.groupBy("contest_id").agg(F.lit(1).alias("has"))
    return games.join(have, "contest_id", "left").groupBy(pool).agg(F.count(F.lit(1)).alias("contests"), F.count("has").alias("with_quotes"))


def named_predicates(df: DataFrame, predicates: dict[str, Column], min_n: int = 0) -> DataFrame:
    """Hit-rate block of every named condition in one pass."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in predicates.items()]))
    return hit_block(df.select(F.explode(hits).alias("label"), "won", "odds"), ["label"], min_n)
