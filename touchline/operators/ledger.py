"""Ledger operators: equity curves, drawdown, re-staking, settlement, re-pricing, line value and reports."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import closing_line_value, expected_value, kelly_fraction, profit, settle
from touchline.operators.fold import ordered_fold
from touchline.operators.prefix import day_block, running
from touchline.operators.scan import BLOCK, log_curve, row_blocks

ORDER = ["ts", "id"]

# Stake cap and re-pricing limit, line-value health limits, opening balance.
STAKE_CAP = 0.10
MIN_LIVE_EV = 0.0
WARNING_CLV = -0.02
MIN_CLV_ROWS = 5
CLV_DAYS = 30
START = 1000.0


def with_kelly(ledger: DataFrame, fraction: float = 0.25, cap: float = 0.04) -> DataFrame:
    return ledger.withColumn("fraction", F.least(kelly_fraction("prob", "odds", fraction), F.lit(cap)))


def _gain() -> Column:
    return F.when(F.col("result") == "win", F.col("fraction") * (F.col("odds") - 1)).otherwise(-F.col("fraction"))


def compound_equity(ledger: DataFrame, by: list[str], start: float = START) -> DataFrame:
    """Unrounded compounding over settled rows: balance, peak and drawdown after each.

    Balances are kept as logarithms (ln_balance, ln_peak): a running sum that splits into blocks and
    does not overflow on long ledgers.
    """
    return log_curve(ledger.where(F.col("result").isNotNull()), by, ORDER, _gain(), start)


def flat_equity(ledger: DataFrame, by: list[str], start: float = 0.0) -> DataFrame:
    """Running sum of one-unit profits over settled rows."""
    done = ledger.where(F.col("result").isNotNull())
    unit = F.when(F.col("result") == "win", F.col("odds") - 1).otherwise(F.lit(-1.0))
    run = running(row_blocks(done.withColumn("unit", unit), by, *ORDER), by, ORDER, F.col(BLOCK), {"_sum": ("sum", F.col("unit"))})
    return run.withColumn("balance", F.lit(start) + F.col("_sum")).drop("_sum", BLOCK)


def weekly(curve: DataFrame, by: list[str], value: str = "unit") -> DataFrame:
    """Week totals, and per key the weekly Sharpe ratio mean / std * sqrt(52)."""
    week = curve.groupBy(*by, F.date_trunc("week", F.col("ts")).alias("week")).agg(F.sum(value).alias("pnl"), F.count(F.lit(1)).alias("n"))
    return week.groupBy(*by).agg(F.count(F.lit(1)).alias("weeks"), F.avg("n").alias("per_week"),
                                 (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * math.sqrt(52)).alias("sharpe"))


def summary(curve: DataFrame, by: list[str], start: float = START) -> DataFrame:
    return curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("result") == "win").cast("double")).alias("win_rate"), F.avg("odds").alias("avg_odds"),
        F.max_by("ln_balance", F.struct(*ORDER)).alias("ln_final"), F.min("drawdown").alias("max_drawdown"),
        (F.max_by("ln_balance", F.struct(*ORDER)) - F.lit(math.log(start))).alias("ln_growth"))


def months_dense(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Every calendar month between a key's first and last row, zero where it has none."""
    month = F.trunc(F.col("ts").cast("date"), "month")
    got = df.groupBy(*by, month.alias("month")).agg(*[c.alias(n) for n, c in aggs.items()])
    span = got.groupBy(*by).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return span.join(got, [*by, "month"], "left").select(*by, "month", *[F.coalesce(n, F.lit(0)).alias(n) for n in aggs])


def monthly_balance(ledger: DataFrame, by: list[str], oos_from: str, start: float = START) -> DataFrame:
    """Monthly flat profit, fraction-staked growth, both cumulative, flagged in or out of sample."""
    done = ledger.where(F.col("result").isNotNull())
    won = F.col("result") == "win"
    dense = months_dense(done, by, {
        "n": F.count(F.lit(1)), "flat": F.sum(F.when(won, F.col("odds") - 1).otherwise(F.lit(-1.0))),
        "ln_growth": F.sum(F.log1p(_gain()))})
    upto = W.partitionBy(*by).orderBy("month").rowsBetween(W.unboundedPreceding, 0)  # one row per month
    return dense.select(*by, "month", "n", "flat", F.sum("flat").over(upto).alias("flat_total"),
                        (F.lit(math.log(start)) + F.sum("ln_growth").over(upto)).alias("ln_balance"),
                        (F.col("month") >= F.lit(oos_from).cast("date")).alias("oos"))


def month_pivot(df: DataFrame, by: list[str], months: list[str], value: str = "unit") -> DataFrame:
    """One column pair (n, pnl) per listed month, and one pair `other` for all rows outside of them."""
    m = F.date_format("ts", "yyyy-MM")
    tagged = df.withColumn("m", F.when(m.isin(months), m).otherwise("other"))
    return tagged.groupBy(*by).pivot("m", [*months, "other"]).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("pnl"))


def closed_form_growth(block: DataFrame, fraction: float = 0.25, cap: float = 0.04) -> DataFrame:
    """Growth ((1 + f b)^win_rate * (1 - f)^(1 - win_rate))^n of a hit-rate block."""
    f = F.least(kelly_fraction("win_rate", "avg_odds", fraction), F.lit(cap))
    grow = F.col("n") * (F.col("win_rate") * F.log1p(f * (F.col("avg_odds") - 1)) + (1 - F.col("win_rate")) * F.log1p(-f))
    return block.withColumn("fraction", f).withColumn("growth", F.exp(grow))


def _round2(x: float) -> float:
    """Half-up cents. A balance beyond the range of doubles becomes infinite, as in SQL; what follows from it is infinite or not a number."""
    cents = x * 100.0 + 0.500001
    return math.floor(cents) / 100.0 if math.isfinite(cents) else cents


RESTAKE_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("stake", T.DoubleType()),
                            T.StructField("pnl", T.DoubleType()), T.StructField("bank_after", T.DoubleType()), T.StructField("graded", T.BooleanType())])
RESTAKE_STATE = T.StructType([T.StructField("bank", T.DoubleType())])


def restake(ledger: DataFrame, by: list[str], start: float = START, cap: float = STAKE_CAP, floor: float | None = None,
            block_rows: int | None = None, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stake every row from the balance before it, rounded to cents; open rows do not move the balance.

    Returns (rows with stake, pnl and bank_after; final balance per key).
    """
    def step(rows: pd.DataFrame, prior: pd.DataFrame):
        bank = float(prior["bank"].iloc[0]) if len(prior) else start
        out = []
        for id_, f, odds, result in zip(rows["id"], rows["fraction"], rows["odds"], rows["result"]):
            put = _round2(min(bank * f, bank * cap))
            pnl = None
            if result == "win":
                pnl = _round2(put * (odds - 1.0))
            elif result == "loss":
                pnl = -put
            if pnl is not None:
                bank = _round2(bank + pnl)
                bank = bank if floor is None else max(bank, floor)
            out.append((id_, put, pnl, bank, pnl is not None))
        return pd.DataFrame(out, columns=RESTAKE_OUT.names), pd.DataFrame({"bank": [bank]})

    live = ledger.where(F.col("fraction") > 0).select(*by, *ORDER, "fraction", "odds", "result")
    rows, final = ordered_fold(live, by, ORDER, step, RESTAKE_OUT, RESTAKE_STATE, block_rows, at_most=at_most)
    # pandas gives "not a number" back as NULL; only the profit of an open row is NULL
    number = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    return (rows.select(*by, "id", number("stake"), F.when(F.col("graded"), F.coalesce("pnl", F.lit(float("nan")))).alias("pnl"), number("bank_after")),
            final.select(*by, number("bank")))


def rebalance_open(ledger: DataFrame, balances: DataFrame, by: list[str], cap: float = STAKE_CAP) -> DataFrame:
    """New stakes for open rows only, from the current balance of their strategy."""
    cents = F.least(F.col("bank") * F.col("fraction"), F.col("bank") * cap) * 100.0 + 0.500001
    put = F.when(cents < float(1 << 53), F.floor(cents)).otherwise(cents) / 100.0  # F.floor gives a long, which large and infinite balances exceed
    return ledger.where(F.col("result").isNull() & (F.col("fraction") > 0)).join(balances, by).withColumn("stake", put)


def settle_open(ledger: DataFrame, finished: DataFrame) -> DataFrame:
    """Grade open rows whose contest has finished; settled rows are left alone."""
    rows = ledger.where(F.col("result").isNull()).join(finished, "contest_id")
    graded = rows.withColumn("result", settle("market", "pick", "home_score", "away_score")).where(F.col("result").isNotNull())
    return graded.withColumn("pnl", profit("result", "stake", "odds"))


def reprice(ledger: DataFrame, latest: DataFrame, today: str, ahead: int = 7) -> DataFrame:
    """Open rows of the coming days at the newest price: dropped when EV falls below the limit, else final or early."""
    day = F.col("match_ts").cast("date")
    now = F.lit(today).cast("date")
    open_ = ledger.where(F.col("result").isNull() & day.between(now, F.date_add(now, ahead)))
    rows = open_.join(latest.select("contest_id", F.col("outcome").alias("pick"), "price"), ["contest_id", "pick"], "left")
    ev = F.coalesce(expected_value("prob", "price"), expected_value("prob", "odds"))
    return rows.withColumn("ev", ev).withColumn("is_active", F.col("ev") >= MIN_LIVE_EV).withColumn(
        "timing", F.when(~F.col("is_active"), F.lit(None)).when(day == now, "final").otherwise("early"))


def attach_clv(ledger: DataFrame, closing: DataFrame) -> DataFrame:
    """Closing-line value against the reference source's closing price; NULL where it has none."""
    rows = ledger.join(closing.select("contest_id", F.col("outcome").alias("pick"), F.col("price").alias("closing")), ["contest_id", "pick"], "left")
    return rows.withColumn("clv", closing_line_value("prob", "closing"))


def classify_clv(avg: Column) -> Column:
    return F.when(avg >= 0, "healthy").when(avg >= WARNING_CLV, "warning").otherwise("alert")


def clv_health(ledger: DataFrame, by: list[str], as_of: str, games: DataFrame | None = None, days: int = CLV_DAYS) -> DataFrame:
    """Rolling-window line value per strategy; the contest's time, else the row's own date, places a row."""
    rows = ledger.where(F.col("clv").isNotNull())
    when = F.col("ts")
    if games is not None:
        rows = rows.join(games.select("contest_id", F.col("ts").alias("contest_ts")), "contest_id", "left")
        when = F.coalesce("contest_ts", "ts")
    recent = rows.where(when >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
    got = recent.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("clv").alias("avg_clv"), F.avg((F.col("clv") > 0).cast("double")).alias("positive"))
    return got.where(F.col("n") >= MIN_CLV_ROWS).withColumn("status", classify_clv(F.col("avg_clv")))


def clv_transitions(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Days on which a strategy's daily line-value status enters or leaves 'alert'."""
    daily = (ledger.where(F.col("clv").isNotNull()).groupBy(*by, F.col("ts").cast("date").alias("day"))
             .agg(F.avg("clv").alias("avg_clv"), F.count(F.lit(1)).alias("n")).withColumn("status", classify_clv(F.col("avg_clv"))))
    run = running(daily, by, ["day"], day_block("day"), {"was": ("last", F.col("status"))}, inclusive=False)
    crossed = ((F.col("status") == "alert") & (F.coalesce("was", F.lit("")) != "alert")) | ((F.col("status") != "alert") & (F.col("was") == "alert"))
    return run.where(crossed).withColumn("event", F.when(F.col("status") == "alert", "alert").otherwise("recovery"))


def last_results(ledger: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """Last k settled results in order as text; the rank filter keeps k rows per key before the shuffle."""
    newest = W.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("id").desc())
    top = ledger.where(F.col("result").isNotNull()).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= k)
    letters = F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.upper(F.substring("result", 1, 1)).alias("x"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(letters, lambda s: s["x"]), "").alias("last"), F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """Keep the k first rows per key after a sort."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def stake_sweep(ledger: DataFrame, by: list[str], caps: list[float], fractions: list[float]) -> DataFrame:
    """Compounded growth (as a logarithm) for every stake cap and Kelly fraction: one sum per setting, so a plain aggregation."""
    settings = F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.lit(s).alias("share")) for c in caps for s in fractions])).alias("s")
    rows = ledger.where(F.col("result").isNotNull()).select(*by, "result", "odds", kelly_fraction("prob", "odds", 1.0).alias("full"), settings)
    f = F.least(F.col("full") * F.col("s.share"), F.col("s.cap"))
    rows = rows.select(*by, "s.*", "result", "odds", f.alias("f")).where("f > 0")
    gain = F.when(F.col("result") == "win", F.col("f") * (F.col("odds") - 1)).otherwise(-F.col("f"))
    return rows.groupBy(*by, "cap", "share").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p(gain)).alias("ln_growth"))
