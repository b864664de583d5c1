"""Operators over multi-source price quotes (contest_id, source, outcome, price, recorded_at, is_closing)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.devig import SIDES
from touchline.operators.prefix import day_block, running

# Reference source and its fallbacks, best first; and the movement gate limits.
REFERENCE_SOURCES = ["Pinnacle", "Bet365", "William Hill", "Bwin", "1xBet", "Unibet"]
GATE = {"drift": 0.05, "velocity": 0.03, "dispersion": 0.10, "min_sources": 2, "min_snapshots": 3}

SERIES = ["contest_id", "outcome", "source"]
TIE = ["recorded_at", "snap_id", "snap_no", "raw"]


def _best(cond: Column | None = None, names=SIDES, suffix: str = "odds") -> list[Column]:
    out = []
    for s in names:
        hit = (F.col("outcome") == s) & (F.col("price") > 1.0)
        out.append(F.max(F.when(hit if cond is None else hit & cond, F.col("price"))).alias(f"{s}_{suffix}"))
    return out


def best_price(q: DataFrame, closing: bool | None = False) -> DataFrame:
    """Best price per outcome over all sources; prices up to 1.0 are ignored."""
    rows = q if closing is None else q.where(F.col("is_closing") == closing)
    return rows.groupBy("contest_id").agg(*_best())


def closing_preferred(q: DataFrame) -> DataFrame:
    """Closing rows where the contest has any, else all rows; all three outcomes must be priced.

    Both variants are aggregated in one pass, so no per-contest window is needed.
    """
    closed = F.col("is_closing")
    both = q.groupBy("contest_id").agg(F.max(closed).alias("has_closing"), *_best(closed, suffix="c"), *_best(suffix="a"))
    pick = [F.when(F.col("has_closing"), F.col(f"{s}_c")).otherwise(F.col(f"{s}_a")).alias(f"{s}_odds") for s in SIDES]
    return both.select("contest_id", "has_closing", *pick).dropna(subset=[f"{s}_odds" for s in SIDES])


def double_chance(q: DataFrame) -> DataFrame:
    """Best price of the two paired outcomes."""
    return q.where(F.col("outcome").isin("1X", "2X")).groupBy("contest_id").agg(
        *[F.max(F.when(F.col("outcome") == o, F.col("price"))).alias(f"dc_{o.lower()}_odds") for o in ("1X", "2X")])


def _series(q: DataFrame, minutes: int, order: list[str]) -> DataFrame:
    """First, last and look-back price per series by map-side aggregation.

    The look-back row is found by joining the series summary to the rows (a skewed join AQE splits).
    """
    at = F.struct(*order)
    series = q.groupBy(*SERIES).agg(
        F.min_by(F.struct("price", "opening"), at).alias("first"), F.max_by(F.struct("price", "recorded_at"), at).alias("last"),
        F.max(at).alias("last_at"), F.count(F.lit(1)).alias("snaps"))
    back = F.col("recorded_at") <= F.col("last.recorded_at") - F.make_dt_interval(mins=F.lit(minutes))
    earlier = (q.join(series.select(*SERIES, "last", "last_at"), SERIES).where(back & (at < F.col("last_at")))
               .groupBy(*SERIES).agg(F.max_by("price", at).alias("before")))
    return series.join(earlier, SERIES, "left").select(*SERIES, "snaps", "before", F.col("last.price").alias("latest"),
                                                       F.coalesce(F.nullif(F.col("first.opening"), F.lit(0.0)), F.col("first.price")).alias("base"))


def line_movement(q: DataFrame, minutes: int = 30, order: list[str] = TIE) -> DataFrame:
    """Drift, velocity, dispersion, source and snapshot counts per (contest, outcome).

    First one row per (contest, outcome, source), then medians over the sources of a contest.
    """
    series = _series(q, minutes, order)
    latest, base, before = F.col("latest"), F.col("base"), F.col("before")
    per = series.where("base > 0").select(*SERIES, "snaps", "latest", ((latest - base) / base).alias("d"), F.when(before > 0, (latest - before) / base).alias("v"))
    got = per.groupBy("contest_id", "outcome").agg(
        F.median("d").alias("drift"), F.median("v").alias("velocity"), F.stddev_pop("latest").alias("sd"),
        F.avg("latest").alias("mean"), F.count("latest").cast("int").alias("n_sources"), F.max("snaps").cast("int").alias("n_snaps"))
    spread = F.when((F.col("n_sources") >= 2) & (F.col("mean") > 0), F.col("sd") / F.col("mean"))
    return got.select("contest_id", "outcome", "drift", "velocity", spread.alias("dispersion"), "n_sources", "n_snaps")


def movement_gate(moves: DataFrame, on: bool = True, limits: dict = GATE) -> DataFrame:
    """Skip reason per (contest, outcome) or NULL; sparse series, draws and a closed gate never skip."""
    snaps = moves.groupBy("contest_id").agg(F.max("n_snaps").alias("n_snapshots"))
    wide = moves.join(snaps, "contest_id")
    live = F.lit(on) & (F.col("outcome") != "draw") & (F.col("n_snapshots") >= limits["min_snapshots"])
    reason = (F.when(~live, F.lit(None)).when(F.col("drift") > limits["drift"], "drift")
              .when(F.col("velocity") > limits["velocity"], "velocity")
              .when((F.col("n_sources") >= limits["min_sources"]) & (F.col("dispersion") > limits["dispersion"]), "dispersion"))
    return wide.withColumn("reason", reason).withColumn("skip", F.col("reason").isNotNull())


def opening_carry(q: DataFrame, order: list[str] = TIE) -> DataFrame:
    """Opening price of each snapshot: lowest earlier opening, else its own, else the price itself."""
    earlier = running(q, ["contest_id", "outcome"], order, day_block(order[0]), {"_min": ("min", F.col("opening"))}, inclusive=False)
    return earlier.withColumn("opening_carried", F.coalesce("_min", "opening", "price")).drop("_min")


def latest_quote(q: DataFrame, order: list[str] = TIE) -> DataFrame:
    """Newest open (not closing) price per (contest, outcome)."""
    return q.where(~F.col("is_closing")).groupBy("contest_id", "outcome").agg(
        F.max_by("price", F.struct(*order)).alias("price"), F.max("recorded_at").alias("recorded_at"))


def reference_source(q: DataFrame, priority: list, order: list[str] = TIE) -> DataFrame:
    """Quotes of one source per contest: the best-ranked listed source present, else the first seen."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])
    rank = F.coalesce(ranks[F.col("source")], F.lit(len(priority)))
    first = F.when(rank == len(priority), F.struct(*order))
    chosen = q.groupBy("contest_id").agg(F.min(F.struct(rank.alias("rank"), first.alias("at"), F.col("source"))).alias("m"))
    return q.join(chosen.select("contest_id", F.col("m.source").alias("source")), ["contest_id", "source"], "left_semi")


def source_counts(q: DataFrame) -> DataFrame:
    """Distinct sources and snapshot counts per contest (two-step distinct, spread by source)."""
    per = q.groupBy("contest_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("contest_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_quotes"), F.max("n").alias("most_from_one"))


def model_vs_market(scored: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Per-row log loss of model and market, their means, and how often the model is better."""
    def loss(prefix: str) -> Column:
        p = F.when(F.col("result") == "H", F.col(f"{prefix}home")).when(F.col("result") == "D", F.col(f"{prefix}draw")).otherwise(F.col(f"{prefix}away"))
        return -F.log(F.greatest(p, F.lit(eps)))
    rows = scored.select(loss("p_").alias("model"), loss("mkt_p_").alias("market"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("model").alias("model_loss"), F.avg("market").alias("market_loss"),
                    F.avg((F.col("model") < F.col("market")).cast("double")).alias("model_better"))
