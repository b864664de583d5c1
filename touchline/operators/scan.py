"""Blocks that follow the data, and associative scans over them: equity, peak, deepest fall, for every start offset at once."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import expected_value, kelly_fraction
from touchline.operators.prefix import day_block, same

BLOCK = "_block"
#: Rows of a block, and the pieces a crowded day or instant is cut into at most.
ROWS, PIECES = 250_000, 1024


def row_blocks(df: DataFrame, keys: list[str], ts: str, tie: str, rows: int = ROWS) -> DataFrame:
    """df with `_block`, which does not decrease along (ts, tie) inside a key and holds at most about 2 * rows rows, however they lie in time.

    Days are counted first. If none has more than `rows` rows they are the blocks. Else neighbouring small days share a block, a crowded day is cut by a mergeable sketch of its
    times, and a crowded instant by one of `tie` (a number), each into up to PIECES pieces of equally many rows. NULL times are the first day. Only counts and
    sketches are shuffled; they are joined to the rows as small tables.
    """
    day = "_day"
    src = df.withColumn(day, day_block(ts))
    days = src.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    if not days.where(F.col("_n") > rows).limit(1).count():
        return src.withColumnRenamed(day, BLOCK)
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a crowded day starts blocks of its own: it and the days after it in the same stretch of rows are told apart by the rows before
    days = days.select(*keys, day, F.floor(before / rows).alias("_a"), "_n", F.when(F.col("_n") > rows, before + 1).otherwise(0).alias("_first"))
    placed = same(src, days, [*keys, day])
    placed = _pieces(placed, [*keys, day], F.unix_micros(F.col(ts).cast("timestamp")), "_b", rows)
    placed = _pieces(placed, [*keys, day, "_b"], F.col(tie).cast("long"), "_c", rows, F.col("_b") % 2 == 0)
    return placed.withColumn(BLOCK, F.struct("_a", "_first", "_b", "_c")).drop(day, "_a", "_first", "_b", "_c", "_n")


def _pieces(df: DataFrame, group: list[str], value: Column, out: str, rows: int, only: Column | None = None) -> DataFrame:
    """Cut groups of more than `rows` rows into pieces by the order of `value`: even pieces hold one value that fills a piece alone, odd ones what lies between. Other
    groups, and those for which `only` does not hold, have the piece 0."""
    crowded = df.where(F.col("_n") > rows).withColumn("_v", value)
    crowded = crowded if only is None else crowded.where(only)
    probs = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    bounds = crowded.groupBy(*group).agg(F.percentile_approx("_v", probs, 20_000).alias("_bounds"), F.count(F.lit(1)).alias("_m"))
    bounds = bounds.where(F.col("_m") > rows).drop("_m")
    joined = same(df.withColumn("_v", value), bounds, group, "left")
    steps = F.array(*[F.lit(PIECES >> i) for i in range(1, PIECES.bit_length())])
    at = F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.element_at("_bounds", a + step) <= F.col("_v"), a + step).otherwise(a))
    piece = F.when(at > 0, at * 2 + (F.col("_v") > F.element_at("_bounds", F.greatest(at, F.lit(1)))).cast("int")).otherwise(1)
    return joined.withColumn(out, F.when(F.col("_bounds").isNotNull() & F.col("_v").isNotNull(), piece).otherwise(0)).drop("_bounds", "_v")


def peak_scan(df: DataFrame, keys: list[str], order: list[str], value: Column, floor: float = 0.0) -> DataFrame:
    """df (with `_block`) with `total` and `peak` after each row: the running sum of `value` and its highest point so far, `floor` at least.

    One shuffle of the rows: inside a block both come from one sort. A block is summed up by its total and its highest point, these are scanned over the blocks of a
    key and joined back.
    """
    rows = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    body = df.withColumn("_s", F.sum(value).over(rows)).withColumn("_p", F.max("_s").over(rows))
    sums = body.groupBy(*keys, BLOCK).agg(F.max_by("_s", F.struct(*order)).alias("_s"), F.max("_p").alias("_p"))
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_from", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
    carried = carried.withColumn("_high", F.greatest(F.max(F.col("_from") + F.col("_p")).over(earlier), F.lit(floor)))
    joined = same(body, carried.select(*keys, BLOCK, "_from", "_high"), [*keys, BLOCK])
    return joined.withColumn("total", F.col("_from") + F.col("_s")).withColumn("peak", F.greatest("_high", F.col("_from") + F.col("_p"))).drop("_from", "_high", "_s", "_p", BLOCK)


def _joined(a: Column, b: Column) -> Column:
    """Two runs after each other. A run is its picks, wins and staked growth, its highest and lowest points from its own start, and its deepest fall from a peak."""
    return F.struct((a["n"] + b["n"]).alias("n"), (a["wins"] + b["wins"]).alias("wins"), (a["total"] + b["total"]).alias("total"),
                    F.greatest(a["high"], a["total"] + b["high"]).alias("high"), F.least(a["low"], a["total"] + b["low"]).alias("low"),
                    F.least(a["fall"], b["fall"], a["total"] + b["low"] - a["high"]).alias("fall"))


def stake_offsets(ledger: DataFrame, by: list[str], caps: list[float], shares: list[float], least_ev: list[float], offsets: int = 10, step: int = 50, rows: int = ROWS) -> DataFrame:
    """Compounded growth of settled rows for every cap, Kelly share, least EV and start offset: `by`, cap, share, min_ev, start, n, wins, ln_growth, max_drawdown.

    Start o leaves out the first o * step settled rows of a key, picked or not, in the order (ts, id). All starts come from one pass: a block of rows gives one run per setting and
    stretch between two starts, runs of blocks are joined in order, and a start joins the stretches from its own to the end. Settings and starts without picks have no row.
    """
    done = ledger.where(F.col("result").isNotNull())
    blocks = row_blocks(done.select(*by, "ts", "id", "odds", (F.col("result") == "win").alias("won"), kelly_fraction("prob", "odds", 1.0).alias("full"),
                                    expected_value("prob", "odds").alias("ev")), by, "ts", "id", rows)
    sizes = blocks.groupBy(*by, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    numbered = sizes.select(*by, BLOCK, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"), F.row_number().over(W.partitionBy(*by).orderBy(BLOCK)).alias("_b"))
    rows_of = same(blocks, numbered, [*by, BLOCK]).drop(BLOCK)
    kinds = ", ".join(f"`{k}` {ledger.schema[k].dataType.simpleString()}" for k in by)
    names = [*by, "block", "cap", "share", "min_ev", "stretch", "n", "wins", "total", "high", "low", "fall"]

    def runs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "id"], kind="stable", na_position="first")
        won, odds, full, ev = (part[c].to_numpy() for c in ("won", "odds", "full", "ev"))
        stretch = np.minimum((part["_first"].iat[0] + np.arange(len(part))) // step, offsets - 1)
        out = []
        for cap in caps:
            for share in shares:
                f = np.minimum(full * share, cap)
                gain = np.log1p(np.where(won, f * (odds - 1), -f))
                for limit in least_ev:
                    picked = (f > 0) & (ev >= limit)
                    for s in np.unique(stretch[picked]):
                        here = picked & (stretch == s)
                        path = np.cumsum(gain[here])
                        peak = np.maximum.accumulate(np.maximum(path, 0.0))
                        out.append((*[part[k].iat[0] for k in by], int(part["_b"].iat[0]), cap, share, limit, int(s), int(here.sum()), int(won[here].sum()), float(path[-1]),
                                    max(float(path.max()), 0.0), min(float(path.min()), 0.0), min(float((path - peak).min()), 0.0)))
        return pd.DataFrame(out, columns=names)

    made = rows_of.groupBy(*by, "_b").applyInPandas(
        runs, f"{kinds}, block int, cap double, share double, min_ev double, stretch int, n long, wins long, total double, high double, low double, fall double")
    setting = [*by, "cap", "share", "min_ev"]
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("wins"), *[F.lit(0.0).alias(c) for c in ("total", "high", "low", "fall")])
    run = F.struct(*[F.col(c) for c in ("n", "wins", "total", "high", "low", "fall")])
    ordered = made.groupBy(*setting, "stretch").agg(F.sort_array(F.collect_list(F.struct("block", run.alias("run")))).alias("runs"))
    stretches = ordered.select(*setting, "stretch", F.aggregate("runs", zero, lambda a, r: _joined(a, r["run"])).alias("run"))
    whole = stretches.groupBy(*setting).agg(F.sort_array(F.collect_list(F.struct("stretch", "run"))).alias("runs"))
    starts = whole.select(*setting, "runs", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("start"))
    got = starts.select(*setting, "start", F.aggregate(F.filter("runs", lambda r: r["stretch"] >= F.col("start")), zero, lambda a, r: _joined(a, r["run"])).alias("run"))
    return got.where("run.n > 0").select(*setting, "start", "run.n", "run.wins", F.col("run.total").alias("ln_growth"), F.expm1("run.fall").alias("max_drawdown"))


def log_curve(df: DataFrame, keys: list[str], order: list[str], gain: Column, start: float) -> DataFrame:
    """ln_balance, ln_peak and drawdown after each row of a compounded ledger."""
    got = peak_scan(row_blocks(df, keys, *order), keys, order, F.log1p(gain))
    base = F.lit(math.log(start))
    return (got.withColumn("ln_balance", base + F.col("total")).withColumn("ln_peak", base + F.col("peak"))
            .withColumn("drawdown", F.expm1(F.col("total") - F.col("peak"))).drop("total", "peak"))
