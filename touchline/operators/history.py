"""Leak-free trailing features of an entity's own log, and as-of attachment of states.

Every frame ends strictly before the current row. A hot entity (say a third of all rows) is cut into
calendar blocks; each block borrows the few last rows of the entity before it, so the result is
the same and no task holds a whole hot entity.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.prefix import day_block, month_block, running

HOT_ROWS = "touchline.hot.rows"
HOT_ROWS_DEFAULT = "4000000"


def hot_limit(spark) -> int:
    return int(spark.conf.get(HOT_ROWS, HOT_ROWS_DEFAULT))


def hot_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """Keys with more rows than one task should hold; at most total rows / limit of them."""
    limit = hot_limit(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return [tuple(row[k] for k in keys) for row in counts.select(*keys).collect()]


def _is_hot(keys: list[str], hot: list[tuple]) -> Column:
    if len(keys) == 1:
        return F.col(keys[0]).isin([k[0] for k in hot])
    tests = [reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, key)]) for key in hot]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _with_halo(df: DataFrame, keys: list[str], order: list[str], depth: int, block: Column,
               hot: list[tuple], counts_if: Column) -> DataFrame:
    """Give each block of a hot key the last `depth` counted rows before it, flagged `_halo`."""
    flagged = df.withColumn("_hot", _is_hot(keys, hot))
    flagged = flagged.withColumn("_blk", F.when(F.col("_hot"), block).otherwise(F.lit(0)))
    rows = flagged.where("_hot")
    newest = W.partitionBy(*keys, "_blk").orderBy(*[F.col(c).desc() for c in order])
    tails = (rows.where(counts_if).withColumn("_back", F.row_number().over(newest))
             .where(F.col("_back") <= depth).drop("_back"))
    tails = tails.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_blk", *order)))
    per_block = tails.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_tail"))
    blocks = rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    prior = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    needs = (blocks.join(per_block, [*keys, "_blk"], "left")
             .withColumn("_upto", F.coalesce(F.sum("_tail").over(prior), F.lit(0)))
             .where("_upto > 0")
             .select(*keys, F.col("_blk").alias("_to"),
                     F.explode(F.sequence(F.greatest(F.col("_upto") - depth + 1, F.lit(1)), F.col("_upto"))).alias("_k")))
    halo = tails.join(needs, [*keys, "_k"]).withColumn("_blk", F.col("_to")).drop("_to", "_k")
    return (flagged.withColumn("_halo", F.lit(False))
            .unionByName(halo.select(*flagged.columns, F.lit(True).alias("_halo"))))


def trailing(df: DataFrame, keys: list[str], order: list[str], feats: dict[str, tuple[Column, int, int]],
             counts_if: Column | None = None, hot: list[tuple] | None = None,
             block: Column | None = None, number: bool = False) -> DataFrame:
    """Add trailing features: name -> (aggregate, from, to), row offsets counted back from the current row.

    (agg, 5, 1) looks at the five rows before the current one. With `counts_if`, only rows meeting it
    enter the history ("skip first, then take the last n"); other rows still receive the features.
    `hot` lists the keys to split (None: find them with one counting job). With `number`, aggregates may use
    `_rn`, a row number that rises by one from row to row of an entity.
    """
    hot = hot_keys(df, keys) if hot is None else hot
    depth = max(far for _, far, _ in feats.values())
    part, src = list(keys), df
    if hot:
        block = month_block(order[0]) if block is None else block
        src = _with_halo(df, keys, order, depth, block, hot, F.lit(True) if counts_if is None else counts_if)
        part = [*keys, "_blk"]
    if number:
        src = src.withColumn("_rn", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
    if counts_if is None:
        w = W.partitionBy(*part).orderBy(*order)
        out = src.withColumns({name: agg.over(w.rowsBetween(-far, -near)) for name, (agg, far, near) in feats.items()})
    else:
        # State after each counted row, then the latest such state before the current row.
        src = src.withColumn("_in", F.coalesce(counts_if, F.lit(False)))
        own = W.partitionBy(*part, "_in").orderBy(*order)
        packed = F.when(F.col("_in"), F.struct(*[agg.over(own.rowsBetween(1 - far, 1 - near)).alias(name)
                                                 for name, (agg, far, near) in feats.items()]))
        before = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        out = src.withColumn("_state", packed).withColumn("_state", F.last("_state", ignorenulls=True).over(before))
        out = out.withColumns({name: F.col(f"_state.{name}") for name in feats})
    if hot:
        out = out.where(~F.col("_halo"))
    return out.drop("_rn", "_in", "_state", "_hot", "_blk", "_halo")


def run_length(flag: Column, far: int) -> tuple[Column, int, int]:
    """Rows since the last row (within `far`) where `flag` fails; use with `streak`."""
    return F.max(F.when(~flag, F.col("_rn"))), far, 1


def streaks(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column], far: int,
            hot: list[tuple] | None = None) -> DataFrame:
    """Length of the unbroken run of each flag ending at the previous row, bounded by `far` rows."""
    feats = {"_seen": (F.count(F.lit(1)), far, 1), "_last": (F.max("_rn"), 1, 1)}
    for name, flag in flags.items():
        feats[f"_break_{name}"] = run_length(flag, far)
    wide = trailing(df, keys, order, feats, hot=hot, number=True)
    runs = {n: F.coalesce(F.least(F.col("_seen"), F.col("_last") - F.coalesce(F.col(f"_break_{n}"), F.lit(-1 << 40))),
                          F.lit(0)).cast("int") for n in flags}
    return wide.withColumns(runs).drop("_seen", "_last", *[f"_break_{n}" for n in flags])


def asof_attach(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str],
                block: Column | None = None) -> DataFrame:
    """Attach to each left row the latest right row of the key with a strictly earlier `ts`.

    Union, then a two-level running `last`: no range join, and hot keys spread over daily blocks.
    Rows with equal `ts` on the right are ordered by `tie`.
    """
    extra = [c for c in left.columns if c not in {*keys, ts}]
    l = left.select(*keys, ts, F.lit(0).alias("_side"), F.monotonically_increasing_id().alias("_tie"),
                    F.struct(*[F.col(c) for c in extra]).alias("_left"),
                    F.lit(None).cast(right.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("_right"))
    l_type = l.schema["_left"].dataType
    r = right.select(*keys, ts, F.lit(1).alias("_side"), F.col(tie).cast("long").alias("_tie"),
                     F.lit(None).cast(l_type).alias("_left"), F.struct(*cols).alias("_right"))
    both = running(l.unionByName(r), keys, [ts, "_side", "_tie"],
                   day_block(ts) if block is None else block, {"_right": ("last", F.col("_right"))})
    return both.where("_side = 0").select(*keys, ts, "_left.*", *[F.col(f"_right.{c}").alias(c) for c in cols])


def as_of_date(log: DataFrame, keys: list[str], ts: str, tie: str, cutoff, cols: list[str]) -> DataFrame:
    """Each entity's latest row before a cutoff (aggregated map-side)."""
    old = log.where(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    got = old.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_s"),
                                 F.count(F.lit(1)).alias("n_before"), F.max(ts).alias("last_ts"))
    return got.select(*keys, "_s.*", "n_before", "last_ts")
