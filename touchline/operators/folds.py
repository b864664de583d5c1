"""Time folds: expanding, reverse dated, by row count, and chronological halves."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.prefix import day_block, running, same
from touchline.operators.scan import BLOCK, row_blocks


def chronological_halves(df: DataFrame, by: list[str], order: list[str], fraction: float = 0.5) -> DataFrame:
    """half = 1 for the first floor(n * fraction) rows of a key in order, else 2. Rows with NULL keys are a group of their own."""
    run = running(df, by, order, day_block(order[0]), {"_rn": ("count", F.lit(1))})
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    return same(run, total, by).withColumn("half", F.when(F.col("_rn") <= F.floor(F.col("_total") * fraction), 1).otherwise(2)).drop("_rn", "_total")


def months_between(start: Column, ts: Column) -> Column:
    return (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start)


def expanding_folds(df: DataFrame, ts: str, train_months: int = 12, test_months: int = 3, step_months: int = 3,
                    roles: tuple[str, ...] = ("train", "test"), ends: tuple | None = None) -> DataFrame:
    """One row per (row, fold, role): fold k trains on months before train + k * step and tests on the next ones.

    A row's folds follow from its month by arithmetic, so rows are exploded, not range-joined. The calendar
    span is one aggregated row.
    """
    a, z = ends or df.agg(F.min(ts).alias("a"), F.max(ts).alias("z")).first()
    if a is None:
        return df.withColumn("fold", F.lit(0)).withColumn("role", F.lit("test")).limit(0)
    last = ((z.year - a.year) * 12 + z.month - a.month - train_months) // step_months
    m = (F.year(ts) * 12 + F.month(ts)) - F.lit(a.year * 12 + a.month)
    empty = F.array().cast("array<int>")
    out = []
    if "train" in roles:
        first = F.greatest(F.floor((m - train_months) / step_months) + 1, F.lit(0)).cast("int")
        folds = F.when(first <= last, F.sequence(first, F.lit(last))).otherwise(empty)
        out.append(df.select("*", F.explode(folds).alias("fold"), F.lit("train").alias("role")))
    if "test" in roles:
        low = F.greatest(F.ceil((m - train_months - test_months + 1) / step_months), F.lit(0)).cast("int")
        high = F.least(F.floor((m - train_months) / step_months), F.lit(last)).cast("int")
        folds = F.when(low <= high, F.sequence(low, high)).otherwise(empty)
        out.append(df.select("*", F.explode(folds).alias("fold"), F.lit("test").alias("role")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def spread_months(cube: DataFrame, month: str, span: DataFrame, train_months: int, test_months: int, step_months: int) -> DataFrame:
    """Month-level aggregates to expanding folds and roles; `span` is a cheap projection giving the calendar span."""
    ends = span.agg(F.min(month).alias(month), F.max(month).alias("_z")).first()
    return expanding_folds(cube, month, train_months, test_months, step_months, ends=(ends[month], ends["_z"]))


def reverse_folds(df: DataFrame, ts: str, n_folds: int = 12, val_months: int = 2, gap_days: int = 10, min_train_months: int = 18,
                  min_val: int = 30, min_train: int = 300) -> DataFrame:
    """Train and validation counts of folds counted back from the newest row; thin or young folds are left out."""
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("z")).first()
    a, z = (F.lit(span[k].isoformat()).cast("timestamp_ntz") for k in ("a", "z"))
    end = z + F.make_dt_interval(days=F.lit(1))
    days = df.groupBy(F.col(ts)).agg(F.count(F.lit(1)).alias("_n"))
    counts = []
    for back in range(n_folds, 0, -1):
        lo = end - F.make_ym_interval(months=F.lit(val_months * back))
        hi = end - F.make_ym_interval(months=F.lit(val_months * (back - 1)))
        train_to = lo - F.make_dt_interval(days=F.lit(gap_days))
        old_enough = F.max(train_to > a + F.make_ym_interval(months=F.lit(min_train_months)))
        counts.append(F.struct(F.lit(back).alias("back"), F.sum(F.when(F.col(ts) < train_to, F.col("_n"))).alias("n_train"),
                               F.sum(F.when((F.col(ts) >= lo) & (F.col(ts) < hi), F.col("_n"))).alias("n_val"), old_enough.alias("ok")))
    rows = days.agg(F.array(*counts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    kept = rows.where(F.col("ok") & (F.col("n_val") >= min_val) & (F.col("n_train") >= min_train))
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("back").desc()))  # at most n_folds rows
    return kept.select(number.alias("fold"), "n_train", "n_val")


def row_count_steps(df: DataFrame, order: list[str], train: int, step: int, offset: int = 0) -> DataFrame:
    """Rows after the first `train` (+ offset) in global order, numbered in steps of `step` rows."""
    run = running(row_blocks(df.withColumn("_all", F.lit(0)), ["_all"], *order), ["_all"], order, F.col(BLOCK), {"_rn": ("count", F.lit(1))}).drop(BLOCK)
    first = train + offset
    return run.where(F.col("_rn") > first).withColumn("step", F.floor((F.col("_rn") - 1 - first) / step).cast("int")).drop("_rn", "_all")


def rescale_weights(coefs: DataFrame, coef: str, top: int = 20) -> DataFrame:
    """Integer weight 1..top by ratio to the largest coefficient; 0 for coefficients up to 0. A small table."""
    peak = F.max(coef).over(W.partitionBy(F.lit(0)))
    scaled = F.greatest(F.lit(1), F.floor(F.col(coef) / peak * top + 0.5)).cast("int")
    return coefs.withColumn("weight", F.when(F.col(coef) <= 0, 0).otherwise(scaled))
