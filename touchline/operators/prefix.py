"""Running totals in two levels, so that one hot key never lands in one task.

Rows are grouped by (key, block), a block being a slice of the order (a day, a band of equally many values). Block
totals are aggregated map-side, summed over earlier blocks (a handful of rows per key) and joined
back; the row-level window then runs inside (key, block) only. The same path runs at every size, and NULL keys,
times and values are groups and blocks like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK = "_block"


def month_block(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.year(c) * 12 + F.month(c)


def day_block(ts) -> Column:
    """Day number: blocks of a key stay small as its rows grow; NULL times are a block of their own, before all others."""
    return F.datediff(F.col(ts) if isinstance(ts, str) else ts, F.lit("1970-01-01").cast("date"))


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that pairs NULL keys with NULL keys; the key columns come from the left side."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def _before(order: list[Column]):
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def running(df: DataFrame, keys: list[str], order: list[str], block: Column,
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running aggregates over `keys` ordered by `order` (ascending, unique inside a key).

    aggs maps a new column to (kind, expression), kind being sum, count, min, max, first or last
    (first and last skip NULL). `block` must not decrease along `order` (NULL comes first). With inclusive=False the
    row itself is left out.
    """
    src = df.withColumn(_BLOCK, block)
    cols = [F.col(c) for c in order]
    place = _before(cols)
    parts, carry, inside = [], [], []
    upto = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    rows = (W.partitionBy(*keys, _BLOCK).orderBy(*cols)
            .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    for name, (kind, expr) in aggs.items():
        t, p = f"_t_{name}", f"_p_{name}"
        if kind == "sum":
            parts.append(F.sum(expr).alias(t))
            carry.append(F.coalesce(F.sum(t).over(upto), F.lit(0)).alias(p))
            inside.append(F.sum(expr).over(rows).alias(f"_i_{name}"))
        elif kind == "count":
            parts.append(F.count(expr).alias(t))
            carry.append(F.coalesce(F.sum(t).over(upto), F.lit(0)).alias(p))
            inside.append(F.count(expr).over(rows).alias(f"_i_{name}"))
        elif kind in ("min", "max"):
            fn = F.min if kind == "min" else F.max
            parts.append(fn(expr).alias(t))
            carry.append(fn(t).over(upto).alias(p))
            inside.append(fn(expr).over(rows).alias(f"_i_{name}"))
        else:
            fn, pick = (F.first, F.min_by) if kind == "first" else (F.last, F.max_by)
            parts.append(pick(expr, F.when(expr.isNotNull(), place)).alias(t))
            carry.append(fn(t, ignorenulls=True).over(upto).alias(p))
            inside.append(fn(expr, ignorenulls=True).over(rows).alias(f"_i_{name}"))
    totals = src.groupBy(*keys, _BLOCK).agg(*parts)
    offsets = totals.select(*keys, _BLOCK, *carry)
    body = src.select("*", *inside)
    joined = same(body, offsets, [*keys, _BLOCK])
    final = {}
    for name, (kind, _) in aggs.items():
        here, prior = F.col(f"_i_{name}"), F.col(f"_p_{name}")
        if kind in ("sum", "count"):
            final[name] = F.coalesce(here, F.lit(0)) + prior
        elif kind in ("min", "max"):
            final[name] = (F.least if kind == "min" else F.greatest)(here, prior)
        elif kind == "last":
            final[name] = F.coalesce(here, prior)
        else:
            final[name] = F.coalesce(prior, here)
    keep = [c for c in df.columns if c not in aggs]
    return joined.select(*keep, *[c.alias(n) for n, c in final.items()])


#: Bands per key of value_block, a power of two.
BANDS = 1024


def value_block(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, Column]:
    """Attach per-key quantile bounds of `value` and return the band expression for `running`.

    Bands hold about equally many rows however the values lie, so neither an outlier nor a crowd of near values fills one band. The bounds are a
    mergeable sketch per key; a row finds its band by bisection. NULL values are a band of their own.
    """
    probs = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    bounds = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), probs, 20_000).alias("_bounds"))
    steps = F.array(*[F.lit(BANDS >> i) for i in range(1, BANDS.bit_length())])
    at = F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.element_at("_bounds", a + step) <= F.col(value).cast("double"), a + step).otherwise(a))
    joined = same(df, bounds, keys) if keys else df.crossJoin(bounds)
    return joined, F.when(F.col(value).isNotNull(), at)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key without holding a key's values in one task.

    Equal values are counted first; order statistics are then picked by running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    banded, band = value_block(counts, keys, value)
    placed = running(banded, keys, [value], band, {"_cum": ("sum", F.col("_n"))})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = same(placed, sizes, keys)
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_cum") - F.col("_n") <= at) & (at < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
    got = ranked.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *out)
