"""Isotonic calibration with league > cluster > global heads, and league profiles.

The tail and the fitted blocks are read several times, so both are checkpointed once.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.metrics import class_rows
from touchline.operators.prefix import quantiles, running
from touchline.session import cut

BANDS = 200
BAND_ROWS = 50_000
# Tail share and least rows of a league or cluster head.
TAIL, MIN_LEAGUE, MIN_CLUSTER = 0.15, 30, 50

BLOCK = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lo", "hi", "w", "s")])


def pool_violators(lo, hi, w, s) -> pd.DataFrame:
    """Merge neighbouring blocks until their means rise strictly; input in order of `lo`."""
    out: list[list[float]] = []
    for block in zip(lo, hi, w, s):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1][1] = last[1]
            out[-1][2] += last[2]
            out[-1][3] += last[3]
    return pd.DataFrame(out, columns=["lo", "hi", "w", "s"])


def isotonic_heads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Isotonic fit of y on p per key: blocks (lo, hi, value) with their next block.

    Equal chances are summed first. A head with many distinct chances is cut into chance bands; pooling inside the bands
    and then over the surviving blocks gives the same fit as one pass, so no task holds a whole large head.
    """
    at = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").cast("double").alias("s"))
    sizes = at.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BAND_ROWS).alias("_bands"))
    banded = at.join(sizes, keys).select(*keys, F.floor(F.col("p") * F.col("_bands")).alias("band"), F.col("p").alias("lo"), F.col("p").alias("hi"), "w", "s")
    shape = T.StructType([rows.schema[k] for k in keys] + list(BLOCK))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        got = pool_violators(pdf["lo"], pdf["hi"], pdf["w"], pdf["s"])
        for k in keys:
            got[k] = pdf[k].iloc[0]
        return got[shape.names]

    blocks = banded.groupBy(*keys, "band").applyInPandas(pool, shape).groupBy(*keys).applyInPandas(pool, shape)
    return blocks.select(*keys, "lo", "hi", (F.col("s") / F.col("w")).alias("value"))


def apply_heads(rows: DataFrame, blocks: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Calibrated value per row: constant inside a block, linear between blocks, clipped outside."""
    knots = _with_next(blocks, keys).select(*keys, F.col("from").alias("p"), F.lit(0).alias("_kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ids], F.struct("hi", "value", "next_lo", "next_value").alias("_k"))
    asks = rows.select(*keys, "p", F.lit(1).alias("_kind"), *ids, F.lit(None).cast(knots.schema["_k"].dataType).alias("_k"))
    got = running(knots.unionByName(asks), keys, ["p", "_kind"], F.floor(F.greatest(F.col("p"), F.lit(0.0)) * BANDS), {"k": ("last", F.col("_k"))})
    share = (F.col("p") - F.col("k.hi")) / F.nullif(F.col("k.next_lo") - F.col("k.hi"), F.lit(0.0))
    value = F.when((F.col("p") <= F.col("k.hi")) | F.col("k.next_lo").isNull(), F.col("k.value")).otherwise(
        F.col("k.value") + share * (F.col("k.next_value") - F.col("k.value")))
    return got.where("_kind = 1").select(*keys, *ids, "p", value.alias("calibrated"))


def _with_next(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with their successor; the first reaches down to minus one. Few rows per key after pooling."""
    w = W.partitionBy(*keys).orderBy("lo")
    return blocks.select("*", F.lead("lo").over(w).alias("next_lo"), F.lead("value").over(w).alias("next_value"),
                         F.when(F.row_number().over(w) == 1, F.lit(-1.0)).otherwise(F.col("lo")).alias("from"))


def tail_cut(scored: DataFrame, tail: float) -> DataFrame:
    """Rows at or after the (1 - tail) quantile of time."""
    timed = scored.withColumn("_t", F.col("ts").cast("timestamp").cast("double")).withColumn("_all", F.lit(0))
    return timed.join(quantiles(timed.select("_all", "_t"), ["_all"], "_t", {"_cut": 1.0 - tail}), "_all").where("_t >= _cut").drop("_t", "_all", "_cut")


def calibrate(scored: DataFrame, cluster: str | None = "cluster", tail: float = TAIL, min_league: int = MIN_LEAGUE, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """Calibrated, renormalised chances. Heads are fitted on the newest tail; a row uses its league's head if that has
    enough rows, else its cluster's, else the global one."""
    recent = cut(tail_cut(scored, tail))

    def big_enough(col: str, prefix: str, least: int) -> DataFrame:
        return recent.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(
            col, F.concat(F.lit(prefix), F.col(col)).alias(f"head_{col}"))

    heads = [("league", big_enough("league", "league:", min_league))]
    if cluster:
        heads.append((cluster, big_enough(cluster, "cluster:", min_cluster)))

    def tagged(df: DataFrame) -> DataFrame:
        for col, table in heads:
            df = df.join(table, col, "left")
        return df

    own = [F.col(f"head_{c}") for c, _ in heads]
    train = tagged(recent).withColumn("head", F.explode(F.array_compact(F.array(F.lit("global"), *own))))
    blocks = cut(isotonic_heads(class_rows(train, ["head"]), ["head", "cls"]))
    asks = class_rows(tagged(scored).withColumn("head", F.coalesce(*own, F.lit("global"))), ["contest_id", "head"])
    got = apply_heads(asks, blocks, ["head", "cls"], ["contest_id"])
    wide = got.groupBy("contest_id", "head").agg(*[F.max(F.when(F.col("cls") == c, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)))).alias(n)
                                                   for c, n in (("H", "c_home"), ("D", "c_draw"), ("A", "c_away"))])
    total = F.greatest(F.col("c_home") + F.col("c_draw") + F.col("c_away"), F.lit(1e-9))
    return wide.select("contest_id", "head", *[(F.col(n) / total).alias(n) for n in ("c_home", "c_draw", "c_away")])


def league_profiles(scored: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """K-means label of each league's mean chances; NULL labels when there are fewer leagues than clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    prof = scored.where(F.col("league").isNotNull()).groupBy("league").agg(*[F.avg(c).alias(c) for c in ("p_home", "p_draw", "p_away")])
    vec = VectorAssembler(inputCols=["p_home", "p_draw", "p_away"], outputCol="features").transform(prof)
    model = KMeans(k=k, seed=seed, maxIter=50).fit(vec)
    return model.transform(vec).select("league", "p_home", "p_draw", "p_away", F.concat(F.lit("k"), F.col("prediction")).alias("label"))


CLUSTERS = {"none": lambda scored: scored.withColumn("cluster", F.lit(None).cast("string")), "tier": lambda scored: scored}


def with_clusters(scored: DataFrame, strategy: str) -> DataFrame:
    """Cluster column by strategy: none, tier (the given `cluster` column) or kmeans-k."""
    if strategy.startswith("kmeans-"):
        labels = league_profiles(scored, int(strategy.split("-")[1])).select("league", F.col("label").alias("cluster"))
        return scored.drop("cluster").join(labels, "league", "left")
    if strategy not in CLUSTERS:
        raise ValueError(f"unknown cluster strategy: {strategy}")
    return CLUSTERS[strategy](scored)
