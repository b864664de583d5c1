"""Ordered folds over independent pools, in bounded blocks.

Some results depend on every earlier row (ratings updated contest by contest, stakes rounded to
cents). Rows of a pool are numbered; block b of every pool is folded in parallel by pool, with the pool's
state carried to block b + 1 through a checkpointed table. A task never holds more than one block.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.prefix import day_block, running
from touchline.session import cut

BLOCK_ROWS = "touchline.fold.rows"
BLOCK_ROWS_DEFAULT = "500000"


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, out: T.StructType, state: T.StructType,
                 block_rows: int | None = None, prior: DataFrame | None = None, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold `step(rows, state) -> (out_rows, new_state)` along `order` inside each pool.

    `out` and `state` describe the produced rows (without the keys); `prior` is a state to start from.
    `at_most` is a known bound on the rows (a footer count); without it the rows are counted. Returns both
    tables with keys.
    """
    spark = df.sparkSession
    block_rows = block_rows or int(spark.conf.get(BLOCK_ROWS, BLOCK_ROWS_DEFAULT))
    key_fields = [df.schema[k] for k in keys]
    both = T.StructType([*key_fields, T.StructField("_is_state", T.BooleanType()),
                         *[T.StructField("o_" + f.name, f.dataType) for f in out],
                         *[T.StructField("s_" + f.name, f.dataType) for f in state]])

    def group(rows: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
        source = rows if len(rows) else prior
        if not len(source):
            return pd.DataFrame(columns=both.names)
        key = {k: source[k].iloc[0] for k in keys}
        got, after = step(rows.sort_values(order, kind="stable"), prior)
        frames = [got.add_prefix("o_").assign(_is_state=False), after.add_prefix("s_").assign(_is_state=True)]
        frames = [f.reindex(columns=both.names) for f in frames if len(f)]
        if not frames:
            return pd.DataFrame(columns=both.names)
        whole = pd.concat(frames, ignore_index=True).assign(**key)[both.names]
        return whole.astype({c: object for c in both.names if whole[c].isna().all()})  # a pool without rows: null fits any type, a double does not

    blocks = 1
    if (df.count() if at_most is None else at_most) > block_rows:
        numbered = running(df, keys, order, day_block(order[0]), {"_rn": ("count", F.lit(1))})
        df = cut(numbered.withColumn("_block", F.floor((F.col("_rn") - 1) / block_rows)).drop("_rn"))
        blocks = int(df.agg(F.max("_block").alias("m")).first()["m"]) + 1
    shape = T.StructType([*key_fields, *state.fields])
    current = spark.createDataFrame([], shape) if prior is None else prior.select(*shape.names)
    done = []
    for b in range(blocks):
        part = df.where(F.col("_block") == b).drop("_block") if blocks > 1 else df
        got = part.groupBy(*keys).cogroup(current.groupBy(*keys)).applyInPandas(group, both)
        got = cut(got)
        done.append(got.where(~F.col("_is_state")).select(*keys, *[F.col("o_" + f.name).alias(f.name) for f in out]))
        current = got.where("_is_state").select(*keys, *[F.col("s_" + f.name).alias(f.name) for f in state])
    return reduce(DataFrame.unionByName, done), current
