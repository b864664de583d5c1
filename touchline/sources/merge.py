"""Keyed merges on plain files: upsert, replace, refresh and gap fill.

The functions on DataFrames return the merged table. `KeyedTable` keeps a table in hash buckets of its key and rewrites only those that hold changed keys.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import ensure_checkpoint_dir


def newest(df: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """One row per key, the most recent; aggregated map-side, so repeated keys never pile up in a task."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*recency)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: list[str], update: list[str]) -> DataFrame:
    """Insert new keys; on known keys overwrite the `update` columns where the new value is present."""
    fresh = newest(new, keys, recency)
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_old", F.lit(True)).alias("o").join(fresh.alias("n"), keys, "full")
    cols = []
    for c in rest:
        was = F.col(f"o.{c}")
        now = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        cols.append((F.coalesce(now, was) if c in update else F.when(F.col("o._old"), was).otherwise(now)).alias(c))
    return both.select(*keys, *cols)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop all rows of every key in `new`, then add the new rows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def refresh_quotes(old: DataFrame, new: DataFrame, recency: list[str], markets: tuple[str, ...] = ("1x2", "double_chance")) -> DataFrame:
    """Open quotes get the new price and keep their opening; new keys come in; only two markets are kept up."""
    keys = ["contest_id", "market", "source", "outcome"]
    fresh = new.where(F.col("market").isin(*markets))
    open_, closed = old.where(~F.col("is_closing")), old.where("is_closing")
    return upsert(open_, fresh, keys, recency, ["price"]).unionByName(closed)


def fill_missing(base: DataFrame, add: DataFrame, parent: list[str], row: list[str], recency: list[str]) -> DataFrame:
    """Add rows for parents that have none yet, one per natural key."""
    return base.unionByName(newest(add.join(base.select(*parent), parent, "left_anti"), row, recency).select(*base.columns))


class KeyedTable:
    """A Parquet folder partitioned by `bucket`, a hash of the key columns: a change reads and rewrites the buckets of its keys, all other files stay as they are.

    All changes have the form merge(old rows of these buckets, change) -> new rows. The result is written beside the table first and then takes the place of its buckets (dynamic
    partition overwrite), so a job that fails before leaves the table as it was. One writer at a time. A bucket left without rows is removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> None:
        self._bucketed(df).repartition("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge `new` into the table; the numbers of the rewritten buckets."""
        placed = self._bucketed(new)
        touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most `buckets` numbers
        if not touched:
            return []
        whole = self.spark.read.parquet(self.path)
        old = whole.where(F.col("bucket").isin(touched)).drop("bucket")
        beside = f"{ensure_checkpoint_dir(self.spark)}/merge-{uuid.uuid4().hex}"
        self._bucketed(merge(old, new).select(*old.columns)).write.partitionBy("bucket").parquet(beside)
        done = self.spark.read.schema(whole.schema).parquet(beside)
        left = {r["bucket"] for r in done.select("bucket").distinct().collect()}
        done.repartition("bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for gone in [self.path + f"/bucket={b}" for b in touched if b not in left] + [beside]:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return touched

    def upsert(self, new: DataFrame, recency: list[str], update: list[str]) -> list[int]:
        return self.change(new, lambda old, fresh: upsert(old, fresh, self.keys, recency, update))

    def replace(self, new: DataFrame) -> list[int]:
        return self.change(new, lambda old, fresh: replace_keys(old, fresh, self.keys))

    def delete(self, gone: DataFrame) -> list[int]:
        return self.change(gone.select(*self.keys), lambda old, keys: old.join(keys, self.keys, "left_anti"))
