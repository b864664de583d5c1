"""Readers and scans: parquet, CSV, JSON and JDBC, and the contest scans built on them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import FINISHED, result_letter


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def finished_contests(games: DataFrame) -> DataFrame:
    """Finished contests with both scores, plus the result letter."""
    done = games.where(F.col("status").isin(*FINISHED) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return done.withColumn("result", result_letter("home_score", "away_score"))


def stats_of(games: DataFrame, stats: DataFrame, leak: list[str]) -> DataFrame:
    """Stats joined to their contests, without columns known only after the event."""
    return games.join(stats.drop(*leak), "contest_id")


def in_pools(games: DataFrame, pools: DataFrame, cols: list[str]) -> DataFrame:
    """Only contests whose (name, country) pair is listed."""
    return games.join(pools.select(*cols), cols, "left_semi")


def without_pool(games: DataFrame, stats: DataFrame, pool: str) -> DataFrame:
    return games.where(F.col("pool") != pool).join(stats, "contest_id")


def missing_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without any child row (finished contests with no quotes)."""
    return parents.join(children.select(key), key, "left_anti")


def write_features(df: DataFrame, path: str, partition: list[str]) -> None:
    """Feature tables as parquet folders by season or pool. The shuffle is rebalanced: small values share a task, a large one is split by size over several."""
    df.hint("rebalance", *partition).write.mode("overwrite").partitionBy(*partition).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    return (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
            .schema(schema).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multi_line).schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """Parallel JDBC scan split on a numeric column."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", parts).load())


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append") -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode).save()


def clean_text(col) -> "F.Column":
    """Text without NUL characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "\\x00", "")


def naive_timestamp(col) -> "F.Column":
    """ISO text (with or without zone) to a naive UTC timestamp; NULL if unreadable."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c).cast("timestamp_ntz")
