"""Elo kept up by micro-batch with contests that come late: versioned monthly snapshots, and a replay from the last one that is not touched."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import elo_after
from touchline.operators.prefix import same
from touchline.operators.ratings import elo_fold
from touchline.session import cut, stored
from touchline.streaming.streams import run_batches

GAME = ["contest_id", "ts", "home_id", "away_id", "home_score", "away_score"]


class Versions:
    """Tables under one folder, each with one part a micro-batch (a repeated batch overwrites its own). The part of the latest batch that wrote a (key, month) is valid."""

    def __init__(self, games: DataFrame, by: list[str], folder: str):
        self.spark, self.by, self.folder = games.sparkSession, by, folder
        keys = [games.schema[k] for k in by]
        month, elo = T.StructField("month", T.DateType()), T.DoubleType()
        self.shapes = {
            "log": T.StructType([*keys, month, *[games.schema[c] for c in GAME]]),
            "shots": T.StructType([*keys, month, T.StructField("contest_id", T.LongType()), T.StructField("home_elo", elo), T.StructField("away_elo", elo)]),
            "snapshots": T.StructType([*keys, month, T.StructField("team", T.LongType()), T.StructField("elo", elo)]),
            "written": T.StructType([*keys, month]),
        }
        for name in self.shapes:  # a stream that has seen nothing reads as empty
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.select(*self.shapes[name].names).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def read(self, name: str, below: int | None = None) -> DataFrame:
        got = self.spark.read.schema(T.StructType([*self.shapes[name].fields, T.StructField("batch", T.IntegerType())])).parquet(f"{self.folder}/{name}")
        return got if below is None else got.where(F.col("batch") < below)

    def valid(self, below: int | None = None) -> DataFrame:
        return self.read("written", below).groupBy(*self.by, "month").agg(F.max("batch").alias("batch"))

    def current(self, name: str, months: DataFrame) -> DataFrame:
        return same(self.read(name), months.select(*self.by, "month", "batch"), [*self.by, "month", "batch"]).drop("batch")


def rate_batches(stream: DataFrame, by: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(ratings before every contest, current ratings) over all input so far, as if all contests had come in the order of time.

    Each micro-batch adds its contests to the log. For each key it takes up the snapshot before the first month the batch touches, replays the log from that month on and writes the
    months it replayed as a new version, so a batch in time order replays one month and a late contest only what follows it. A contest that comes again with the same
    month counts with its latest row. Contests without both scores or a time are not rated. Restarts go on from the written tables; a start without input is empty.
    """
    tables = Versions(stream, by, folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        month = F.trunc(F.col("ts").cast("date"), "month")
        rated = batch.where("home_score IS NOT NULL AND away_score IS NOT NULL AND ts IS NOT NULL")
        tables.write("log", rated.withColumn("month", month), batch_id)
        fresh = tables.read("log").where(F.col("batch") == batch_id)
        # a row a key each: stored, their size is known, so that the log and the snapshots need no shuffle to meet them
        starts = stored(fresh.groupBy(*by).agg(F.min("month").alias("from_month")))

        logged = same(tables.read("log", batch_id + 1), starts, by).where("month >= from_month")
        latest = F.max_by(F.struct(*[c for c in GAME if c != "contest_id"]), "batch").alias("g")
        replay = cut(logged.groupBy(*by, "month", "contest_id").agg(latest).select(*by, "month", "contest_id", "g.*"))
        untouched = same(tables.valid(batch_id), starts, by).where("month < from_month")
        resume = stored(untouched.groupBy(*by).agg(F.max_by(F.struct("month", "batch"), "month").alias("v")).select(*by, "v.month", "v.batch"))
        prior = cut(tables.current("snapshots", resume).select(*by, "team", "elo"))

        # contests keep what the month ends need through the fold, so the replay is not joined to its own ratings
        shots, _ = elo_fold(replay, by, prior=prior, keep=["month", *[c for c in GAME if c != "contest_id"]])
        tables.write("shots", shots, batch_id)
        tables.write("snapshots", _month_ends(shots, prior, by), batch_id)
        tables.write("written", shots.select(*by, "month").distinct(), batch_id)

    run_batches(stream, each, folder)
    valid = stored(tables.valid())
    last = valid.groupBy(*by).agg(F.max_by(F.struct("month", "batch"), "month").alias("v")).select(*by, "v.month", "v.batch")
    return tables.current("shots", valid).drop("month"), tables.current("snapshots", last).drop("month")


def _month_ends(rated: DataFrame, prior: DataFrame, by: list[str]) -> DataFrame:
    """Every team's rating at the end of each month its key played in, teams that did not play included."""
    s = F.when(F.col("home_score") > F.col("away_score"), 1.0).when(F.col("home_score") == F.col("away_score"), 0.5).otherwise(0.0)
    both = rated.withColumn("_s", s).select(*by, "month", "ts", "contest_id", F.explode(F.array(
        F.struct(F.col("home_id").alias("team"), elo_after("home_elo", "away_elo", "_s").alias("elo")),
        F.struct(F.col("away_id").alias("team"), elo_after("away_elo", "home_elo", 1 - F.col("_s")).alias("elo")))).alias("t")).select(*by, "month", "ts", "contest_id", "t.*")
    ends = both.groupBy(*by, "month", "team").agg(F.max_by("elo", F.struct("ts", "contest_id")).alias("elo"))
    months = rated.select(*by, "month").distinct().withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy("month")))
    size = months.groupBy(*by).agg(F.max("at").alias("size"))
    known = same(ends, months, [*by, "month"]).select(*by, "team", "at", "elo").unionByName(prior.select(*by, "team", F.lit(0).alias("at"), "elo"))
    until = F.coalesce(F.lead("at").over(W.partitionBy(*by, "team").orderBy("at")) - 1, F.col("size"))
    held = same(known, size, by).withColumn("until", until).where("until >= greatest(at, 1)")
    filled = held.select(*by, "team", "elo", F.explode(F.sequence(F.greatest("at", F.lit(1)), F.col("until"))).alias("at"))
    return same(filled, months, [*by, "at"]).select(*by, "month", "team", "elo")
