"""Structured Streaming forms of the polled feeds: quotes, scores, line-value health and ratings.

Stateful functions see one key's rows of one micro-batch; `read_files(per_batch=...)` bounds that. The state
kept per key is a few numbers.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.prefix import running, same
from touchline.operators.scan import BLOCK, row_blocks
from touchline.session import ensure_checkpoint_dir, stored

# Least gap between snapshots and the look-ahead.
GAP_MINUTES, AHEAD_HOURS = 25, 36


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into parquet files and read them back."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


# ---- quotes ----------------------------------------------------------------------------------------------------------

def in_look_ahead(quotes: DataFrame, games: DataFrame, hours: int = AHEAD_HOURS) -> DataFrame:
    """Quotes of contests that have not started and start within the look-ahead (stream-static join)."""
    ahead = F.col("recorded_at") + F.make_dt_interval(hours=F.lit(hours))
    open_ = games.where(F.col("status") == "Not Started").select("contest_id", "starts_at")
    return quotes.join(open_, "contest_id").where((F.col("starts_at") >= F.col("recorded_at")) & (F.col("starts_at") < ahead)).drop("starts_at")


def spaced_snapshots(quotes: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Snapshots of each (contest, market) at least `gap_minutes` after the last accepted one; state = its time."""
    gap = pd.Timedelta(minutes=gap_minutes)
    names = ["contest_id", "market", "recorded_at", "price"]
    src = quotes.select(*names)

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["recorded_at", "price"])
        keep = []
        for at in rows["recorded_at"]:
            ok = last is None or at == last or at - last >= gap
            keep.append(ok)
            last = at if ok else last
        state.update((int(last.value // 1000),))
        yield rows[keep][names]

    return src.groupBy("contest_id", "market").applyInPandasWithState(accept, src.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def thinned_snapshots(quotes: DataFrame, gap_minutes: int = GAP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Cheap form: one snapshot per (contest, market, 25-minute bucket), deduplicated within the watermark."""
    bucket = F.window("recorded_at", f"{gap_minutes} minutes").start
    return (quotes.withColumn("bucket", bucket).withWatermark("recorded_at", delay)
            .dropDuplicatesWithinWatermark(["contest_id", "market", "bucket"]))


def opening_drift(quotes: DataFrame) -> DataFrame:
    """Opening price, count and running drift of each quote; state = (opening, count)."""
    src = quotes.select("contest_id", "market", "recorded_at", "price")
    out = T.StructType([*src.schema.fields, T.StructField("opening", T.DoubleType()), T.StructField("drift", T.DoubleType()), T.StructField("n", T.LongType())])

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opening, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["recorded_at", "price"])
        opening = float(rows["price"].iloc[0]) if opening is None else opening
        n = range(seen + 1, seen + len(rows) + 1)
        state.update((opening, seen + len(rows)))
        yield rows.assign(opening=opening, drift=(rows["price"] - opening) / opening, n=list(n))[out.names]

    return src.groupBy("contest_id", "market").applyInPandasWithState(track, out, "opening double, n long", "append", GroupStateTimeout.NoTimeout)


def price_windows(quotes: DataFrame, width: str = "30 minutes", slide: str | None = None, delay: str = "10 minutes", by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Tumbling or sliding price statistics, closed by the watermark."""
    w = F.window("recorded_at", width, slide) if slide else F.window("recorded_at", width)
    src = quotes.withWatermark("recorded_at", delay) if quotes.isStreaming else quotes
    got = src.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "low", "high", "mean")


def quoting_sessions(quotes: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Spans of continuous quoting per contest."""
    src = quotes.withWatermark("recorded_at", delay) if quotes.isStreaming else quotes
    got = src.groupBy(F.session_window("recorded_at", gap).alias("w"), "contest_id").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "contest_id", "n", "high")


# ---- line-value health -----------------------------------------------------------------------------------------------

def status_changes(values: DataFrame, classify: Callable[[pd.Series], pd.Series], folder: str) -> DataFrame:
    """Run a stream of values(strategy, ts, id, value) and return the rows at which a strategy's status changes, with `status` and the one before, `was`.

    A batch is labelled row by row and compared along (ts, id) in blocks of bounded rows, so that no task holds a strategy's rows; its last statuses are a small table that the next batch starts
    from. A batch that is run again writes the same folders again.
    """
    spark, last = values.sparkSession, F.struct("ts", "id")
    src = values.select("strategy", "ts", "id", "value")

    @F.pandas_udf("string")
    def label(x: pd.Series) -> pd.Series:
        return classify(x)

    out = T.StructType([*src.schema.fields, T.StructField("status", T.StringType()), T.StructField("was", T.StringType())])
    held = T.StructType([src.schema["strategy"], T.StructField("status", T.StringType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch.withColumn("status", label("value")))
        prior = spark.read.schema(held).parquet(f"{folder}/state/batch={batch_id - 1}")
        run = running(row_blocks(rows, ["strategy"], "ts", "id"), ["strategy"], ["ts", "id"], F.col(BLOCK), {"was": ("last", F.col("status"))}, inclusive=False)
        run = same(run, prior.withColumnRenamed("status", "_held"), ["strategy"], "left").withColumn("was", F.coalesce("was", "_held"))
        run.where("was IS NULL OR was <> status").select(*out.names).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        newest = rows.groupBy("strategy").agg(F.max_by("status", last).alias("status")).withColumn("_new", F.lit(1)).unionByName(prior.withColumn("_new", F.lit(0)))
        newest.groupBy("strategy").agg(F.max_by("status", "_new").alias("status")).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    for part, schema in (("out", out), ("state", held)):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{part}/batch=-1")
    run_batches(src, each, folder)
    return spark.read.schema(T.StructType([*out.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out").drop("batch")
