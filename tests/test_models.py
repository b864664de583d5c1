"""Models and streams."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibrate as cb
from touchline.operators import learn as ln
from touchline.operators import ratings as rt
from touchline.plans import catalog
from touchline.plans import views as v
from touchline.streaming import late_ratings as lr
from touchline.streaming import streams as sm

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["logit_walk_forward", "boosted_trees", "goal_model", "agreement_runner", "cluster_calibration"])
def test_chances_sum_to_one(spark, name):
    df = catalog.QUERIES[name](spark, MID)
    cols = [c for c in df.columns if c[:2] in ("p_", "c_")]
    off = df.where(F.abs(sum(F.col(c) for c in cols) - 1) > 0.001)
    assert df.count() > 100 and off.count() == 0


@pytest.mark.parametrize("name", ["stacking", "ablation", "rating_logit"])
def test_losses_are_sane(spark, name):
    rows = catalog.QUERIES[name](spark, MID).collect()
    assert rows and all(0.8 < r["log_loss"] < 1.3 and 0.5 < r["brier"] < 0.8 for r in rows)


@pytest.mark.parametrize("name", ["filtered_model", "confidence_sweep", "importance", "factor_weights", "flag_model", "platt_scaling"])
def test_model_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, MID).count() > 0


def test_pooling_against_definition():
    rng = np.random.default_rng(3)
    y, w = rng.random(60), rng.integers(1, 5, 60).astype(float)
    blocks = cb.pool_violators(np.arange(60.0), np.arange(60.0), w, y * w)
    got = np.concatenate([[b.s / b.w] * int(b.hi - b.lo + 1) for b in blocks.itertuples()])
    mean = lambda j, k: (y[j:k + 1] * w[j:k + 1]).sum() / w[j:k + 1].sum()
    want = [max(min(mean(j, k) for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    assert got == pytest.approx(want)


def test_goal_model_solves_the_likelihood_equations(spark, sf):
    games = v.contests(spark, sf)
    params, home = ln.goal_strengths(games, half_scale_days=1e12, tolerance=1e-6)
    m = ln.goal_means(games, params, home)
    by = m.groupBy("home_id").agg(F.sum("home_score").alias("g"), F.sum("lam").alias("e"))
    whole = m.agg(F.sum("home_score").alias("g"), F.sum("lam").alias("e"), F.sum("away_score").alias("ga"), F.sum("mu").alias("ea")).first()
    assert whole["g"] == pytest.approx(whole["e"], rel=1e-3) and whole["ga"] == pytest.approx(whole["ea"], rel=1e-2)
    assert by.count() > 5


def test_ratings_stream_in_two_runs(spark, sf, tmp_path):
    games = v.contests(spark, sf).select("contest_id", "ts", "pool", "home_id", "away_id", "home_score", "away_score")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    folder = f"{tmp_path}/r"
    games.where(F.col("ts") < cut).write.parquet(f"{folder}/in/a")
    stream = lambda: sm.read_files(spark, f"{folder}/in/*", games.schema)
    lr.rate_batches(stream(), ["pool"], folder)
    games.where(F.col("ts") >= cut).write.parquet(f"{folder}/in/b")
    shots, final = lr.rate_batches(stream(), ["pool"], folder)
    want, end = rt.elo_fold(games, ["pool"])
    key = lambda df, c: {tuple(r[k] for k in c[:-1]): round(r[c[-1]], 6) for r in df.select(*c).collect()}
    assert key(shots, ["pool", "contest_id", "home_elo"]) == key(want, ["pool", "contest_id", "home_elo"])
    assert key(final, ["pool", "team", "elo"]) == key(end, ["pool", "team", "elo"])


def test_windows_stream_equals_batch(spark, sf):
    batch = sm.price_windows(_batch_quotes(spark, sf))
    got = {(r["start"], r["market"]): r["n"] for r in catalog.QUERIES["stream_windows"](spark, sf).collect()}
    want = {(r["start"], r["market"]): r["n"] for r in batch.withColumn("start", F.col("start").cast("timestamp_ntz")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) <= 10  # only windows still open at the watermark are missing


def _batch_quotes(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("contest_id"), F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("recorded_at"), F.col("value").alias("price"))


def test_snapshots_keep_state_between_batches(spark, tmp_path):
    rows = [(1, "1x2", f"2024-01-01 10:{m:02d}:00", 2.0) for m in (0, 10, 24, 25, 40, 50)]
    df = spark.createDataFrame(rows, "contest_id long, market string, recorded_at string, price double").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    df.where("minute(recorded_at) < 20").write.parquet(f"{tmp_path}/in/a")
    stream = lambda: sm.spaced_snapshots(sm.read_files(spark, f"{tmp_path}/in/*", df.schema))
    sm.run_to_files(stream(), str(tmp_path))
    df.where("minute(recorded_at) >= 20").write.parquet(f"{tmp_path}/in/b")
    got = sm.run_to_files(stream(), str(tmp_path))
    assert sorted(r["recorded_at"].minute for r in got.collect()) == [0, 25, 50]
