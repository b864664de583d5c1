"""Ratings kept up from files that come late, against the fold over all contests at once."""
import random
from datetime import datetime, timedelta

from touchline.operators import ratings as rt
from touchline.streaming import late_ratings as lr
from touchline.streaming import streams as sm

SCHEMA = "contest_id long, ts timestamp_ntz, pool string, home_id long, away_id long, home_score long, away_score long"


def games(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        h, a = r.sample(range(8), 2)
        out.append((i, datetime(2024, 1, 1) + timedelta(days=r.randint(0, 200)), r.choice(["x", "y", None]), h, a, r.randint(0, 3), r.randint(0, 3)))
    return out


def rated(spark, folder, rows=None):
    if rows:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return lr.rate_batches(sm.read_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, per_batch=1), ["pool"], str(folder))


def close(got, want, key):
    a, b = ({tuple(r[k] for k in key): [round(x, 6) for c, x in sorted(r.asDict().items()) if "elo" in c] for r in df.collect()} for df in (got, want))
    assert a and a == b


def test_late_files_replay(spark, tmp_path):
    rows = games(150, 1)
    random.Random(2).shuffle(rows)
    for i in range(0, 150, 50):
        shots, final = rated(spark, tmp_path, rows[i:i + 50])
        want, end = rt.elo_fold(spark.createDataFrame(rows[:i + 50], SCHEMA), ["pool"])
        close(shots, want, ["pool", "contest_id"])
        close(final, end, ["pool", "team"])
    again, _ = rated(spark, tmp_path)  # a restart without input
    close(again, want, ["pool", "contest_id"])


def test_a_corrected_score_and_open_contests(spark, tmp_path):
    rows = games(40, 3)
    rated(spark, tmp_path, [*rows, (900, None, "x", 1, 2, 1, 1), (901, datetime(2024, 2, 1), "x", 1, 2, None, 1)])
    fixed = [(*rows[5][:5], 9, 0)]
    shots, _ = rated(spark, tmp_path, fixed)
    close(shots, rt.elo_fold(spark.createDataFrame(rows[:5] + fixed + rows[6:], SCHEMA), ["pool"])[0], ["pool", "contest_id"])


def test_a_replay_is_not_joined_to_its_ratings(spark, tmp_path, monkeypatch):
    rows, joined, join = games(60, 5), [], lr.same
    monkeypatch.setattr(lr, "same", lambda left, right, on, *how: (joined.append(on), join(left, right, on, *how))[1])
    shots, _ = rated(spark, tmp_path, rows)
    assert joined and not any("contest_id" in on for on in joined)
    df = spark.createDataFrame(rows, SCHEMA)
    kept, _ = rt.elo_fold(df, ["pool"], block_rows=9, keep=["ts", "home_id", "away_score"])
    close(shots, kept, ["pool", "contest_id"])
    assert sorted((r["contest_id"], r["ts"], r["home_id"], r["away_score"]) for r in kept.collect()) == [(g[0], g[1], g[3], g[6]) for g in rows]


def test_no_input(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    shots, final = rated(spark, tmp_path)
    assert shots.collect() == [] and final.collect() == []
