"""Event-time timers: any order of arrival gives the same events, restarts go on, and idle streams read as empty."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.streaming import streams as sm
from touchline.streaming import timers as tm

SCHEMA = "contest_id long, priority int, status string, home_score long, away_score long, recorded_at timestamp"
T0 = datetime(2024, 5, 1, 12)


def at(minute):
    return T0 + timedelta(minutes=minute)


#: 1: both feeds, first wins. 2: second only. 3: first too late for the grace. 4: first within the grace. 5: finished without scores, then with. 6: never ends.
ROWS = [(1, 0, "1H", 0, 0, at(0)), (1, 0, "1H", 1, 0, at(5)), (1, 1, "2H", 1, 0, at(60)), (1, 0, "2H", 1, 1, at(61)), (1, 0, "Finished", 2, 1, at(110)), (1, 1, "Finished", 9, 9, at(100)),
        (2, 1, "Finished", 3, 0, at(115)), (3, 1, "Finished", 4, 4, at(100)), (3, 0, "Finished", 5, 5, at(400)), (4, 1, "Finished", 6, 6, at(100)), (4, 0, "Finished", 7, 7, at(250)),
        (5, 0, "Finished", None, None, at(90)), (5, 0, "Finished", 0, 0, at(95)), (5, 0, "Finished", 1, 1, at(96)), (6, 0, "1H", 0, 0, at(3))]
WANT = [(1, "final", at(110), "Finished", 2, 1, 0), (1, "phase", at(0), "1H", 0, 0, 0), (1, "phase", at(60), "2H", 1, 0, 1), (1, "phase", at(100), "Finished", 9, 9, 1),
        (2, "final", at(295), "Finished", 3, 0, 1), (2, "phase", at(115), "Finished", 3, 0, 1), (3, "final", at(280), "Finished", 4, 4, 1), (3, "phase", at(100), "Finished", 4, 4, 1),
        (4, "final", at(250), "Finished", 7, 7, 0), (4, "phase", at(100), "Finished", 6, 6, 1), (5, "final", at(95), "Finished", 0, 0, 0), (5, "phase", at(90), "Finished", None, None, 0),
        (6, "phase", at(3), "1H", 0, 0, 0)]
BEAT = (None, None, None, None, None, at(3 * 24 * 60))


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def events(spark, folder):
    stream = tm.score_events(sm.read_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, per_batch=1), delay="1 day")
    return sorted(tuple(r) for r in sm.run_to_files(stream, folder).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_arrival_order_does_not_matter(spark, tmp_path, seed):
    rows = ROWS + ROWS[:4]
    random.Random(seed).shuffle(rows)
    for i in range(0, len(rows), 5):
        write(spark, rows[i:i + 5], f"{tmp_path}/in")
    write(spark, [BEAT], f"{tmp_path}/in")
    assert events(spark, tmp_path) == sorted(WANT)


def test_the_second_feed_waits_for_its_timer_and_a_restart_goes_on(spark, tmp_path):
    write(spark, ROWS, f"{tmp_path}/in")
    assert events(spark, tmp_path) == []  # the watermark stands before all of them
    assert events(spark, tmp_path) == []  # a restart without input
    write(spark, [(99, 0, "1H", 0, 0, at(24 * 60 + 200))], f"{tmp_path}/in")
    got = events(spark, tmp_path)
    assert (1, "final", at(110), "Finished", 2, 1, 0) in got and not any(r[0] == 2 and r[1] == "final" for r in got)
    write(spark, [BEAT], f"{tmp_path}/in")
    assert [r for r in events(spark, tmp_path) if r[0] != 99] == sorted(WANT)


def test_picks_are_settled_once(spark, tmp_path):
    for i in range(0, len(ROWS), 4):
        write(spark, ROWS[i:i + 4], f"{tmp_path}/in")
    write(spark, [BEAT], f"{tmp_path}/in")
    picks = spark.createDataFrame([(10, 1, None), (11, 1, None), (12, 2, "win"), (13, 3, None), (14, 77, None)], "id long, contest_id long, result string")
    grade = lambda book, scores: book.where("result IS NULL").join(scores, "contest_id").select("id", F.col("home_score").alias("h"))
    got = sm.run_to_files(tm.settled_picks(sm.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, per_batch=1), picks, grade), str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(10, 2), (11, 2), (13, 4)]


def test_rolling_status_equals_windows(spark, tmp_path):
    r = random.Random(5)
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(s, day(d) + timedelta(minutes=r.randint(0, 1439)), r.gauss(0.08 if (d // 40) % 2 else -0.08, 0.2), d) for s in "ab" for d in range(200) for _ in range(r.randint(0, 3))]
    rows += [("a", day(3), None, 3)]
    want = []
    for s in "ab":
        was = None
        for d in sorted({x[3] for x in rows if x[0] == s and x[2] is not None}):
            inside = [x[2] for x in rows if x[0] == s and x[2] is not None and d - 30 < x[3] <= d]
            if len(inside) < 5:
                continue
            mean = sum(inside) / len(inside)
            status = "healthy" if mean >= 0 else "warning" if mean >= -0.02 else "alert"
            if (status == "alert") != (was == "alert"):
                want.append((s, day(d).date(), len(inside), round(mean, 9), status, was, "alert" if status == "alert" else "recovery"))
            was = status
    schema = "strategy string, ts timestamp, clv double"
    blocks = [[x[:3] for x in rows if x[3] // 20 == b] for b in range(10)]
    for b in (1, 0, 2, 4, 3, 5, 7, 6, 9, 8):
        spark.createDataFrame(blocks[b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(None, day(900), None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tm.rolling_status(sm.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, per_batch=1), delay="45 days")
    got = [(r["strategy"], r["day"], r["n"], round(r["avg_clv"], 9), *r[4:]) for r in sm.run_to_files(stream, str(tmp_path)).collect()]
    assert len(want) > 4 and sorted(got) == sorted(want)
