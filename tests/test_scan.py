"""Blocks that follow the data, and scans over them, against plain loops."""
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.operators import ledger as lg
from touchline.operators import scan as sn
from touchline.operators.folds import row_count_steps

SCHEMA = "id long, strategy string, ts timestamp_ntz, result string, odds double, prob double, fraction double"


def book(n, seed=1):
    """90 % of one key's rows lie on one day, half of these at one instant; some rows have no time, one key is NULL."""
    r, out = random.Random(seed), []
    for i in range(n):
        x = r.random()
        ts = None if x < 0.01 else datetime(2024, 3, 5) if x < 0.45 else datetime(2024, 3, 5) + timedelta(seconds=r.randint(0, 86399)) if x < 0.9 else datetime(2024, 1, 1) + timedelta(days=r.randint(0, 300))
        out.append((i, r.choice(["a", "a", "a", None]), ts, r.choice(["win", "loss", None]), 1.2 + r.random() * 3, r.random(), 0.02))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [50, 300])
def test_no_block_is_above_its_bound(spark, rows):
    df = spark.createDataFrame(book(6000), SCHEMA)
    got = sn.row_blocks(df, ["strategy"], "ts", "id", rows).select("strategy", "ts", "id", F.struct("_block.*").alias("b")).collect()  # some day is crowded
    assert len(got) == 6000
    sizes = Counter((r["strategy"], tuple(r["b"])) for r in got)
    assert max(sizes.values()) <= 2.2 * rows
    for key in ("a", None):
        own = sorted((r for r in got if r["strategy"] == key), key=lambda r: (r["ts"] is not None, r["ts"] or datetime.min, r["id"]))
        places = [tuple(r["b"]) for r in own]
        assert places == sorted(places)


def test_curve_equals_a_loop_on_a_crowded_day(spark, monkeypatch):
    monkeypatch.setattr(sn, "ROWS", 100)
    rows = book(3000, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = sn.row_blocks(df.where("result IS NOT NULL"), ["strategy"], "ts", "id", 100)
    gain = F.when(F.col("result") == "win", 0.02 * (F.col("odds") - 1)).otherwise(-0.02)
    got = {r["id"]: (r["total"], r["peak"]) for r in sn.peak_scan(blocks, ["strategy"], ["ts", "id"], F.log1p(gain)).collect()}
    for key in ("a", None):
        total = peak = 0.0
        for r in sorted((r for r in rows if r[1] == key and r[3]), key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0])):
            total += math.log1p(0.02 * (r[4] - 1) if r[3] == "win" else -0.02)
            peak = max(peak, total)
            assert got[r[0]] == pytest.approx((total, peak), abs=1e-9)


def test_offsets_equal_separate_runs(spark):
    rows = book(1500, 3)
    caps, shares, limits = [0.03, 0.1], [0.25, 1.0], [0.05, 0.4]
    got = {tuple(r)[:5]: tuple(r)[5:] for r in sn.stake_offsets(spark.createDataFrame(rows, SCHEMA), ["strategy"], caps, shares, limits, offsets=4, step=30, rows=70).collect()}
    want = {}
    for key in ("a", None):
        done = sorted((r for r in rows if r[1] == key and r[3]), key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0]))
        for cap in caps:
            for share in shares:
                for limit in limits:
                    for start in range(4):
                        n = wins = 0
                        total = peak = fall = 0.0
                        for _, _, _, result, odds, prob, _ in done[30 * start:]:
                            f = min(max(0.0, (prob * (odds - 1) - (1 - prob)) / (odds - 1)) * share, cap)
                            if f > 0 and prob * odds - 1 >= limit:
                                n, wins = n + 1, wins + (result == "win")
                                total += math.log1p(f * (odds - 1) if result == "win" else -f)
                                peak = max(peak, total)
                                fall = min(fall, total - peak)
                        if n:
                            want[key, cap, share, limit, start] = (n, wins, total, math.expm1(fall))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2:] == pytest.approx(v[2:], abs=1e-9)


def test_row_numbers_over_one_crowded_day(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1)) for i in range(500)], "id long, ts timestamp_ntz")
    got = {r["id"]: r["step"] for r in row_count_steps(df, ["ts", "id"], 100, 50).collect()}
    assert got == {i: (i - 100) // 50 for i in range(100, 500)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lg.compound_equity(empty, ["strategy"]).collect() == [] and sn.stake_offsets(empty, ["strategy"], [0.1], [1.0], [0.0]).collect() == []
