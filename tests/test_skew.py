"""Splitting hot keys, blocks and bands never changes a result."""
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators import calibrate as cb
from touchline.operators import form as fm
from touchline.operators import ledger as lg
from touchline.operators import ratings as rt
from touchline.operators.history import HOT_ROWS, asof_attach, hot_keys, trailing
from touchline.operators.metrics import class_rows
from touchline.operators.prefix import BANDS, day_block, quantiles, running, value_block
from touchline.plans import views as v


def same(a, b, digits=9):
    cols = sorted(a.columns)

    def rows(df):
        return sorted(tuple(str(round(x, digits)) if isinstance(x, float) else str(x) for x in r) for r in df.select(*cols).collect())
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def log(spark, sf):
    """One team takes part in a third of all contests."""
    raw = v.team_log(spark, sf, list(v.MEASURES))
    return raw.withColumn("team", F.when(F.col("contest_id") % 3 == 0, F.lit(1)).otherwise(F.col("team"))).where("NOT (contest_id % 3 = 0 AND side = 'away')").cache()


@pytest.fixture()
def low_limit(spark):
    spark.conf.set(HOT_ROWS, "300")
    yield
    spark.conf.unset(HOT_ROWS)


def test_hot_key_is_found(log, low_limit):
    assert hot_keys(log, ["team"]) == [(1,)]


@pytest.mark.parametrize("make", [
    lambda log, hot: fm.form(log, 5, [], hot), lambda log, hot: fm.advanced_form(log, 10, hot), lambda log, hot: fm.xg_history(log, (5, 10), hot),
    lambda log, hot: fm.stat_averages(log, 5, hot), lambda log, hot: fm.rest_days(log, None, None, hot), lambda log, hot: fm.side_splits(log, hot),
    lambda log, hot: fm.team_state(log, hot)])
def test_split_history_is_the_same(log, low_limit, make):
    same(make(log, None), make(log, []))


def test_split_history_with_gaps_longer_than_a_block(spark):
    rows = [(1, f"20{y:02d}-{m:02d}-01 00:00:00", y * 100 + m, float(y + m) if m % 5 else None) for y in range(10, 20) for m in (1, 2, 6)]
    df = spark.createDataFrame(rows, "team int, ts string, id long, x double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    feats = {"mean": (F.avg("x"), 4, 1), "third": (F.max("x"), 3, 3)}
    for cond in (None, F.col("x").isNotNull()):
        same(trailing(df, ["team"], ["ts", "id"], feats, cond, hot=[(1,)]), trailing(df, ["team"], ["ts", "id"], feats, cond, hot=[]))


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "first", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_in_two_levels(log, kind, inclusive):
    gaps = log.withColumn("team", F.when(F.col("contest_id") % 5 != 0, F.col("team"))).withColumn("ts", F.when(F.col("contest_id") % 7 != 0, F.col("ts")))
    order = ["ts", "contest_id", "side"]
    w = W.partitionBy("team").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    x = F.col("sot")
    plain = {"sum": F.coalesce(F.sum(x).over(w), F.lit(0)), "count": F.coalesce(F.count(x).over(w), F.lit(0)), "min": F.min(x).over(w), "max": F.max(x).over(w),
             "first": F.first(x, ignorenulls=True).over(w), "last": F.last(x, ignorenulls=True).over(w)}[kind]
    got = running(gaps, ["team"], order, day_block("ts"), {"r": (kind, x)}, inclusive).select("contest_id", "side", "r")
    assert got.count() == gaps.count()
    same(got, gaps.select("contest_id", "side", plain.alias("r")))


def test_bands_follow_the_values(spark):
    near = spark.range(20_000).select((F.col("id") * 1e-6).alias("x"), (F.col("id") % 10).cast("string").alias("k"))
    rows = near.withColumn("k", F.when(F.col("k") != "0", "hot")).unionByName(spark.createDataFrame([(1e12, "hot"), (-1e12, None), (None, "hot")], "x double, k string"))
    banded, band = value_block(rows, ["k"], "x")
    sizes = banded.withColumn("b", band).groupBy("k", "b").count()
    assert banded.count() == rows.count() and sizes.agg(F.max("count")).first()[0] <= 4 * 18_000 / BANDS
    assert quantiles(rows, ["k"], "x", {"q": 0.5}).count() == 2


def test_asof_keeps_rows_without_key_or_time(spark, sf):
    log = v.team_log(spark, sf, ["score", "rating"])
    left = log.select(F.when(F.col("contest_id") % 5 != 0, F.col("team")).alias("team"), F.when(F.col("contest_id") % 7 != 0, F.col("ts")).alias("ts"), "contest_id", "side")
    got = asof_attach(left, log, ["team"], "ts", "contest_id", ["rating"])
    assert got.count() == left.count()
    old = log.select(F.col("team").alias("t"), F.col("ts").alias("at"), F.struct("ts", "contest_id").alias("o"), "rating")
    want = left.join(old, (left["team"] == old["t"]) & (old["at"] < left["ts"]), "left").groupBy("team", left["ts"], "contest_id", "side").agg(F.max_by("rating", "o").alias("rating"))
    same(got, want)


def test_folds_in_blocks(spark, sf):
    games = v.contests(spark, sf)
    for fold in (rt.elo_fold, rt.glicko_fold):
        for part in (0, 1):
            same(fold(games, ["pool"], block_rows=60)[part], fold(games, ["pool"])[part])


def test_restake_in_blocks(spark, sf):
    book = lg.with_kelly(v.ledger(spark, sf))
    same(lg.restake(book, ["strategy"], block_rows=70)[0], lg.restake(book, ["strategy"])[0])


def test_isotonic_in_bands(spark, sf, monkeypatch):
    rows = class_rows(v.scored(spark, sf).withColumn("head", F.lit("all")), ["head"])
    whole = cb.isotonic_heads(rows, ["head", "cls"]).collect()
    monkeypatch.setattr(cb, "BAND_ROWS", 20)
    assert sorted(cb.isotonic_heads(rows, ["head", "cls"]).collect()) == sorted(whole)


def test_quantiles_are_exact(spark, sf):
    rows = v.factors(spark, sf).where("elo IS NOT NULL")
    got = {r["league"]: r["q"] for r in quantiles(rows, ["league"], "elo", {"q": 0.3}).collect()}
    want = {r["league"]: r["q"] for r in rows.groupBy("league").agg(F.percentile("elo", 0.3).alias("q")).collect()}
    assert got == pytest.approx(want)


def test_partitioning_does_not_matter(spark, sf):
    log = v.team_log(spark, sf).cache()
    same(fm.form(log.repartition(13, "score"), hot=[]), fm.form(log.coalesce(1), hot=[]))


def test_later_rows_never_change_features(spark, sf):
    log = v.team_log(spark, sf).cache()
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    early = fm.form(log.where(F.col("ts") < cut), hot=[])
    same(early, fm.form(log, hot=[]).where(F.col("ts") < cut))
