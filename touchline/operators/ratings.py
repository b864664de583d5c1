"""Elo and Glicko-2 ratings: exact ordered folds per pool, and rating periods that run in parallel."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import glicko
from touchline.functions.scalars import GLICKO_SCALE, glicko_expected, glicko_g, three_way
from touchline.operators.fold import ordered_fold
from touchline.session import cut, ensure_checkpoint_dir

ORDER = ["ts", "contest_id"]
ELO_K, ELO_START = 32.0, 1500.0


def _fields(*names: str, first: str = "contest_id") -> T.StructType:
    return T.StructType([T.StructField(first, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])


def elo_fold(games: DataFrame, by: list[str], k: float = ELO_K, start: float = ELO_START, block_rows: int | None = None,
             prior: DataFrame | None = None, at_most: int | None = None, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Ratings of both sides before every contest, updated contest by contest, and the final ratings. The columns `keep` go with a contest, so that nothing is joined back."""
    def step(rows: pd.DataFrame, before: pd.DataFrame):
        now = dict(zip(before["team"], before["elo"]))
        out = []
        for cid, h, a, hs, as_ in zip(rows["contest_id"], rows["home_id"], rows["away_id"], rows["home_score"], rows["away_score"]):
            rh, ra = now.get(h, start), now.get(a, start)
            move = k * (0.5 * (1 + (hs > as_) - (hs < as_)) - 1.0 / (1.0 + 10.0 ** ((ra - rh) / 400.0)))
            out.append((cid, rh, ra))
            now[h], now[a] = rh + move, ra - move
        rated = pd.DataFrame(out, columns=["contest_id", "home_elo", "away_elo"])
        return rated.assign(**{c: rows[c].to_numpy() for c in keep}), pd.DataFrame(now.items(), columns=["team", "elo"])

    played = _played(games, by, keep)
    shape = T.StructType([*_fields("home_elo", "away_elo"), *[played.schema[c] for c in keep]])
    return ordered_fold(played, by, ORDER, step, shape, _fields("elo", first="team"), block_rows, prior, at_most)


def _played(games: DataFrame, by: list[str], keep: list[str] = ()) -> DataFrame:
    done = games.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return done.select(*by, *dict.fromkeys([*ORDER, "home_id", "away_id", "home_score", "away_score", *keep]))


def glicko_fold(games: DataFrame, by: list[str], tau: float = glicko.TAU, block_rows: int | None = None, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Glicko-2 updated after every contest; both sides are read before either is changed."""
    fresh = (glicko.RATING, glicko.RD, glicko.VOLATILITY)

    def step(rows: pd.DataFrame, prior: pd.DataFrame):
        now = {t: (r, d, s) for t, r, d, s in zip(prior["team"], prior["rating"], prior["rd"], prior["volatility"])}
        out = []
        for cid, h, a, hs, as_ in zip(rows["contest_id"], rows["home_id"], rows["away_id"], rows["home_score"], rows["away_score"]):
            mine, theirs = now.get(h, fresh), now.get(a, fresh)
            out.append((cid, *mine, *theirs))
            now[h], now[a] = glicko.rate_pair(mine, theirs, 0.5 * (1 + (hs > as_) - (hs < as_)), tau)
        names = [f"{side}_{c}" for side in ("home", "away") for c in ("rating", "rd", "volatility")]
        state = pd.DataFrame([(t, *x) for t, x in now.items()], columns=["team", "rating", "rd", "volatility"])
        return pd.DataFrame(out, columns=["contest_id", *names]), state

    names = [f"{side}_{c}" for side in ("home", "away") for c in ("rating", "rd", "volatility")]
    return ordered_fold(_played(games, by), by, ORDER, step, _fields(*names), _fields("rating", "rd", "volatility", first="team"), block_rows, at_most=at_most)


def _update_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        r, d, s = glicko.update(pdf["rating"], pdf["rd"], pdf["volatility"], pdf["v_inverse"], pdf["gain"])
        yield pdf.drop(columns=["v_inverse", "gain"]).assign(rating=r, rd=d, volatility=s)


def glicko_periods(games: DataFrame, by: list[str], unit: str = "quarter") -> tuple[DataFrame, DataFrame]:
    """Rating periods: all contests of a period are rated at once from the ratings at its start.

    The scalable form: inside a period everything is joins and sums over (pool, entity), and the
    ratings table, one row per entity, is checkpointed between periods. Contests are written once,
    partitioned by period, so each round reads its own period only.
    """
    spark = games.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/contests-{uuid.uuid4().hex}"
    period = F.trunc(F.col("ts").cast("date"), unit)
    _played(games, by).withColumn("period", period).hint("rebalance", "period").write.partitionBy("period").parquet(path)
    table = spark.read.parquet(path)
    state = spark.createDataFrame([], T.StructType([games.schema[k] for k in by] + list(_fields("rating", "rd", "volatility", first="team"))))
    shots = []
    for row in table.select("period").distinct().orderBy("period").collect():  # one row per calendar period
        now = table.where(F.col("period") == row["period"])
        h, a = F.col("home_score"), F.col("away_score")
        score = F.when(h > a, 1.0).when(h == a, 0.5).otherwise(0.0)
        log = now.select(*by, "contest_id", F.explode(F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_id").alias("team"), F.col("away_id").alias("opp"), score.alias("score")),
            F.struct(F.lit("away").alias("side"), F.col("away_id").alias("team"), F.col("home_id").alias("opp"), (1.0 - score).alias("score")))).alias("v")).select(*by, "contest_id", "v.*")
        mine = state.select(*by, "team", "rating", "rd")
        theirs = state.select(*by, F.col("team").alias("opp"), F.col("rating").alias("o_rating"), F.col("rd").alias("o_rd"))
        rated = log.join(mine, [*by, "team"], "left").join(theirs, [*by, "opp"], "left").fillna(
            {"rating": glicko.RATING, "rd": glicko.RD, "o_rating": glicko.RATING, "o_rd": glicko.RD})
        mu, mu_o = ((F.col(c) - glicko.RATING) / GLICKO_SCALE for c in ("rating", "o_rating"))
        phi_o = F.col("o_rd") / GLICKO_SCALE
        e, g = glicko_expected(mu, mu_o, phi_o), glicko_g(phi_o)
        sums = rated.groupBy(*by, "team").agg(F.sum(g * g * e * (1 - e)).alias("v_inverse"), F.sum(g * (F.col("score") - e)).alias("gain"))
        merged = state.join(sums, [*by, "team"], "full").fillna(
            {"rating": glicko.RATING, "rd": glicko.RD, "volatility": glicko.VOLATILITY, "v_inverse": 0.0, "gain": 0.0})
        shots.append(cut(rated.groupBy(*by, "contest_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in ("rating", "rd")])))
        state = cut(merged.select(*state.columns, "v_inverse", "gain").mapInPandas(_update_batches, state.schema))
    return reduce(DataFrame.unionByName, shots), state


def glicko_chances(df: DataFrame, draw_share: float = 0.25) -> DataFrame:
    """Home / draw / away chances from a contest's two ratings."""
    mu, mu_o = ((F.col(c) - glicko.RATING) / GLICKO_SCALE for c in ("home_rating", "away_rating"))
    e = glicko_expected(mu, mu_o, F.col("away_rd") / GLICKO_SCALE)
    return df.select("*", *[c.alias(n) for n, c in three_way(e, draw_share).items()])


def rating_table(final: DataFrame, log: DataFrame, by: list[str], value: str) -> DataFrame:
    """Current ratings of every participant with contests played and last contest time."""
    seen = log.groupBy(*by, "team").agg(F.count(F.lit(1)).alias("played"), F.max("ts").alias("last_ts"))
    return final.join(seen, [*by, "team"]).select(*by, "team", value, "played", "last_ts")


def goal_grid(df: DataFrame, home: str, away: str, rho: float = 0.0, most: int = 8) -> DataFrame:
    """Home / draw / away chances from two Poisson means over a (most + 1)^2 score grid with the low-score correction."""
    lam, mu = F.col(home), F.col(away)
    fact = [float(np.prod(range(1, n + 1))) if n else 1.0 for n in range(most + 1)]
    ph = [F.exp(-lam) * F.pow(lam, F.lit(float(i))) / F.lit(fact[i]) for i in range(most + 1)]
    pa = [F.exp(-mu) * F.pow(mu, F.lit(float(j))) / F.lit(fact[j]) for j in range(most + 1)]
    corr = {(0, 0): 1 - lam * mu * F.lit(rho), (0, 1): 1 + lam * F.lit(rho), (1, 0): 1 + mu * F.lit(rho), (1, 1): F.lit(1.0 - rho)}
    src = df.select("*", F.array(*ph).alias("_h"), F.array(*pa).alias("_a"))
    total = {"w_home": F.lit(0.0), "w_draw": F.lit(0.0), "w_away": F.lit(0.0)}
    for i in range(most + 1):
        for j in range(most + 1):
            cell = F.col("_h")[i] * F.col("_a")[j]
            cell = cell * F.greatest(corr[(i, j)], F.lit(0.0)) if (i, j) in corr else cell
            side = "w_home" if i > j else "w_draw" if i == j else "w_away"
            total[side] = total[side] + cell
    wide = src.select(*df.columns, *[c.alias(n) for n, c in total.items()])
    whole = F.col("w_home") + F.col("w_draw") + F.col("w_away")
    return wide.select(*df.columns, *[(F.col(n) / whole).alias("p" + n[1:]) for n in total])
