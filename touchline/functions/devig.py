"""Turning three-way prices into chances: proportional and insider-share (Shin) margin removal."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("home", "draw", "away")


def _inverse(home: str, draw: str, away: str) -> list[Column]:
    return [F.when(F.col(c) > 0, F.lit(1.0) / F.col(c)) for c in (home, draw, away)]


def proportional(home: str = "home_odds", draw: str = "draw_odds", away: str = "away_odds") -> dict[str, Column]:
    q = _inverse(home, draw, away)
    total = q[0] + q[1] + q[2]
    return {f"p_{s}": x / total for s, x in zip(SIDES, q)}


def overround(home: str = "home_odds", draw: str = "draw_odds", away: str = "away_odds") -> Column:
    q = _inverse(home, draw, away)
    return q[0] + q[1] + q[2] - F.lit(1.0)


def market_features(home: str = "home_odds", draw: str = "draw_odds", away: str = "away_odds") -> dict[str, Column]:
    p = proportional(home, draw, away)
    return p | {"overround": overround(home, draw, away), "certainty": F.greatest(p["p_home"], p["p_away"]),
                "home_edge": p["p_home"] - p["p_away"]}


def _shin_sum(z: Column, q: list[Column], total: Column) -> Column:
    parts = [(F.sqrt(z * z + F.lit(4.0) * (F.lit(1.0) - z) * x * x / total) - z) / (F.lit(2.0) * (F.lit(1.0) - z)) for x in q]
    return parts[0] + parts[1] + parts[2]


def shin(df: DataFrame, prefix: str = "mkt_", home: str = "home_odds", draw: str = "draw_odds", away: str = "away_odds", steps: int = 8) -> DataFrame:
    """Insider share z in [1e-6, 0.5] for which the chances sum to one; else proportional.

    The sum is one where sum(sqrt(z^2 + 4 (1 - z) q^2 / Q)) = 2 + z. The left side minus the right is convex
    and falls through the root, so Newton steps from the left end rise to it without overshooting; eight reach double
    precision. Each step is one projection, compiled with its neighbours into one stage.
    """
    q = _inverse(home, draw, away)
    total = q[0] + q[1] + q[2]
    out = df.withColumns({"_q0": q[0], "_q1": q[1], "_q2": q[2], "_qs": total})
    out = out.withColumns({f"_c{i}": F.lit(4.0) * F.col(f"_q{i}") * F.col(f"_q{i}") / F.col("_qs") for i in range(3)}).withColumn("_z", F.lit(1e-6))
    z = F.col("_z")
    for _ in range(steps):
        out = out.withColumns({f"_r{i}": F.sqrt(z * z + F.col(f"_c{i}") * (F.lit(1.0) - z)) for i in range(3)})
        height = F.col("_r0") + F.col("_r1") + F.col("_r2") - F.lit(2.0) - z
        slope = sum(((z - F.col(f"_c{i}") / F.lit(2.0)) / F.col(f"_r{i}") for i in range(3)), F.lit(-1.0))
        out = out.withColumn("_z", z - height / slope)
    qs, whole = [F.col(f"_q{i}") for i in range(3)], F.col("_qs")
    bracketed = (whole > 1.0) & (_shin_sum(F.lit(1e-6), qs, whole) > 1.0) & (_shin_sum(F.lit(0.5), qs, whole) < 1.0)
    found = {f"{prefix}p_{s}": F.when(bracketed, (F.sqrt(z * z + F.col(f"_c{i}") * (F.lit(1.0) - z)) - z) / (F.lit(2.0) * (F.lit(1.0) - z)))
             .otherwise(F.col(f"_q{i}") / whole) for i, s in enumerate(SIDES)}
    return out.withColumns(found).drop("_qs", "_z", *[f"_{n}{i}" for n in "qcr" for i in range(3)])


def plain(df: DataFrame, prefix: str = "mkt_") -> DataFrame:
    return df.withColumns({prefix + n: c for n, c in proportional().items()})


METHODS = {"proportional": plain, "shin": shin}


def with_probs(df: DataFrame, method="proportional", prefix: str = "mkt_") -> DataFrame:
    """Add home / draw / away chances by a registered method name or any (DataFrame, prefix) -> DataFrame."""
    return (METHODS[method] if isinstance(method, str) else method)(df, prefix)
