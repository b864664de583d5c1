"""Threshold sweeps by level cubes.

Thresholds of a dimension tighten step by step, so a row meets a grid point exactly when its level
(how many steps it meets) reaches the point's level in every dimension. Rows are counted into level
cells once (map-side); only cells are spread over the grid points they meet. The cost is rows + cells x grid.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import rnd, wilson
from touchline.operators.metrics import hit_aggs, hit_rates


@dataclass(frozen=True)
class Dim:
    """One sweep dimension: steps from loosest to tightest. With free=True level 0 means "no filter" and is a
    grid value of its own (reported as NULL); otherwise a row must meet at least the first step."""
    name: str
    value: Column
    steps: tuple[float, ...]
    op: str = ">="
    free: bool = True

    def level(self) -> Column:
        tests = {">=": lambda s: self.value >= s, ">": lambda s: self.value > s, "<=": lambda s: self.value <= s, "<": lambda s: self.value < s}
        return sum((F.coalesce(tests[self.op](F.lit(float(s))), F.lit(False)).cast("int") for s in self.steps), F.lit(0))

    def step(self, level: Column) -> Column:
        return F.when(level > 0, F.element_at(F.array(*[F.lit(float(s)) for s in self.steps]), F.greatest(level, F.lit(1))))


def in_ranges(df: DataFrame, value: str, ranges: list[tuple[float, float]], closed: bool = False) -> DataFrame:
    """One row per (row, overlapping range it lies in): columns lo, hi."""
    v = F.col(value)
    hits = F.array_compact(F.array(*[F.when((v >= lo) & ((v <= hi) if closed else (v < hi)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in ranges]))
    return df.select("*", F.explode(hits).alias("_r")).select(*df.columns, "_r.lo", "_r.hi")


def cells(df: DataFrame, by: list[str], dims: list[Dim], levels: dict[str, Column] | None = None) -> DataFrame:
    """Hit-rate parts per (by, level of every dimension)."""
    levels = levels or {}
    at = [levels.get(d.name, d.level()).cast("int").alias(f"l_{d.name}") for d in dims]
    return df.select(*by, *at, "won", "odds").groupBy(*by, *[f"l_{d.name}" for d in dims]).agg(*hit_aggs())


def spread(cube: DataFrame, by: list[str], dims: list[Dim]) -> DataFrame:
    """Cells to grid points: dimension after dimension, summed after each so the table stays as small as the grid."""
    sums = [F.sum(c).alias(c) for c in ("n", "wins", "sum_odds", "payout")]
    names = [f"l_{d.name}" for d in dims]
    out = cube
    for d in dims:
        c = f"l_{d.name}"
        low = 0 if d.free else 1
        steps = F.when(F.col(c) >= low, F.sequence(F.lit(low), F.col(c))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(c, F.explode(steps)).groupBy(*by, *names).agg(*sums)
    return out


def sweep(df: DataFrame, by: list[str], dims: list[Dim], min_n: int = 1, levels: dict[str, Column] | None = None, named: bool = True) -> DataFrame:
    """Hit-rate block of every grid point with at least `min_n` rows."""
    points = hit_rates(spread(cells(df, by, dims, levels), by, dims).where(F.col("n") >= min_n))
    if not named:
        return points
    return points.select(*by, *[d.step(F.col(f"l_{d.name}")).alias(d.name) for d in dims], *[c for c in points.columns if c not in by and not c.startswith("l_")])


# The rule grid and its price ranges.
ODDS_RANGES = [(1.30, 1.55), (1.55, 1.80), (1.70, 2.00), (1.80, 2.20), (2.00, 2.50), (2.20, 2.80), (2.50, 3.50)]
XG_STEPS, FORM_STEPS = (1.0, 1.2, 1.5, 1.8), (1.5, 1.8, 2.2)
ELO_STEPS = (30, 75, 150)
MKT_STEPS = {"home": (0.45, 0.50, 0.55), "away": (0.35, 0.40, 0.45)}


def rule_grid(df: DataFrame, by: list[str], min_n: int = 3) -> DataFrame:
    """The exhaustive rule grid per (by, side, price range): 5 x 4 x 4 x 4 points each.

    elo is the home side's lead; an away rule asks for at most -step. Levels are kept as l_* columns.
    """
    home = F.col("side") == "home"
    lead = F.when(home, F.col("elo")).otherwise(-F.col("elo"))
    dims = [Dim("xg", F.col("xg"), XG_STEPS), Dim("elo", lead, ELO_STEPS), Dim("form", F.col("form"), FORM_STEPS), Dim("mkt", F.col("mkt"), MKT_STEPS["home"])]
    mkt = F.when(home, Dim("mkt", F.col("mkt"), MKT_STEPS["home"]).level()).otherwise(Dim("mkt", F.col("mkt"), MKT_STEPS["away"]).level())
    keys = [*by, "side", "lo", "hi"]
    return sweep(in_ranges(df, "odds", ODDS_RANGES), keys, dims, min_n, {"mkt": mkt}, named=False)


GRID_KEYS = ["league", "side", "lo", "hi", "l_xg", "l_elo", "l_form", "l_mkt"]


def window_stability(windows: DataFrame, keys: list[str] = GRID_KEYS, min_total: int = 10, min_windows: int = 4) -> DataFrame:
    """Mean window return, share of positive windows and a class per rule; thin rules are left out."""
    roi = rnd(F.col("roi") * 100, 1)
    got = windows.groupBy(*keys).agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_windows"), F.count(F.when(roi > 0, 1)).alias("n_positive"),
        F.avg(roi).alias("avg_roi"), F.avg(F.col("win_rate")).alias("avg_win_rate"), F.avg("avg_odds").alias("avg_odds"))
    share = F.col("n_positive") / F.col("n_windows")
    kind = (F.when((F.col("avg_roi") > 0) & (share >= 0.6), "stable").when((F.col("avg_roi") > 0) & (share >= 0.4), "moderate")
            .when(F.col("avg_roi") <= 0, "losing").otherwise("weak"))
    return got.where((F.col("n_total") >= min_total) & (F.col("n_windows") >= min_windows)).withColumn("share_positive", share).withColumn("kind", kind)


def drop_subsumed(rules: DataFrame, group: list[str], levels: list[str], score: str) -> DataFrame:
    """Drop a rule when a looser-or-equal rule of its group scores at least as well (ties: the looser, then the
    smaller levels). The self-join is over the rule table of one group, bounded by the grid."""
    other = rules.select(*group, *[F.col(c).alias(f"o_{c}") for c in (*levels, score)])
    looser, same = F.lit(True), F.lit(True)
    for c in levels:
        looser = looser & (F.col(f"o_{c}") <= F.col(c))
        same = same & (F.col(f"o_{c}") == F.col(c))
    cond = looser & ~same & (F.col(f"o_{score}") >= F.col(score))
    for g in group:
        cond = cond & (rules[g] == other[g])
    return rules.join(other, cond, "left_anti")


def fold_selection(cube_by_month: DataFrame, folds: DataFrame, keys: list[str], min_train: int, min_roi: float) -> DataFrame:
    """Rules kept in a fold when their training count and return pass, with that fold's test metrics.

    folds(month-level rows already spread over fold and role) carry the additive hit-rate parts.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "wins", "sum_odds", "payout")]
    per = hit_rates(folds.groupBy(*keys, "fold", "role").agg(*sums))
    train = per.where((F.col("role") == "train") & (F.col("n") >= min_train) & (rnd("roi") > min_roi)).select(*keys, "fold", F.col("n").alias("train_n"), F.col("roi").alias("train_roi"))
    test = per.where(F.col("role") == "test").select(*keys, "fold", F.col("n").alias("test_n"), F.col("roi").alias("test_roi"))
    return train.join(test, [*keys, "fold"])


def fold_stability(selected: DataFrame, keys: list[str], min_positive: int = 3, volume: float = 8.0) -> DataFrame:
    got = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.count(F.when(F.col("test_roi") > 0, 1)).alias("positive"), F.avg("test_n").alias("avg_test_n"),
                                      F.avg("test_roi").alias("avg_test_roi"))
    return got.where(F.col("positive") >= min_positive).withColumn("volume", F.when(F.col("avg_test_n") >= volume, "high").otherwise("low"))


def _sized(layer: str, k: int) -> Column:
    return F.transform(layer, lambda c: F.struct(c["combo"].alias("combo"), F.lit(k).alias("k")))


def factor_combos(df: DataFrame, by: list[str], flags: dict[str, tuple[str, Column]], most: int = 3, min_n: int = 10) -> DataFrame:
    """Combinations of up to `most` factors of distinct columns with their hit-rate block.

    flags: name -> (column, condition). Rows are first counted by the set of factors they meet; the
    combinations come from the sets by array functions.
    """
    met = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("f"), F.lit(c).alias("c"))) for n, (c, cond) in sorted(flags.items())]))
    sets = df.select(*by, "won", "odds", met.alias("met")).groupBy(*by, "met").agg(*hit_aggs())
    sums = ("n", "wins", "sum_odds", "payout")
    rows = sets.withColumn("k1", F.transform("met", lambda x: F.struct(x["f"].alias("combo"), x["f"].alias("last"), F.array(x["c"]).alias("cols"))))
    for k in range(2, most + 1):
        grown = F.transform(f"k{k - 1}", lambda c: F.transform(
            F.filter("met", lambda x: (x["f"] > c["last"]) & ~F.array_contains(c["cols"], x["c"])),
            lambda x: F.struct(F.concat_ws("; ", c["combo"], x["f"]).alias("combo"), x["f"].alias("last"), F.array_append(c["cols"], x["c"]).alias("cols"))))
        rows = rows.withColumn(f"k{k}", F.flatten(grown))
    none = F.array(F.struct(F.lit("").alias("combo"), F.lit(0).alias("k")))
    every = F.concat(none, *[_sized(f"k{k}", k) for k in range(1, most + 1)])
    per = rows.select(*by, *sums, F.explode(every).alias("c")).groupBy(*by, "c.combo", "c.k").agg(*[F.sum(c).alias(c) for c in sums])
    return hit_rates(per.where(F.col("n") >= min_n))


# Grids over scored contests.
MAX_DRAW = (0.35, 0.32, 0.30, 0.28, 0.25)
MIN_BET = (0.50, 0.55, 0.60, 0.62, 0.65, 0.68, 0.70, 0.72)
MIN_EDGE = (0.00, 0.03, 0.05, 0.08, 0.10, 0.12, 0.15, 0.20)
LEAGUE_MIN_BET = (0.55, 0.60, 0.62, 0.65, 0.68, 0.70, 0.72)
LEAGUE_MIN_EDGE = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20)
ODDS_LO, ODDS_HI = (1.40, 1.50, 1.60), (3.50, 3.00, 2.50)
YEARS = 32 / 12.0
GATES = {"n": 12, "win_rate": 0.55, "roi": 0.05, "lower": 0.40}


def favoured_side(scored: DataFrame) -> DataFrame:
    """The likelier of home and away with its chance, price, market edge and outcome (needs mkt_p_*)."""
    home = F.col("p_home") >= F.col("p_away")

    def pick(h: str, a: str) -> Column:
        return F.when(home, F.col(h)).otherwise(F.col(a))
    won = F.when(home, F.col("result") == "H").otherwise(F.col("result") == "A").cast("int")
    return scored.select("*", F.when(home, "home").otherwise("away").alias("side"), pick("p_home", "p_away").alias("p_side"), pick("home_odds", "away_odds").alias("odds"),
                         (pick("p_home", "p_away") - pick("mkt_p_home", "mkt_p_away")).alias("edge"), won.alias("won"))


def scored_sweep(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Draw-cap x confidence x edge grid on prices in [1.5, 3.0]."""
    dims = [Dim("max_draw", F.col("p_draw"), MAX_DRAW, "<", False), Dim("min_bet", F.col("p_side"), MIN_BET, ">", False), Dim("min_edge", F.col("edge"), MIN_EDGE, ">", False)]
    got = sweep(rows.where(F.col("odds").between(1.5, 3.0)), list(by), dims)
    return got.withColumn("lower", wilson("wins", "n"))


def league_sweep(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per-league grid with price bounds; only viable points, with yearly units."""
    dims = [Dim("max_draw", F.col("p_draw"), MAX_DRAW, "<", False), Dim("min_bet", F.col("p_side"), LEAGUE_MIN_BET, ">", False), Dim("min_edge", F.col("edge"), LEAGUE_MIN_EDGE, ">", False),
            Dim("odds_lo", F.col("odds"), ODDS_LO, ">=", False), Dim("odds_hi", F.col("odds"), ODDS_HI, "<=", False)]
    got = sweep(rows, by, dims, GATES["n"]).withColumn("lower", wilson("wins", "n")).withColumn("annual_units", F.col("n") / YEARS * F.col("roi"))
    return got.where((F.col("win_rate") >= GATES["win_rate"]) & (F.col("roi") >= GATES["roi"]) & (F.col("lower") >= GATES["lower"]))
