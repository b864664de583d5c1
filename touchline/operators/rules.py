"""Factor scores, rule parsing and matching, rule statistics, picks and overlap."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import elo_expected, expected_value, kelly_fraction, rnd, wilson
from touchline.operators.factor_table import DEFAULTS, EV_TIERS, FACTORS, LABELS
from touchline.operators.ledger import first_rows
from touchline.operators.metrics import hit_aggs, hit_rates


# ---- factor scores ---------------------------------------------------------------------------------------------------

def with_defaults(matrix: DataFrame) -> DataFrame:
    """Every feature a factor reads: missing columns and NULLs take the default."""
    have = set(matrix.columns)
    return matrix.select(*[c for c in matrix.columns if c not in DEFAULTS],
                         *[(F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in DEFAULTS.items()])


def active_factors(side: str, packed: bool = False) -> Column:
    """Names of the factors that hold for a side. packed: the same set as a struct of bits, home and away, bit i being the i-th factor of that side.

    Both are array functions, which Spark evaluates outside its whole-stage methods and so compiles in pieces. The conditions written as one sum would share a method with the joins before them,
    and the JVM interprets methods of more than 8,000 bytes.
    """
    if not packed:
        return F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for s, name, cond, _, _ in FACTORS if s == side]))
    none = F.lit(0).cast("bigint")
    held = [F.coalesce(F.expr(cond), F.lit(False)) for s, _, cond, _, _ in FACTORS if s == side]
    bits = F.aggregate(F.array(*reversed(held)), none, lambda word, x: F.shiftleft(word, 1).bitwiseOR(x.cast("bigint")))
    return F.struct(*[(bits if s == side else none).alias(s) for s in ("home", "away")])


def score(side: str, subset: set[str] | None = None) -> Column:
    """Sum of the weights of the factors that hold (optionally of a named subset)."""
    total = F.lit(0)
    for s, name, cond, weight, _ in FACTORS:
        if s == side and (subset is None or name in subset):
            total = total + F.when(F.expr(cond), int(weight)).otherwise(0)
    return total


def weighted_scores(matrix: DataFrame) -> DataFrame:
    return with_defaults(matrix).select("*", score("home").alias("score_home"), score("away").alias("score_away"))


def minimum_ev(score_col: Column | str) -> Column:
    """Tiered minimum expected value; NULL below the lowest tier."""
    s = F.col(score_col) if isinstance(score_col, str) else score_col
    out = F.lit(None).cast("double")
    for at_least, ev in sorted(EV_TIERS):
        out = F.when(s >= at_least, F.lit(ev)).otherwise(out)
    return out


# The conditions of a scenario seen from one side; `other` is the opponent, `lead` the rating lead of the side, `market` its least market chance.
_SCENARIO = ("market_{side}_prob > {market}", "{side}_form_points > 0.55", "{other}_form_points < 0.45", "{lead} > 50",
             "{side}_xg_for_avg_10 > {other}_xg_against_avg_10", "{side}_rest_days >= 5", "{other}_injured_count > {side}_injured_count", "{lead} > 25")
SCENARIO = {side: [c.format(side=side, other=other, lead=lead, market=market) for c in _SCENARIO]
            for side, other, lead, market in (("home", "away", "elo_diff", 0.50), ("away", "home", "-elo_diff", 0.38))}


def scenario_count(side: str) -> Column:
    return sum((F.expr(c).cast("int") for c in SCENARIO[side]), F.lit(0))


def gap_picks(scored: DataFrame, gap: int = 70, lo: float = 2.0, hi: float = 4.0, fraction: float = 0.25, cap: float = 0.04) -> DataFrame:
    """The side with the dominant score, if it leads by `gap` and its price is in range; chance from the ratings."""
    home = F.col("score_home") >= F.col("score_away")
    e = elo_expected("home_elo", "away_elo")
    rows = scored.select("*", F.when(home, "home").otherwise("away").alias("side"), F.abs(F.col("score_home") - F.col("score_away")).alias("gap"),
                         F.when(home, F.col("home_odds")).otherwise(F.col("away_odds")).alias("odds"), F.when(home, e).otherwise(1 - e).alias("prob"))
    rows = rows.where((F.col("gap") >= gap) & F.col("odds").between(lo, hi))
    return rows.select("*", expected_value("prob", "odds").alias("ev"), F.least(kelly_fraction("prob", "odds", fraction), F.lit(cap)).alias("kelly"))


def tier_picks(scored: DataFrame, min_odds: float = 1.5, fraction: float = 0.25, cap: float = 0.04) -> DataFrame:
    """Best side per contest by expected value, gated by the score's tier. Needs p_home / p_away and prices."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"score_{s}").alias("score"), F.col(f"p_{s}").alias("prob"), F.col(f"{s}_odds").alias("odds"))
                                for s in ("home", "away")])).alias("v")
    rows = scored.select("contest_id", sides).select("contest_id", "v.*").withColumn("ev", expected_value("prob", "odds"))
    rows = rows.where((F.col("odds") >= min_odds) & (F.col("ev") >= minimum_ev("score")))
    best = first_rows(rows, ["contest_id"], [F.col("ev").desc(), F.col("side")])
    return best.withColumn("kelly", F.least(kelly_fraction("prob", "odds", fraction), F.lit(cap)))


def _held(active: DataFrame, names: list[str]) -> Column:
    """How many of the named factors of one side a row has, as a double; `active` holds names or bits."""
    if isinstance(active.schema["active"].dataType, T.ArrayType):
        return sum((F.when(F.array_contains("active", F.lit(n)), 1.0).otherwise(0.0) for n in names), F.lit(0.0))
    side = next(s for s, name, *_ in FACTORS if name == names[0])
    order = [name for s, name, *_ in FACTORS if s == side]
    return F.bit_count(F.col(f"active.{side}").bitwiseAND(F.lit(sum(1 << order.index(n) for n in names)).cast("bigint"))).cast("double")


def scaled_scores(active: DataFrame, variants: dict[str, dict[str, float]], overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Scores of (contest, side) under weight variants: group multipliers and / or replaced weights.

    active(contest_id, side, active): group sums are read off the row's own factors once, variants combine
    them; there is no join and no shuffle. Factor names differ between the sides. With packed factors a group's factors of
    equal weight are counted at once, which keeps the step short enough to be compiled.
    """
    overrides = overrides or {}
    changed = {n for new in overrides.values() for n in new}
    known = {name: (float(weight), group) for _, name, _, weight, group in FACTORS}
    alike: dict[tuple, list[str]] = {}
    for side, name, _, weight, group in FACTORS:
        if name not in changed:
            alike.setdefault((group, side, float(weight)), []).append(name)
    groups: dict[str, Column] = {}
    for (group, _, weight), names in alike.items():
        groups[group] = groups.get(group, F.lit(0.0)) + _held(active, names) * weight
    keep = [c for c in active.columns if c != "active"]
    sums = active.select(*keep, *[c.alias(f"_g_{g}") for g, c in groups.items()], *[_held(active, [n]).alias(f"_f_{n}") for n in sorted(changed)])
    scores = []
    for v in sorted({*variants, *overrides}):
        mult, new = variants.get(v, {}), overrides.get(v, {})
        total = sum((F.col(f"_g_{g}") * float(mult.get(g, 1.0)) for g in groups), F.lit(0.0))
        for n in sorted(changed):
            weight, group = known[n]
            total = total + F.col(f"_f_{n}") * (float(new.get(n, weight)) * float(mult.get(group, 1.0)))
        scores.append(F.struct(F.lit(v).alias("variant"), total.alias("score")))
    return sums.select(*keep, F.explode(F.array(*scores)).alias("v")).select(*keep, "v.*")


# ---- rule strings ----------------------------------------------------------------------------------------------------

def parse_rules(df: DataFrame, text: str = "rule") -> DataFrame:
    """side[lo,hi) label op value ... to typed columns; the text column itself is the rule id.

    Percent values of pa and pos are taken as fractions. `understood` is false when a token is unknown, has
    the wrong operator, or the head does not fit.
    """
    t = F.trim(F.col(text))
    head = r"^(home|away)\[([0-9.]+),([0-9.]+)\)"
    tokens = F.filter(F.split(F.regexp_replace(t, head, ""), r"\s+"), lambda x: x != "")
    known = "|".join(f"{label}{op}" for label, (_, op) in LABELS.items())
    cols = {}
    for label, (col, op) in LABELS.items():
        value = F.nullif(F.regexp_extract(t, rf"(?:^|\s){label}{op}([0-9.]+)(?=\s|$)", 1), F.lit("")).try_cast("double")
        if label in ("pa", "pos"):
            value = F.when(value > 1.5, value / 100.0).otherwise(value)
        cols[col] = value
    ok = F.regexp_like(t, F.lit(head)) & F.forall(tokens, lambda x: F.regexp_like(x, F.lit(f"^({known})[0-9.]+$")))
    return df.select("*", F.nullif(F.regexp_extract(t, head, 1), F.lit("")).alias("side"),
                     F.nullif(F.regexp_extract(t, head, 2), F.lit("")).try_cast("double").alias("lo"),
                     F.nullif(F.regexp_extract(t, head, 3), F.lit("")).try_cast("double").alias("hi"),
                     *[c.alias(n) for n, c in cols.items()], ok.alias("understood"))


SHORT = {"xg": ("xg", ">="), "elo_ge": ("elo", ">="), "elo_le": ("elo", "<="), "form": ("form", ">="), "mkt": ("mkt", ">=")}


def parse_short_rules(df: DataFrame, text: str = "rule") -> DataFrame:
    """The five-threshold grammar: side[lo,hi) xg>= elo>= elo<= form>= mkt>=."""
    t = F.trim(F.col(text))
    head = r"^(home|away)\[([0-9.]+),([0-9.]+)\)"
    cols = [F.nullif(F.regexp_extract(t, rf"(?:^|\s){label}{op}(-?[0-9.]+)", 1), F.lit("")).try_cast("double").alias(name)
            for name, (label, op) in SHORT.items()]
    return df.select("*", F.regexp_extract(t, head, 1).alias("side"), F.regexp_extract(t, head, 2).cast("double").alias("lo"),
                     F.regexp_extract(t, head, 3).cast("double").alias("hi"), *cols)


def rule_text(side: str = "side", lo: str = "lo", hi: str = "hi", thresholds: dict[str, tuple[str, str]] | None = None) -> Column:
    """Render a rule id from its thresholds, skipping NULLs: column -> (label, operator)."""
    thresholds = thresholds or SHORT_TEXT
    head = F.concat(F.col(side), F.lit("["), F.col(lo).cast("string"), F.lit(","), F.col(hi).cast("string"), F.lit(")"))
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(label + op), F.col(c).cast("string"))) for c, (label, op) in thresholds.items()]
    return F.concat_ws(" ", head, *parts)


SHORT_TEXT = SHORT


# ---- matching --------------------------------------------------------------------------------------------------------

def match_rules(cands: DataFrame, rules: DataFrame, at_least: dict[str, str], at_most: dict[str, str], closed: bool = False,
                on: tuple[str, ...] = ("league", "side")) -> DataFrame:
    """Pairs of candidate and matching rule. An active threshold fails on a missing feature.

    The join is keyed on league and side; thresholds are residual conditions. Rules are a short listed table:
    Spark broadcasts it by its own size estimate and falls back to a shuffled join.
    """
    r = rules.select(*on, "rule", "lo", "hi", *[F.col(t).alias(f"_t_{t}") for t in (*at_least.values(), *at_most.values())],
                     *[c for c in rules.columns if c not in {*on, "rule", "lo", "hi", *at_least.values(), *at_most.values()}])
    top = F.col("odds") <= F.col("hi") if closed else F.col("odds") < F.col("hi")
    cond = (F.col("odds") >= F.col("lo")) & top
    for feats, ge in ((at_least, True), (at_most, False)):
        for t, f in ((t, f) for f, t in feats.items()):
            lim = F.col(f"_t_{t}")
            cond = cond & (lim.isNull() | F.coalesce((F.col(f) >= lim) if ge else (F.col(f) <= lim), F.lit(False)))
    return cands.join(r, list(on)).where(cond).drop(*[f"_t_{t}" for t in (*at_least.values(), *at_most.values())])


def rule_stats(matches: DataFrame, by: list[str], cutoff: str, min_n: int = 3) -> DataFrame:
    """In-sample hit rate before the cutoff (NULL under min_n rows) with its lower bound, and out-of-sample diagnostics."""
    early = F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")
    got = matches.groupBy(*by).agg(
        F.count(F.when(early, 1)).alias("n_is"), F.sum(F.when(early, F.col("won"))).alias("w_is"), F.avg(F.when(early, F.col("odds"))).alias("avg_odds"),
        F.count(F.when(~early, 1)).alias("n_oos"), F.sum(F.when(~early, F.col("won"))).alias("w_oos"))
    enough = F.col("n_is") >= min_n
    return got.select(*by, "n_is", F.when(enough, F.col("w_is") / F.col("n_is")).alias("p_is"), F.when(enough, wilson("w_is", "n_is")).alias("lower"), "avg_odds",
                      "n_oos", F.when(F.col("n_oos") > 0, F.col("w_oos") / F.nullif(F.col("n_oos"), F.lit(0))).alias("p_oos"))


def lower_bound_ok(lower: Column, odds: Column) -> Column:
    """Admit only strictly positive expected value at the lower bound; missing parts reject."""
    return F.coalesce(lower * odds - 1.0 > 0, F.lit(False))


# Rows needed, falls of the hit rate, the lower bound that saves a rule, the tolerance of a stable one.
RECENCY = {"rows": 5, "rates": 3, "fall": -0.15, "dip": -0.05, "bound": 0.55, "steady": 0.03}


def recency_verdict(matches: DataFrame, by: list[str], cutoff: str) -> DataFrame:
    """Whole-history against recent hit rate with a verdict code per rule: thin, unknown, unpaid (no value at the lower bound), lost, fading, steady or lower."""
    lim = RECENCY
    late = F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")

    def block(tag: str, cond: Column) -> list[Column]:
        return [F.count(F.when(cond, 1)).alias(f"{tag}_n"), F.sum(F.when(cond, F.col("won"))).alias(f"_{tag}_w")]

    got = matches.groupBy(*by).agg(*block("full", F.lit(True)), *block("recent", late), F.avg("odds").alias("avg_odds"))
    for tag in ("full", "recent"):
        n, w = F.col(f"{tag}_n"), F.col(f"_{tag}_w")
        got = got.withColumn(f"{tag}_p", F.when(n >= lim["rates"], w / F.nullif(n, F.lit(0)))).withColumn(
            f"{tag}_lower", F.when(n > 0, wilson(f"_{tag}_w", F.nullif(n, F.lit(0)))).otherwise(0.0)).drop(f"_{tag}_w")
    got = got.withColumn("drift", F.nullif(F.col("recent_p"), F.lit(0.0)) - F.nullif(F.col("full_p"), F.lit(0.0)))
    exposed = F.col("recent_lower") < lim["bound"]
    codes = {"thin": F.col("recent_n") < lim["rows"], "unknown": F.col("drift").isNull(), "unpaid": ~lower_bound_ok(F.col("full_lower"), F.col("avg_odds")),
             "lost": exposed & (F.col("drift") < lim["fall"]), "fading": exposed & (F.col("drift") < lim["dip"]), "steady": F.col("recent_p") >= F.col("full_p") - lim["steady"]}
    return got.withColumn("verdict", F.coalesce(*[F.when(cond, code) for code, cond in codes.items()], F.lit("lower")))


def efficiency_score(stats: DataFrame, years: float) -> DataFrame:
    """Bets and units per year, conservative units by the lower-bound value, halved when unstable."""
    per = F.col("n") / F.lit(years)
    careful = per * F.col("lower_ev")
    return stats.select("*", rnd(per, 2).alias("bets_per_year"), rnd(per * F.col("roi"), 3).alias("annual_units"), rnd(careful, 3).alias("annual_units_low"),
                        rnd(rnd(careful, 3) * F.when(F.col("stable"), 1.0).otherwise(0.5), 3).alias("efficiency"))


def best_rule_picks(matches: DataFrame, prob: str, rank: str, fraction: float = 0.25, cap: float = 0.04) -> DataFrame:
    """One rule per contest: highest `rank` among those with positive expected value and stake."""
    rows = matches.select("*", expected_value(prob, "odds").alias("ev"), F.least(kelly_fraction(prob, "odds", fraction), F.lit(cap)).alias("kelly"))
    rows = rows.where((F.col("ev") > 0) & (F.col("kelly") > 0))
    return first_rows(rows, ["contest_id"], [F.col(rank).desc(), F.col("rule")])


def threshold_picks(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Side picks of scored contests under per-league limits; leagues without limits give none.

    Both sides are tested; the better margin over the market wins.
    """
    rows = scored.join(limits, "league")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"p_{s}").alias("prob"), F.col(f"{s}_odds").alias("odds"), F.col(f"mkt_p_{s}").alias("market"))
                                for s in ("home", "away")])).alias("v")
    flat = rows.select("contest_id", "league", "ts", "result", "p_draw", "max_draw", "min_bet", "min_edge", "odds_lo", "odds_hi", sides).select(
        "contest_id", "league", "ts", "result", "p_draw", "max_draw", "min_bet", "min_edge", "odds_lo", "odds_hi", "v.*").withColumn("margin", F.col("prob") - F.col("market"))
    ok = (F.col("p_draw") < F.col("max_draw")) & (F.col("prob") > F.col("min_bet")) & F.col("odds").between(F.col("odds_lo"), F.col("odds_hi")) & (F.col("margin") > F.col("min_edge"))
    best = first_rows(flat.where(ok), ["contest_id"], [F.col("margin").desc(), F.col("side").desc()])
    won = F.when(F.col("side") == "home", F.col("result") == "H").otherwise(F.col("result") == "A").cast("int")
    return best.select("contest_id", "league", "ts", "side", "prob", "odds", "margin", won.alias("won"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two strategies' picks side by side: both, only one, and whether they agree on the side."""
    left = a.select("contest_id", F.col("side").alias("side_a"), F.col("won").alias("won_a"), F.col("odds").alias("odds_a"))
    right = b.select("contest_id", F.col("side").alias("side_b"), F.col("won").alias("won_b"), F.col("odds").alias("odds_b"))
    both = left.join(right, "contest_id", "full")
    kind = (F.when(F.col("side_a").isNull(), "only_b").when(F.col("side_b").isNull(), "only_a")
            .when(F.col("side_a") == F.col("side_b"), "agree").otherwise("differ"))
    rows = both.select(kind.alias("kind"), F.coalesce("won_a", "won_b").alias("won"), F.coalesce("odds_a", "odds_b").alias("odds"))
    return hit_rates(rows.groupBy("kind").agg(*hit_aggs()))


# ---- overlap ---------------------------------------------------------------------------------------------------------

def signatures(members: DataFrame, group: list[str], rule: str = "rule", member: str = "contest_id", extra: list[Column] = ()) -> DataFrame:
    """Members counted by the set of rules they belong to. A member's set is bounded by the number of rules."""
    sets = members.groupBy(*group, member).agg(F.array_sort(F.collect_set(rule)).alias("rules"), *extra)
    return sets


def overlap_pairs(members: DataFrame, group: list[str], rule: str = "rule", member: str = "contest_id") -> DataFrame:
    """Shared members, Jaccard index and coverage of every overlapping rule pair.

    Members are first counted by rule set; pairs come from the sets, so a popular member costs no more
    than its set.
    """
    sets = signatures(members, group, rule, member).groupBy(*group, "rules").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("rules", lambda a: F.transform(F.filter("rules", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    per = sets.select(*group, "n", F.explode(pairs).alias("p")).groupBy(*group, "p.a", "p.b").agg(F.sum("n").alias("shared"))
    size = per.where("a = b").select(*group, F.col("a").alias("r"), F.col("shared").alias("size"))
    out = (per.where("a <> b").join(size.select(*group, F.col("r").alias("a"), F.col("size").alias("size_a")), [*group, "a"])
           .join(size.select(*group, F.col("r").alias("b"), F.col("size").alias("size_b")), [*group, "b"]))
    return out.select(*group, "a", "b", "shared", "size_a", "size_b", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"),
                      (F.col("shared") / F.least("size_a", "size_b")).alias("coverage"))


def greedy_dedup(rules: DataFrame, pairs: DataFrame, group: list[str], rank: str, limit: float = 0.85, measure: str = "jaccard") -> DataFrame:
    """Keep rules from the best down, dropping one that overlaps an already kept rule beyond `limit`.

    Ordered by nature; it runs on the rule list of one group (bounded by the rule grid, not by data rows).
    """
    close = pairs.where(F.col(measure) > limit)
    near = (close.select(*group, F.col("a").alias("rule"), F.col("b").alias("other"))
            .unionByName(close.select(*group, F.col("b").alias("rule"), F.col("a").alias("other")))
            .groupBy(*group, "rule").agg(F.collect_list("other").alias("near")))
    listed = rules.join(near, [*group, "rule"], "left").select(*group, "rule", rank, "near")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set[str] = set()
        for rule, near_ in pdf.sort_values([rank, "rule"], ascending=[False, True])[["rule", "near"]].itertuples(index=False):
            if near_ is None or not kept.intersection(near_):
                kept.add(rule)
        return pdf[pdf["rule"].isin(kept)].drop(columns=["near"])

    schema = listed.drop("near").schema
    return listed.groupBy(*group).applyInPandas(keep, schema)


def unique_members(members: DataFrame, group: list[str]) -> DataFrame:
    """Per rule: members no other rule has against shared ones, with the unit return of each part."""
    unit = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(F.lit(-1.0))
    sets = signatures(members, group, extra=[F.max(unit).alias("unit")])
    rows = sets.select(*group, F.explode("rules").alias("rule"), F.size("rules").alias("holders"), "unit")
    alone = F.col("holders") == 1
    return rows.groupBy(*group, "rule").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(alone, 1)).alias("n_unique"), F.avg("unit").alias("roi"),
                                            F.avg(F.when(alone, F.col("unit"))).alias("roi_unique"), F.avg(F.when(~alone, F.col("unit"))).alias("roi_shared"))


def covering(pairs: DataFrame, group: list[str], limit: float = 0.5) -> DataFrame:
    """Rules ranked by how many others they cover to at least `limit`."""
    both = (pairs.select(*group, F.col("a").alias("rule"), (F.col("shared") / F.col("size_b")).alias("c"))
            .unionByName(pairs.select(*group, F.col("b").alias("rule"), (F.col("shared") / F.col("size_a")).alias("c"))))
    return both.where(F.col("c") >= limit).groupBy(*group, "rule").agg(F.count(F.lit(1)).alias("covers"))
