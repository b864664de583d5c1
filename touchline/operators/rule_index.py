"""Matching of large rule tables: price segments as the join key, and one bitmap of satisfied rules per threshold rank."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.prefix import same
from touchline.session import stored

#: Rules of one index row; its bitmaps have as many bits.
BLOCK = 4096
#: Candidates (of different ranks) of a task at most, and of a step in it.
ROWS, CHUNK = 200_000, 512


def _segments(rules: DataFrame, on: list[str]) -> DataFrame:
    """The price bounds of a group's rules in order; a table of one row a group."""
    bounds = F.explode(F.array("lo", "hi")).alias("x")
    return rules.select(*on, bounds).where("x IS NOT NULL").groupBy(*on).agg(F.sort_array(F.collect_set("x")).alias("edges"))


def _place(edges: str, value: Column) -> Column:
    """Elementary segment of a price: 2 i + 1 for the i-th bound itself, 2 i between bounds i - 1 and i."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return 2 * below + F.exists(edges, lambda e: e == value).cast("int")


def index_rules(rules: DataFrame, on: list[str], at_least: dict[str, str], at_most: dict[str, str], closed: bool, block: int = BLOCK) -> DataFrame:
    """One row per (group, segment, block): the block's rules, for each feature its different thresholds in order, and for each rank a bitmap of the rules it satisfies.

    A rule stands in every elementary segment its price range covers. Thresholds not used (NULL) are satisfied by every rank. A missing feature has rank 0, which satisfies only
    rules without that threshold.
    """
    feats = [*at_least.items(), *at_most.items()]
    split = rules.join(_segments(rules, on), on)
    last = _place("edges", F.col("hi")) - (0 if closed else 1)
    covered = split.where("lo <= hi").withColumn("segment", F.explode(F.sequence(_place("edges", F.col("lo")), F.greatest(last, _place("edges", F.col("lo"))))))
    covered = covered.where(F.lit(True) if closed else F.col("lo") < F.col("hi"))
    number = F.row_number().over(W.partitionBy(*on, "segment").orderBy("rule")) - 1
    placed = covered.withColumn("block", F.floor(number / block).cast("int")).select(*on, "segment", "block", "rule", *[F.col(t).cast("double").alias(f"t{i}") for i, (_, t) in enumerate(feats)])
    kinds = ", ".join(f"`{c}` {rules.schema[c].dataType.simpleString()}" for c in on)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rule", ignore_index=True)
        n = len(part)
        limits, maps = [], []
        for i, (_, t) in enumerate(feats):
            lim = part[f"t{i}"].to_numpy(dtype=float)
            levels = np.unique(lim[~np.isnan(lim)])
            levels = levels if i < len(at_least) else levels[::-1]  # in the order in which they are passed
            limits.append(levels.tolist())
            rank = np.where(np.isnan(lim), 0, 1 + np.argmax(lim[:, None] == levels[None, :], axis=1) if len(levels) else 0)
            maps.append([_words(rank <= r, n) for r in range(len(levels) + 1)])
        one = {c: [part[c].iat[0]] for c in (*on, "segment", "block")}
        return pd.DataFrame({**one, "rules": [part["rule"].tolist()], "limits": [limits], "maps": [maps]})

    return placed.groupBy(*on, "segment", "block").applyInPandas(
        build, f"{kinds}, segment int, block int, rules array<string>, limits array<array<double>>, maps array<array<array<bigint>>>")


def _words(bits: np.ndarray, n: int) -> list[int]:
    padded = np.zeros(-(-n // 64) * 64, np.uint8)
    padded[:n] = bits
    return np.packbits(padded, bitorder="little").view(np.int64).tolist()


def match_index(cands: DataFrame, rules: DataFrame, on: list[str], at_least: dict[str, str], at_most: dict[str, str], totals: dict[str, Column], closed: bool = True, block: int = BLOCK) -> DataFrame:
    """Totals over the candidates that each rule matches: (group, rule, totals). Rules without a match have no row.

    cands has the group columns, odds and the features; rules has rule, lo, hi and the threshold columns; at_least and at_most map a feature to its threshold column.
    totals are sums (COUNT and SUM aggregates) over candidates. Candidates that agree in segment and in the rank of every feature match the same rules, so they are summed up first: what meets the rules
    is bounded by the grid, not by the candidates. A rule matches where the bitmaps of all features have its bit; numpy tests a step of candidates against a block of rules at once. A (group, segment) of
    many candidates is split over tasks, each with all its rules.
    """
    feats = [*at_least.items(), *at_most.items()]
    index = index_rules(rules, on, at_least, at_most, closed, block)
    edges = _segments(rules, on)
    names = list(totals)
    levels = rules.groupBy(*on).agg(*[F.sort_array(F.collect_set(F.col(t).cast("double"))).alias(f"_l{i}") for i, (_, t) in enumerate(feats)])
    known = cands.join(edges, on).join(levels, on).where("odds IS NOT NULL")
    ranks = [_rank(f"_l{i}", f, i < len(at_least)) for i, (f, _) in enumerate(feats)]
    segment = _place("edges", F.col("odds")).alias("segment")
    summed = known.select("*", segment, *[r.alias(f"_r{i}") for i, r in enumerate(ranks)]).groupBy(*on, "segment", *[f"_r{i}" for i in range(len(feats))]).agg(
        *[c.alias(n) for n, c in totals.items()])
    summed = stored(summed)
    most = summed.groupBy(*on, "segment").count().agg(F.max("count").alias("n")).first()["n"] or 0
    parts = -(-most // ROWS) or 1
    part = F.pmod(F.xxhash64(*[f"_r{i}" for i in range(len(feats))]), F.lit(parts)).alias("part")
    lists = F.array(*[f"_l{i}" for i in range(len(feats))]).alias("levels")
    spread = same(index, levels.select(*on, lists), on).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = spread.select(*on, "segment", F.col("part").cast("long").alias("part"), "rules", "limits", "maps", "levels")
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*[(c, rules.schema[c].dataType.simpleString()) for c in (*on, "rule")], *[(n, summed.schema[n].dataType.simpleString()) for n in names]])
    by = [*on, "segment", "part"]
    rows = summed.select("*", part).groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(_matcher(on, names, len(feats), len(at_least)), kinds)
    return rows.groupBy(*on, "rule").agg(*[F.sum(n).alias(n) for n in names])


def _matcher(on: list[str], names: list[str], feats: int, at_least: int):
    """The step on some candidates of a (group, segment) and all its blocks of rules: totals over the candidates that each rule matches."""
    def match(cands: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        ranks = [cands[f"_r{i}"].to_numpy(dtype=np.int64) for i in range(feats)]
        for b in blocks.itertuples() if len(cands) else ():
            n, tables = len(b.rules), []
            for i in range(feats):
                own, every = np.asarray(b.limits[i], float), np.asarray(b.levels[i], float)
                passed = [0, *[int(np.sum(own <= x if i < at_least else own >= x)) for x in (every if i < at_least else every[::-1])]]
                tables.append(np.array([b.maps[i][r] for r in passed], dtype=np.int64))
            hits, sums = np.zeros(n, np.int64), {c: np.zeros(n, np.int64 if pd.api.types.is_integer_dtype(cands[c]) else float) for c in names}
            known = {c: np.zeros(n, np.int64) for c in names}
            for at in range(0, len(cands), CHUNK):
                cut = slice(at, at + CHUNK)
                words = tables[0][ranks[0][cut]]
                for t, r in zip(tables[1:], ranks[1:]):
                    words &= t[r[cut]]
                some = np.flatnonzero(words.any(axis=1))
                bits = np.unpackbits(words[some].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(float)
                hits += bits.sum(axis=0).astype(np.int64)
                for c in names:
                    col = cands[c].iloc[cut].iloc[some]
                    here = col.notna().to_numpy()
                    value = col.fillna(0).to_numpy()
                    exact = value.dtype.kind == "i" and np.abs(value.astype(float)).sum() >= 2 ** 53  # whole numbers too large for the sum in doubles
                    got = value @ bits.astype(np.int64) if exact else value.astype(float) @ bits
                    sums[c] += got.astype(sums[c].dtype)
                    known[c] += (here.astype(float) @ bits).astype(np.int64)
            met = np.flatnonzero(hits)
            out = pd.DataFrame({"rule": [b.rules[k] for k in met]})
            for c in names:
                out[c] = pd.Series(sums[c][met], dtype=object).where(known[c][met] > 0, None)
            found.append(out.assign(**{c: cands[c].iat[0] for c in on}))
        return pd.concat(found)[[*on, "rule", *names]].astype(object) if found else pd.DataFrame(columns=[*on, "rule", *names])

    return match


def _rank(levels: str, feature: str, ge: bool) -> Column:
    """How many of the group's thresholds a feature satisfies; a missing one none."""
    return F.when(F.col(feature).isNull(), 0).otherwise(F.size(F.filter(levels, lambda x: (x <= F.col(feature)) if ge else (x >= F.col(feature)))))
