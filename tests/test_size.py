"""Faults that show at size only, made small: long ledgers, crowded blocks of the league table, states in streams."""
import math
import re
from collections import defaultdict
from datetime import datetime, timedelta
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows_of
from touchline.operators import form as fm
from touchline.operators import learn as ln
from touchline.operators import rule_index as ri
from touchline.operators import rules as ru
from touchline.operators import standings as st
from touchline.operators.history import HOT_ROWS
from touchline.plans import catalog
from touchline.plans import matrix as mt
from touchline.plans import rule_queries as rq
from touchline.streaming import streams as sm
from touchline.streaming import timers as tm


def made_log(spark, n=400, teams=30):
    rng, rows = Random(5), []
    for k in range(n):
        a, b = rng.sample(range(teams), 2)
        pool = rng.choice(["x", "x", "y"])
        at = datetime(2020, 1, 1) + timedelta(hours=rng.randrange(30 * 24))
        p, q = rng.choice([(2, 0), (1, 1), (0, 0), (0, 3)])
        rows += [(k, at, pool, s, t, f, g, 3 if f > g else 1 if f == g else 0) for s, t, f, g in (("home", a, p, q), ("away", b, q, p))]
    return rows, spark.createDataFrame(rows, "contest_id long, ts timestamp_ntz, pool string, side string, team long, score int, score_ag int, pts int")


def tables_by_hand(rows, points_only):
    state, out = defaultdict(dict), {}
    games = defaultdict(list)
    for r in rows:
        games[r[1], r[0]].append(r)
    for key in sorted(games):
        for k, _, pool, _, team, *_ in games[key]:
            now = state[pool]
            held = {t: s for t, s in now.items() if s[0] > 0} if points_only else now
            order = sorted(held, key=lambda t: (*[-x for x in (held[t][:1] if points_only else held[t])], t))
            if not points_only and len(held) < 4:
                out[k, team] = (10.0, 0, 0)
            else:
                place = order.index(team) + 1 if team in held else len(held) + 1 if points_only else (len(held) + 1) / 2
                out[k, team] = (float(place), *(now.get(team, (0, 0)) if team in held else (0, 0))[:2])
        for _, _, pool, _, team, score, against, pts in games[key]:
            s = state[pool].get(team, (0, 0, 0))
            state[pool][team] = (s[0] + pts, s[1] + score - against, s[2] + score)
    return out


@pytest.mark.parametrize("points_only", [False, True])
@pytest.mark.parametrize("hot", [None, 10])
def test_standings_in_small_blocks(spark, points_only, hot):
    rows, log = made_log(spark)
    want = tables_by_hand(rows, points_only)
    if hot:
        spark.conf.set(HOT_ROWS, str(hot))
    try:
        got = st.standings_before(log, points_only, rows=40).collect()
    finally:
        spark.conf.unset(HOT_ROWS)
    assert {(r["contest_id"], r["team"]): (r["position"], r["table_pts"], r["table_gd"]) for r in got} == want and len(got) == len(rows)


def test_standings_shuffle_few_rows(spark):
    """States are copied into blocks of at least as many rows as the pool has teams, so the rows to sort are at most about twice the log."""
    rows, log = made_log(spark, 2000, 100)
    assert len(rows) < st._by_block(log, False, 1).count() <= 2.2 * len(rows)


def test_standings_without_a_pool(spark):
    """A contest of no pool is in no table; its rows stay."""
    rows, log = made_log(spark, 20, 4)
    got = st.standings_before(log.withColumn("pool", F.lit(None).cast("string"))).collect()
    assert len(got) == len(rows) and {(r["position"], r["table_pts"]) for r in got} == {(10.0, 0)}


def test_long_ledger_outgrows_doubles(spark, tmp_path):
    """6,300 wins carry the balance past the largest double: the fold goes on as the SQL does."""
    kinds = [*"F" * 6300, "P", "O", "F", "P"]
    at = datetime(1995, 1, 1)
    rows = [(149 + 150 * i, 1, s, 1.0, at + timedelta(hours=i), "1-URGENT") for i, s in enumerate(kinds)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("restake_fold", "current_balance", "rebalance_open"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        res = con.execute(catalog.ORACLES[name])
        got, cols = [tuple(r) for r in df.collect()], [d[0] for d in res.description]
        want = res.fetchall()
        assert sorted(cols) == sorted(df.columns) and rows_of(got, df.columns) == rows_of(want, cols)
        if name == "restake_fold":
            assert any(r[cols.index("bank_after")] == math.inf for r in want)
            nan = lambda x: x is not None and math.isnan(x)
            assert sum(nan(dict(zip(df.columns, r))["pnl"]) for r in got) == sum(nan(dict(zip(cols, r))["pnl"]) for r in want) > 0
            assert sum(dict(zip(df.columns, r))["pnl"] is None for r in got) == 2


def test_score_states_are_few(spark, tmp_path):
    """Contests share states: a batch of 3,000 contests calls Python for a bucket, not for a contest."""
    rows = [(k, p, s, 1, 0, datetime(2024, 1, 1) + timedelta(minutes=k % 500 + m)) for k in range(3000) for p, s, m in ((0, "1H", 0), (1, tm.FINISHED, 115))]
    schema = "contest_id long, priority int, status string, home_score long, away_score long, recorded_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = sm.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = (tm.score_events(feed).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= tm.BUCKETS < 3000


def test_status_changes_over_files(spark, tmp_path):
    """No Python worker gets a strategy as one group, and a file goes on from the last status of the file before."""
    rng, at = Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), at + timedelta(minutes=i // 2), i, float(rng.randrange(3))) for i in range(600)]
    for i in range(3):
        spark.createDataFrame(rows[i * 200:(i + 1) * 200], "strategy string, ts timestamp, id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = sm.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, per_batch=1)
    got = sm.status_changes(feed, lambda x: x.map({0.0: "low", 1.0: "mid", 2.0: "high"}), f"{tmp_path}/work").collect()
    want, held = set(), {}
    for key, _, id_, value in rows:
        status = ["low", "mid", "high"][int(value)]
        if held.get(key) != status:
            want.add((key, id_, status, held.get(key)))
        held[key] = status
    assert {(r["strategy"], r["id"], r["status"], r["was"]) for r in got} == want and len(got) == len(want)


def plan_without_broadcast(spark, build):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df, df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_absences_leave_the_games_where_they_are(spark):
    games = spark.createDataFrame([(1, 10, 11), (2, 10, None), (3, 12, 12), (None, 10, 11), (4, 13, 14)], "contest_id long, home_id long, away_id long")
    reports = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (1, 99), (2, None), (2, 10), (3, 12), (None, 10), (5, 10)], "contest_id long, team long")
    got, plan = plan_without_broadcast(spark, lambda: fm.absences(games.repartition("contest_id"), reports))
    assert not re.search(r"hashpartitioning\(contest_id#\d+L?, (home|away)_id", plan)
    assert sorted((r["contest_id"] or 0, r["home_absent"], r["away_absent"], r["absent_diff"], r["home_any_absent"], r["away_any_absent"]) for r in got.collect()) == [
        (0, 0, 0, 0, 0, 0), (1, 2, 1, 1, 1, 1), (2, 1, 0, 1, 1, 0), (3, 1, 1, 0, 1, 1), (4, 0, 0, 0, 0, 0)]


def test_matrix_shuffles_lines_once_and_wide_rows_by_contest(spark, sf):
    _, plan = plan_without_broadcast(spark, lambda: mt.contest_matrix(spark, sf))
    assert "l_quantity" not in plan  # the lines of contests are read by the stored step alone
    assert not re.search(r"hashpartitioning\(contest_id#\d+L?, (home|away)_id", plan)


def goals_by_hand(games, scale, tolerance=1e-5):
    """The alternating margins over plain dictionaries."""
    last = max(g[0] for g in games)
    rows = [(t, o, at, math.exp(-(last - d).days / scale), g) for d, h, a, hs, as_ in games for t, o, at, g in ((h, a, 1, hs), (a, h, 0, as_))]
    teams, home = {r[0] for r in rows}, 1.1
    att, dfn = dict.fromkeys(teams, 1.0), dict.fromkeys(teams, 1.0)
    for _ in range(500):
        was = {**{("a", t): x for t, x in att.items()}, **{("d", t): x for t, x in dfn.items()}, "home": home}
        f = lambda at: home if at else 1.0
        att = {t: max(sum(w * g for x, _, _, w, g in rows if x == t) / sum(w * dfn[o] * f(at) for x, o, at, w, _ in rows if x == t), 1e-3) for t in teams}
        mean = sum(att.values()) / len(att)
        att = {t: x / mean for t, x in att.items()}
        dfn = {t: max(sum(w * g for _, x, _, w, g in rows if x == t) / sum(w * att[o] * f(at) for o, x, at, w, _ in rows if x == t), 1e-3) for t in teams}
        home = sum(w * g for _, _, at, w, g in rows if at) / sum(w * att[t] * dfn[o] for t, o, at, w, _ in rows if at)
        now = {**{("a", t): x for t, x in att.items()}, **{("d", t): x for t, x in dfn.items()}, "home": home}
        if max(abs(now[k] - was[k]) for k in now) < tolerance:
            return att, dfn, home


def test_goal_rounds_leave_the_pairs_in_place(spark, monkeypatch):
    rng = Random(3)
    games = [(datetime(2020, 1, 1) + timedelta(days=rng.randrange(300)), *rng.sample(range(14), 2), rng.randrange(4), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame([*games, (datetime(2020, 1, 5), None, 3, 1, 1)], "ts timestamp_ntz, home_id long, away_id long, home_score int, away_score int")
    seen, step = [], ln._pair_sums

    def watched(pairs, *rest):
        seen.append((pairs.select("cell").distinct().count(), pairs.groupBy("cell").cogroup(pairs.limit(1).groupBy("cell")).applyInPandas(lambda a, b: a, pairs.schema)) if not seen else None)
        return step(pairs, *rest)
    monkeypatch.setattr(ln, "_pair_sums", watched)
    params, home = ln.goal_strengths(df, 200.0, 1e-5, 500, cell_rows=40)
    cells, placed = seen[0]
    assert cells > 4
    left = placed._jdf.queryExecution().executedPlan().toString().split("\n   +- ")[0]
    assert "Exchange hashpartitioning(cell" not in left
    att, dfn, want = goals_by_hand(games, 200.0)
    got = {r["team"]: (r["attack"], r["defence"]) for r in params.collect()}
    assert home == pytest.approx(want, rel=1e-6) and got.keys() == att.keys()
    assert all(got[t] == pytest.approx((att[t], dfn[t]), rel=1e-6) for t in att)


def test_goal_rounds_move_an_array_a_block(spark, monkeypatch):
    """Pairs lie packed, a row a cell, and what a round starts from has a size that Spark knows."""
    rng = Random(4)
    games = [(datetime(2020, 1, 1), *rng.sample(["a", "b", "c", "d", "e", "f", None], 2), rng.choice([0, 1, 2, None]), 1) for _ in range(80)]
    df = spark.createDataFrame(games, "ts timestamp_ntz, home_id string, away_id string, home_score int, away_score int")
    seen, step = [], ln._pair_sums

    def watched(pairs, sides, values, *rest):
        seen.append((pairs.count() == pairs.select("cell").distinct().count(), int(str(values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()))
        return step(pairs, sides, values, *rest)
    monkeypatch.setattr(ln, "_pair_sums", watched)
    params, _ = ln.goal_strengths(df, tolerance=0.01, cell_rows=20)
    assert all(packed and bits < 64 for packed, bits in seen) and len(seen) > 4
    assert sorted(r["team"] for r in params.collect()) == list("abcdef")


def test_rules_are_matched_by_steps_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(ri, "ROWS", 20)
    monkeypatch.setattr(ri, "CHUNK", 7)
    rng = Random(11)
    draw = lambda *few: rng.choice([None, *few])
    cands = [(rng.choice("xy"), rng.choice([1.5, 2.0, 2.5, None]), draw(0.1, 0.5, 0.9), draw(1.0, 2.0), draw(1), 2 ** 53 + rng.randrange(9)) for _ in range(300)]
    rules = [(g, f"{g}{k}", lo, lo + rng.choice([0.0, 0.5, 1.0]), draw(0.2, 0.5), draw(1.0, 1.5)) for g in "xyz" for k, lo in enumerate(rng.choices([1.5, 1.8, 2.0], k=30))]
    left = spark.createDataFrame(cands, "g string, odds double, a double, b double, won long, big long")
    right = spark.createDataFrame(rules, "g string, rule string, lo double, hi double, min_a double, max_b double")
    got = ri.match_index(left, right, ["g"], {"a": "min_a"}, {"b": "max_b"}, {"n": F.count(F.lit(1)), "won": F.sum("won"), "big": F.max("big")}, block=8)
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    summed = {}
    for g, odds, a, b, won, big in cands:  # totals of candidates that agree in everything the rules see
        if odds is not None:
            key = (g, odds, 0 if a is None else sum(x <= a for x in sorted({r[4] for r in rules if r[0] == g} - {None})), 0 if b is None else sum(x >= b for x in {r[5] for r in rules if r[0] == g} - {None}))
            n, w, m, *_ = summed.get(key, (0, None, 0))
            summed[key] = (n + 1, w if won is None else (w or 0) + won, max(m, big), a, b)
    for (g, odds, _, _), (n, w, m, a, b) in summed.items():
        for rg, rule, lo, hi, mina, maxb in rules:
            if rg == g and lo <= odds <= hi and (mina is None or (a is not None and a >= mina)) and (maxb is None or (b is not None and b <= maxb)):
                x, y, z = want.get((g, rule), (0, None, 0))
                want[g, rule] = (x + n, y if w is None else (y or 0) + w, z + m)
    rows = {(r["g"], r["rule"]): (r["n"], r["won"], r["big"]) for r in got.collect()}
    # prices between the same bounds share a segment, so only the sums that do not hang on it are compared one by one
    assert {k: v[:2] for k, v in rows.items()} == {k: v[:2] for k, v in want.items()} and len(rows) > 20


@pytest.mark.parametrize("name", ["scaled_scores", "weight_sweep"])
def test_variant_scores_are_compiled(spark, sf, name):
    """The JVM interprets methods of more than 8,000 bytes, which took most of the time on large tables."""
    df = catalog.QUERIES[name](spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) > 10 and max(sizes) < 8000


def test_packed_factors_score_like_names(spark):
    """Factors as bits, as names (in any order, twice, unknown or NULL) and added up by hand give the same scores of both sides."""
    rng, columns = Random(7), list(ru.DEFAULTS)
    rows = [(k, *[rng.choice([None, d - 60, d - 4, d - 0.3, d, d + 0.3, d + 4, d + 60, d - 150, d + 150]) for d in ru.DEFAULTS.values()]) for k in range(200)] + [(200, *[None] * len(columns))]
    m = ru.with_defaults(spark.createDataFrame(rows, "contest_id long, " + ", ".join(f"{c} double" for c in columns)))
    both = {kind: m.select("contest_id", *[ru.active_factors(s, kind == "bits").alias(s) for s in ("home", "away")]) for kind in ("names", "bits")}
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("active")) for s in ("home", "away")])).alias("v")
    forms = {kind: df.select("contest_id", sides).select("contest_id", "v.*") for kind, df in both.items()}
    forms["odd names"] = forms["names"].withColumn("active", F.concat(F.reverse("active"), "active", F.array(F.lit("unknown"), F.lit(None))))
    scores = {kind: {(r["contest_id"], r["side"], r["variant"]): r["score"] for r in ru.scaled_scores(df, rq.VARIANTS, rq.OVERRIDES).collect()} for kind, df in forms.items()}
    held = {(r["contest_id"], r["side"]): set(r["active"]) for r in forms["names"].collect()}
    want = {(*key, v): sum(rq.OVERRIDES.get(v, {}).get(n, w) * rq.VARIANTS.get(v, {}).get(g, 1.0) for s, n, _, w, g in ru.FACTORS if n in names)
            for key, names in held.items() for v in {**rq.VARIANTS, **rq.OVERRIDES}}
    assert {n for names in held.values() for n in names} == {n for _, n, *_ in ru.FACTORS}
    assert all(got == want for got in scores.values())
    empty = forms["names"].withColumn("active", F.lit(None).cast("array<string>"))
    assert {r["score"] for r in ru.scaled_scores(empty, rq.VARIANTS, rq.OVERRIDES).collect()} == {0.0}
