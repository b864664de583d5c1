"""Small hand-made cases."""
import datetime as dt
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import devig, glicko
from touchline.functions import scalars as sc
from touchline.operators import form as fm
from touchline.operators import quotes as qt
from touchline.operators import ratings as rt
from touchline.operators import resolve
from touchline.operators import rules as ru
from touchline.sources import ledger_import, merge, payloads
from touchline.sources import tables as tb


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@pytest.fixture(scope="module")
def games(spark):
    rows = [(1, 1, 2, 2, 1, "2024-01-01"), (2, 3, 1, 0, 0, "2024-01-08"), (3, 1, 4, 1, 3, "2024-01-15"), (4, 2, 1, 1, 2, "2024-01-22"), (5, 1, 5, 3, 0, "2024-01-29"),
            (90, 1, 9, 0, 0, "2024-02-05"), (91, 8, 9, 0, 0, "2023-12-31")]
    return ntz(spark.createDataFrame(rows, "contest_id long, home_id long, away_id long, home_score int, away_score int, ts string"), "ts").withColumn("pool", F.lit("a"))


def participant(games):
    from touchline.plans.views import participant_log
    return participant_log(games)


def test_form_uses_only_earlier_contests(games):
    got = {(r["contest_id"], r["team"]): r for r in fm.form(participant(games), hot=[]).collect()}
    assert got[(3, 1)]["points"] == pytest.approx(4 / 6)
    assert got[(90, 1)]["goals_for"] == pytest.approx(1.6)
    first = got[(91, 8)]
    assert (first["points"], first["goals_for"], first["wins"], first["draws"]) == (0.5, 1.3, 0.33, 0.25)


def test_rest_days_default_and_cap(spark, games):
    late = ntz(spark.createDataFrame([(99, 1, 7, 1, 0, "2024-03-10")], "contest_id long, home_id long, away_id long, home_score int, away_score int, ts string"), "ts").withColumn("pool", F.lit("a"))
    got = {(r["contest_id"], r["team"]): r["rest"] for r in fm.rest_days(participant(games.unionByName(late)), hot=[]).collect()}
    assert (got[(90, 1)], got[(99, 1)], got[(99, 7)]) == (7, 30, 7)


def test_xg_ratio_and_overperformance(spark):
    rows = [(1, 1, 2, 2, 1, 1.8, 0.9, "2024-01-01"), (2, 3, 1, 0, 0, 0.7, 0.5, "2024-01-08"), (3, 1, 4, 1, 3, None, None, "2024-01-15"), (4, 1, 5, 1, 1, 1.0, 1.0, "2024-01-20")]
    g = ntz(spark.createDataFrame(rows, "contest_id long, home_id long, away_id long, home_score int, away_score int, home_xg double, away_xg double, ts string"), "ts").withColumn("pool", F.lit("a"))
    from touchline.plans.views import participant_log
    got = {(r["contest_id"], r["team"]): r for r in fm.xg_history(participant_log(g, ["score", "xg"]), hot=[]).collect()}
    row = got[(4, 1)]
    assert row["xg_for_5"] == pytest.approx((1.8 + 0.5) / 2) and row["xg_against_5"] == pytest.approx((0.9 + 0.7) / 2)
    assert row["xg_ratio_5"] == pytest.approx(1.15 / 0.8) and row["xg_over"] == pytest.approx((0.2 - 0.5) / 2)


def test_streak_is_broken_by_a_draw(games):
    got = {(r["contest_id"], r["team"]): r for r in fm.result_streaks(participant(games), hot=[]).collect()}
    assert (got[(3, 1)]["win_streak"], got[(4, 1)]["loss_streak"], got[(90, 1)]["win_streak"]) == (0, 1, 2)


def test_elo(spark, games):
    one = spark.range(1).select(sc.elo_expected(F.lit(1500.0), F.lit(1500.0)).alias("e"), sc.elo_after(F.lit(1400.0), F.lit(1600.0), F.lit(1.0)).alias("upset"),
                                sc.elo_after(F.lit(1600.0), F.lit(1400.0), F.lit(1.0)).alias("usual")).first()
    assert one["e"] == 0.5 and one["upset"] - 1400 > one["usual"] - 1600
    shots, final = rt.elo_fold(games, ["pool"])
    by = {r["contest_id"]: r for r in shots.collect()}
    assert (by[1]["home_elo"], by[1]["away_elo"]) == (1500, 1500) and by[3]["home_elo"] != 1500
    total = final.agg(F.sum("elo").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert total["s"] == pytest.approx(1500 * total["n"])


def test_glicko_published_example():
    mu = lambda r: (r - 1500) / sc.GLICKO_SCALE
    opp = np.array([[1400, 30], [1550, 100], [1700, 300]], dtype=float)
    phi = opp[:, 1] / sc.GLICKO_SCALE
    g, e = glicko.spread(phi), glicko.expected(mu(1500), mu(opp[:, 0]), phi)
    r, d, s = glicko.update([1500], [200], [0.06], [(g * g * e * (1 - e)).sum()], [(g * (np.array([1, 0, 0]) - e)).sum()])
    assert r[0] == pytest.approx(1464.05, abs=0.02) and d[0] == pytest.approx(151.52, abs=0.01) and s[0] == pytest.approx(0.059996, abs=1e-6)


def test_glicko_idle_period_widens(spark):
    r, d, s = glicko.update([1600], [50], [0.06], [0.0], [0.0])
    assert (r[0], s[0]) == (1600, 0.06) and d[0] == pytest.approx(math.hypot(50 / sc.GLICKO_SCALE, 0.06) * sc.GLICKO_SCALE)


def test_period_of_one_contest_equals_fold(spark):
    rows = [(1, 1, 2, 2, 1, "2020-03-01"), (2, 1, 2, 0, 0, "2021-03-01"), (3, 2, 1, 4, 1, "2022-03-01")]
    g = ntz(spark.createDataFrame(rows, "contest_id long, home_id long, away_id long, home_score int, away_score int, ts string"), "ts").withColumn("pool", F.lit("a"))
    a = {r["team"]: r for r in rt.glicko_fold(g, ["pool"])[1].collect()}
    b = {r["team"]: r for r in rt.glicko_periods(g, ["pool"], "year")[1].collect()}
    for t in (1, 2):
        assert a[t]["rating"] == pytest.approx(b[t]["rating"]) and a[t]["rd"] == pytest.approx(b[t]["rd"]) and a[t]["volatility"] == pytest.approx(b[t]["volatility"])


QUOTE = "contest_id long, source string, outcome string, price double, opening double, recorded_at string, is_closing boolean, snap_id long, snap_no int, raw double"


def quote_rows(spark, rows):
    return ntz(spark.createDataFrame([(*r, i, 0, 0.0) for i, r in enumerate(rows)], QUOTE), "recorded_at")


def test_best_price(spark):
    at = "2024-01-01 10:00:00"
    rows = [(1, s, o, p, None, at, c) for s, ps, c in (("Bet365", (1.80, 3.40, 3.80), False), ("Pinnacle", (1.85, 3.30, 3.95), False), ("William Hill", (1.78, 3.50, 3.70), False), ("x", (1.0, 0.5, 9.0), True))
            for o, p in zip(("home", "draw", "away"), ps)]
    q = quote_rows(spark, rows)
    assert tuple(qt.best_price(q).first())[1:] == (1.85, 3.50, 3.95)
    assert tuple(qt.best_price(q, True).first())[1:] == (None, None, 9.0)
    assert tuple(qt.best_price(q, None).first())[1:] == (1.85, 3.50, 9.0)
    assert qt.closing_preferred(q).count() == 0


def test_line_movement_cases(spark):
    def snaps(book, prices, cid):
        return [(cid, book, "home", p, None, f"2024-01-01 1{i // 2}:{'00' if i % 2 == 0 else '30'}:00", False) for i, p in enumerate(prices)]
    rows = (snaps("a", (1.95, 2.00, 2.10), 1) + snaps("b", (1.97, 2.05, 2.12), 1) + snaps("a", (2.10, 2.00, 1.90), 2) + snaps("a", (1.5, 1.5, 1.5), 3) + snaps("b", (2.5, 2.5, 2.5), 3))
    m = {r["contest_id"]: r for r in qt.line_movement(quote_rows(spark, rows)).collect()}
    assert m[1]["drift"] > 0.05 and (m[1]["n_snaps"], m[1]["n_sources"]) == (3, 2)
    assert m[2]["drift"] < 0 and m[2]["dispersion"] is None and m[2]["n_sources"] == 1
    assert m[3]["dispersion"] == pytest.approx(0.25)
    gate = {r["contest_id"]: r["reason"] for r in qt.movement_gate(qt.line_movement(quote_rows(spark, rows))).collect()}
    assert gate == {1: "drift", 2: None, 3: "dispersion"}
    off = qt.movement_gate(qt.line_movement(quote_rows(spark, rows)), on=False)
    assert off.where("skip").count() == 0


def test_devig_sums_to_one_and_shin_favours_favourites(spark):
    rows = spark.createDataFrame([(1, 1.5, 4.0, 8.0), (2, 2.2, 3.6, 4.2)], "contest_id int, home_odds double, draw_odds double, away_odds double")
    shin = devig.with_probs(rows, "shin").collect()
    prop = devig.with_probs(rows).collect()
    for s, p in zip(shin, prop):
        assert s["mkt_p_home"] + s["mkt_p_draw"] + s["mkt_p_away"] == pytest.approx(1.0) and p["mkt_p_home"] + p["mkt_p_draw"] + p["mkt_p_away"] == pytest.approx(1.0)
    assert shin[0]["mkt_p_home"] > prop[0]["mkt_p_home"] and shin[0]["mkt_p_away"] < prop[0]["mkt_p_away"]


@pytest.mark.parametrize("market,pick,h,a,want", [
    ("1x2", "Home", 2, 1, "win"), ("1X2 ", "draw", 2, 1, "loss"), ("total", "Over 2.5", 2, 1, "win"), ("total", "under 2", 1, 1, "loss"), ("total", "over", 1, 1, None),
    ("btts", "yes", 1, 1, "win"), ("btts", "no", 1, 1, "loss"), ("double_chance", "home/draw", 1, 1, "win"), ("double_chance", "2X", 2, 1, "loss"), ("double_chance", "12", 2, 1, "win"),
    ("handicap", "Home -1", 2, 1, "loss"), ("handicap", "away +0.5", 1, 1, "win"), ("handicap", "home x", 1, 1, None), ("corners", "over 9", 1, 1, None)])
def test_settlement(spark, market, pick, h, a, want):
    row = spark.createDataFrame([(market, pick, h, a)], "market string, pick string, h int, a int")
    assert row.select(sc.settle("market", "pick", "h", "a").alias("r")).first()["r"] == want


def test_profit_and_kelly(spark):
    r = spark.range(1).select(sc.profit(F.lit("win"), F.lit(10.0), F.lit(2.35)).alias("w"), sc.profit(F.lit("loss"), F.lit(10.0), F.lit(2.0)).alias("l"),
                              sc.kelly_fraction(F.lit(0.6), F.lit(2.0), 0.25).alias("k"), sc.kelly_fraction(F.lit(0.2), F.lit(2.0)).alias("z"), sc.kelly_fraction(F.lit(0.9), F.lit(1.0)).alias("b")).first()
    assert (r["w"], r["l"], r["z"], r["b"]) == (13.5, -10.0, 0.0, 0.0) and r["k"] == pytest.approx(0.05)


def test_rule_statistics_leave_later_rows_out(spark):
    rows = [(i, "2024-06-01", int(i % 10 < 7)) for i in range(200)] + [(i, "2025-10-01", int(i % 10 < 2)) for i in range(200, 400)]
    m = ntz(spark.createDataFrame(rows, "contest_id int, ts string, won int"), "ts").withColumns({"rule": F.lit("r"), "odds": F.lit(1.8)})
    r = ru.rule_stats(m, ["rule"], "2025-08-01").first()
    assert (r["n_is"], r["n_oos"]) == (200, 200) and 0.62 <= r["p_is"] <= 0.78 and 0.12 <= r["p_oos"] <= 0.28
    assert ru.rule_stats(m, ["rule"], "2100-01-01").first()["n_is"] == 400


@pytest.mark.parametrize("p,odds,want", [(0.6, 2.0, True), (0.5, 2.0, False), (0.4, 2.0, False), (None, 2.0, False), (0.6, None, False)])
def test_lower_bound_guard(spark, p, odds, want):
    row = spark.createDataFrame([(p, odds)], "p double, o double")
    assert row.select(ru.lower_bound_ok(F.col("p"), F.col("o")).alias("ok")).first()["ok"] is want


def test_rule_strings(spark):
    rows = spark.createDataFrame([("home[1.4,1.6) xd>=0.2 h2h>=0.5",), ("away[1.55,1.85) pa>=80 m<=0.60",), ("home[1.7,2.1) zz>=1",), ("draw[1,2)",), ("home[1.7,2.1) m>=0.5",)], "rule string")
    a, b, c, d, e = ru.parse_rules(rows).collect()
    assert (a["side"], a["lo"], a["hi"], a["min_xg_diff"], a["min_h2h_wr"], a["understood"]) == ("home", 1.4, 1.6, 0.2, 0.5, True)
    assert (b["min_pass_acc_10"], b["max_market_prob"]) == (0.8, 0.6)
    assert [c["understood"], d["understood"], e["understood"]] == [False, False, False]
    s = ru.parse_short_rules(spark.createDataFrame([("away[1.55,1.8) elo<=-150 form>=1.8",)], "rule string")).first()
    assert (s["elo_le"], s["elo_ge"], s["form"]) == (-150.0, None, 1.8)


def test_score_tiers_and_defaults(spark):
    row = spark.createDataFrame([(1, None)], "contest_id int, elo_diff double")
    r = ru.weighted_scores(row).first()
    assert (r["score_home"], r["score_away"]) == (1, 1)  # only the rested factor holds on defaults
    t = spark.createDataFrame([(x,) for x in (60, 75, 90, 100)], "s int").select(ru.minimum_ev("s").alias("e")).collect()
    assert [x["e"] for x in t] == [None, 0.165, 0.12, 0.10]


def test_quote_payload(spark):
    raw = ('{"data":[{"bookmakerName":"B","odds":[{"marketName":"Match Winner","odds":[{"name":"Home","value":"1.9","openingValue":"2.0"},{"name":"Away","value":"bad"}]},'
           '{"marketName":"Corners","odds":[{"name":"Over","value":"1.5"}]},{"marketName":"Double Chance","odds":[{"name":"Home/Draw","value":"1.2"},{"name":"odd","value":"2"}]}]},{"bookmakerName":"","odds":[]},{"bookmakerName":"E"}]}')
    rows = {tuple(r) for r in payloads.quote_rows(spark.createDataFrame([(raw,)], "raw string")).select("market", "source", "outcome", "price", "opening").collect()}
    assert rows == {("1x2", "B", "home", 1.9, 2.0), ("double_chance", "B", "1X", 1.2, None)}


def test_lineup_payload(spark):
    raw = '[{"team":{"id":5},"formation":"4-4-2","startXI":[{"player":{"id":1}},{"player":{}},{"player":{"id":3}}]},{"team":{"id":6},"startXI":[]},{"team":{},"startXI":[{"player":{"id":1}}]}]'
    rows = payloads.lineup_rows(spark.createDataFrame([(raw,)], "raw string")).collect()
    assert [(r["team"], r["formation"], r["starters"]) for r in rows] == [(5, "4-4-2", [1, 3])]


def test_ledger_import_from_csv_with_bom(spark, tmp_path):
    path = tmp_path / "bets.csv"
    path.write_text("Дата,Ліга,Сторона,Ставка_на,Проти,Коеф,Стейк_$,PnL_$,WIN/LOSS\n01.02.2025,L, Home ,A,B,2.1,10,11,✓\nsoon,L,away,C,D,2,10,-10,LOSS\n", encoding="utf-8-sig")
    raw = spark.read.option("header", True).csv(str(path))
    rows = ledger_import.import_rows(raw, "bets", "gap")
    r = rows.collect()
    assert len(r) == 1 and (r[0]["match_date"], r[0]["home_name"], r[0]["pick"], r[0]["result"], r[0]["odds"]) == (dt.date(2025, 2, 1), "A", "home", "win", 2.1)
    assert ledger_import.without_known(rows, rows).count() == 0


def test_files_round_trip(spark, sf, tmp_path):
    df = tb.read_table(spark, sf, "nation")
    tb.write_csv(df, f"{tmp_path}/c")
    tb.write_json(df, f"{tmp_path}/j")
    tb.write_features(df, f"{tmp_path}/p", ["n_regionkey"])
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, tb.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == want
    assert sorted(map(tuple, tb.read_json(spark, f"{tmp_path}/j", df.schema, multi_line=False).collect())) == want
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/p").select(*df.columns).collect())) == want


def test_upsert_keeps_what_is_not_updated(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, x double, opening string")
    new = spark.createDataFrame([(1, 5.0, "z", 1), (1, 6.0, "y", 2), (3, 9.0, "c", 1)], "k int, x double, opening string, seq int")
    got = sorted(map(tuple, merge.upsert(old, new, ["k"], ["seq"], ["x"]).collect()))
    assert got == [(1, 6.0, "a"), (2, 2.0, "b"), (3, 9.0, "c")]


def test_contest_resolution(spark):
    games = ntz(spark.createDataFrame([(1, "2025-01-01 15:00:00", 10, 11, 2, 0), (2, "2025-01-01 18:00:00", 12, 13, 1, 1), (4, "2025-01-01 18:00:00", 12, 13, None, None)],
                                      "contest_id long, ts string, home_id int, away_id int, home_score int, away_score int"), "ts")
    names = spark.createDataFrame([(10, "Manchester City FC"), (11, "Everton"), (12, "Leeds United"), (13, "Everton B"), (14, None), (15, "")], "id int, name string")
    aliases = spark.createDataFrame([("man city", "Manchester City"), ("MC", "X")], "alias string, name string")
    day = dt.date(2025, 1, 1)
    rows = spark.createDataFrame([(1, day, "Man City", "everton", 2, 1), (2, day, "Leeds Utd", "Everton", 1, 1), (3, dt.date(2025, 1, 2), "Leeds", "Everton", 1, 1), (5, day, None, "Everton", 1, 1),
                                  (6, day, "ed", "B", 1, 1), (7, day, "", "", 1, 1), (8, day, "zzz", "Everton", 1, 1)],
                                 "row_id int, day date, home string, away string, home_score int, away_score int")
    got = {r["row_id"]: (r["contest_id"], r["score_differs"]) for r in resolve.resolve_contests(rows, games, names, aliases).collect()}
    assert got == {1: (1, True), 2: (2, False), 6: (2, False)}


def test_containment_index_equals_all_pairs(spark):
    r = random.Random(3)
    names = [(i, "".join(r.choices("aAbBc ", k=r.randint(0, 9)))) for i in range(150)]
    words = sorted({"".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(60)})
    got = {tuple(x) for x in resolve.containing(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(names, "id int, name string")).collect()}
    assert got == {(w, i) for w in words for i, n in names if w in n.lower()}


def test_bucketed_merges_leave_other_files_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = merge.KeyedTable(spark, path, ["k"], 32)
    table.create(spark.createDataFrame([(i, float(i), "a") for i in range(500)], "k int, x double, opening string"))
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("part-*")}
    before = files()
    new = spark.createDataFrame([(7, 70.0, "z", 1), (7, 71.0, "y", 2), (900, 9.0, "c", 1)], "k int, x double, opening string, seq int")
    touched = table.upsert(new, ["seq"], ["x"])
    after = files()
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == before[f] for f in kept)
    rows = {r["k"]: (r["x"], r["opening"]) for r in table.read().collect()}
    assert len(rows) == 501 and rows[7] == (71.0, "a") and rows[900] == (9.0, "c") and rows[8] == (8.0, "a")
    table.replace(spark.createDataFrame([(7, 1.0, "p"), (7, 2.0, "q")], "k int, x double, opening string"))
    assert sorted(r["x"] for r in table.read().where("k = 7").collect()) == [1.0, 2.0]
    table.delete(table.read().where("k <> 8"))
    assert [r["k"] for r in table.read().collect()] == [8] and table.change(new.limit(0), lambda old, fresh: old) == []

