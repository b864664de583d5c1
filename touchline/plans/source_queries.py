"""Queries of the scan, payload and merge family. Payload texts are rendered from the tables themselves."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions.scalars import rnd
from touchline.operators import resolve as rs
from touchline.plans import views as v
from touchline.plans.registry import query
from touchline.plans.views import sql_rnd
from touchline.session import ensure_checkpoint_dir
from touchline.sources import ledger_import, merge, payloads
from touchline.sources import tables as tb
from touchline.sources.tables import read_table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'ft' ELSE 'Not Started' END"
_GAMES = f"""{v.CONTESTS_SQL}, g AS (SELECT c.*, {_STATUS} AS status FROM contests c JOIN orders ON o_orderkey = contest_id)"""


def with_status(spark, sf, measures=("score",)):
    status = F.when(F.col("o_orderstatus") == "F", "Finished").when(F.col("o_orderstatus") == "O", "ft").otherwise("Not Started")
    heads = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"), status.alias("status"), F.col("o_custkey").alias("cust"))
    return v.contests(spark, sf, list(measures)).join(heads, "contest_id")


@query("scan_finished", f"""WITH {_GAMES} SELECT contest_id, ts, home_score, away_score, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result FROM g WHERE status <> 'Not Started'""")
def scan_finished(spark, sf):
    return tb.finished_contests(with_status(spark, sf)).select("contest_id", "ts", "home_score", "away_score", "result")


@query("scan_stats", f"""WITH {_GAMES} SELECT contest_id, home_score, home_shots, away_shots FROM g WHERE status <> 'Not Started'""")
def scan_stats(spark, sf):
    """Stats joined to finished contests; the columns known only afterwards are left out."""
    stats = v.contests(spark, sf, ["shots", "rating"]).select("contest_id", "home_shots", "away_shots", "home_rating", "away_rating")
    return tb.stats_of(tb.finished_contests(with_status(spark, sf)).select("contest_id", "home_score"), stats, ["home_rating", "away_rating"])


@query("scan_pools", """SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE (n_name, r_name) IN (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 = 1)""")
def scan_pools(spark, sf):
    """Rows of listed (name, country) pairs only."""
    dims = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = read_table(spark, sf, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return tb.in_pools(rows, dims.where("n_nationkey % 4 = 1"), ["n_name", "r_name"]).select("c_custkey", "c_name")


@query("scan_train", f"WITH {v.CONTESTS_SQL} SELECT contest_id, pool, home_sot, away_sot FROM contests WHERE pool <> '5-LOW'")
def scan_train(spark, sf):
    games = v.contests(spark, sf).select("contest_id", "pool")
    stats = v.contests(spark, sf, ["sot"]).select("contest_id", "home_sot", "away_sot")
    return tb.without_pool(games, stats, "5-LOW")


@query("missing_quotes", f"WITH {_GAMES} SELECT contest_id, ts FROM g WHERE status <> 'Not Started' AND contest_id NOT IN (SELECT l_partkey FROM lineitem)")
def missing_quotes(spark, sf):
    return tb.missing_children(tb.finished_contests(with_status(spark, sf)).select("contest_id", "ts"), v.quotes(spark, sf), "contest_id")


@query("predicted_anti", f"WITH {v.CONTESTS_SQL} SELECT contest_id FROM contests WHERE contest_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def predicted_anti(spark, sf):
    """Contests without a settled win in the ledger yet."""
    held = v.ledger(spark, sf).where("result = 'win'").select(F.col("id").alias("contest_id"))
    return v.contests(spark, sf).join(held, "contest_id", "left_anti").select("contest_id")


_NAMES = list(payloads.MARKETS) + ["Corners"]
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_OUT = ["Home", "Draw", "Home/Draw", "Draw/Away"]


def raw_quotes(spark, sf):
    """One JSON payload per line: bookmaker = supplier, market and outcome from the line."""
    li = read_table(spark, sf, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    out = F.element_at(F.array(*[F.lit(n) for n in _OUT]), (F.col("l_partkey") % 4 + 1).cast("int"))
    value = F.when(F.col("l_partkey") % 10 == 0, "n/a").otherwise((F.col("l_partkey") % 50 + 1).cast("string"))
    opening = F.when(F.col("l_partkey") % 3 == 0, (F.col("l_partkey") % 40 + 1).cast("string"))
    book = F.struct(F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("bookmakerName"),
                    F.array(F.struct(name.alias("marketName"), F.array(F.struct(out.alias("name"), value.alias("value"), opening.alias("openingValue"))).alias("odds"))).alias("odds"))
    return li.select(F.col("l_orderkey").alias("contest_id"), F.to_json(F.struct(F.array(book).alias("data"))).alias("raw"))


@query("payload_quotes", f"""WITH x AS (SELECT l_orderkey AS contest_id, CAST(l_suppkey AS VARCHAR) AS source, {_NAME_SQL}[l_linenumber % 6 + 1] AS nm, {_OUT}[l_partkey % 4 + 1] AS o, l_partkey FROM lineitem WHERE l_suppkey % 11 <> 0 AND l_partkey % 10 <> 0),
y AS (SELECT *, CASE nm {" ".join(f"WHEN '{k}' THEN '{m}'" for k, m in payloads.MARKETS.items())} END AS market FROM x)
SELECT contest_id, source, market, CASE WHEN market <> 'double_chance' THEN lower(o) WHEN o = 'Home/Draw' THEN '1X' ELSE '2X' END AS outcome, CAST(l_partkey % 50 + 1 AS DOUBLE) AS price,
CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 40 + 1 AS DOUBLE) END AS opening FROM y WHERE market IS NOT NULL AND (market <> 'double_chance' OR o IN ('Home/Draw', 'Draw/Away'))""")
def payload_quotes(spark, sf):
    return payloads.quote_rows(raw_quotes(spark, sf), keep=["contest_id"]).select("contest_id", "source", "market", "outcome", "price", "opening")


@query("payload_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def payload_props(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("payload_fixtures", """SELECT o_orderkey AS row_id, o_orderkey AS api_id, o_orderdate AS date, o_orderstatus AS status, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 6 AS INT) END AS home_score,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 4 AS INT) END AS away_score FROM orders""")
def payload_fixtures(spark, sf):
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.col("o_orderstatus").alias("statusName"),
                             F.when(k % 7 != 0, F.col("o_custkey") % 6).alias("homeResult"), F.when(k % 5 == 0, "x").otherwise((F.col("o_custkey") % 4).cast("string")).alias("awayResult")))
    rows = payloads.fixture_rows(read_table(spark, sf, "orders").select(k.alias("row_id"), doc.alias("raw")), keep=["row_id"])
    return rows.select("row_id", "api_id", "date", "status", "home_score", "away_score")


@query("payload_stats", """SELECT l_orderkey AS id, l_linenumber AS no, l_partkey AS pk, CAST(l_quantity AS INT) AS home_shots, CASE WHEN l_tax > 0 THEN CAST(l_linenumber AS INT) END AS away_shots, CAST(l_discount AS DOUBLE) AS home_possession FROM lineitem""")
def payload_stats(spark, sf):
    doc = F.to_json(F.struct(F.col("l_quantity").cast("int").alias("totalShotsHome"), F.when(F.col("l_tax") > 0, F.col("l_linenumber")).alias("totalShotsAway"), F.col("l_discount").alias("ballPossessionHome")))
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("pk"), doc.alias("raw"))
    return payloads.stat_rows(rows, keep=["id", "no", "pk"]).select("id", "no", "pk", "home_shots", "away_shots", "home_possession")


@query("payload_lineups", """WITH x AS (SELECT l_orderkey AS contest_id, l_linenumber AS no, l_suppkey AS team, CASE WHEN l_linenumber % 3 <> 0 THEN '4-4-2' END AS formation,
(l_partkey % 9 <> 0)::INT + (l_suppkey % 4 <> 0)::INT AS n, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey ELSE 0 END + CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey ELSE 0 END AS id_sum FROM lineitem)
SELECT * FROM x WHERE n > 0""")
def payload_lineups(spark, sf):
    def slot(c, ok):
        return F.struct(F.struct(F.when(ok, F.col(c)).alias("id")).alias("player"))
    xi = F.array(slot("l_partkey", F.col("l_partkey") % 9 != 0), slot("l_suppkey", F.col("l_suppkey") % 4 != 0))
    team = F.struct(F.struct(F.col("l_suppkey").alias("id")).alias("team"), F.when(F.col("l_linenumber") % 3 != 0, "4-4-2").otherwise("").alias("formation"), xi.alias("startXI"))
    raw = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest_id"), F.col("l_linenumber").alias("no"), F.to_json(F.array(team)).alias("raw"))
    rows = payloads.lineup_rows(raw, keep=["contest_id", "no"])
    return rows.select("contest_id", "no", "team", "formation", F.size("starters").alias("n"), F.aggregate("starters", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("text_hygiene", """SELECT o_orderkey AS id, 'A' || o_orderstatus AS txt, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS at FROM orders""")
def text_hygiene(spark, sf):
    """NUL characters removed; ISO text to naive timestamps, unreadable ones to NULL."""
    k = F.col("o_orderkey")
    iso = F.when(k % 4 == 0, "soon").when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    dirty = F.concat(F.lit("A"), F.unhex(F.lit("00")).cast("string"), F.col("o_orderstatus"))
    return read_table(spark, sf, "orders").select(k.alias("id"), tb.clean_text(dirty).alias("txt"), tb.naive_timestamp(iso).alias("at"))


@query("upsert_latest", """WITH n AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS bal, max(o_orderdate) AS at FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
o AS (SELECT c_custkey AS k, c_acctbal AS bal, TIMESTAMP '1990-01-01' AS at FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.bal, o.bal) AS bal, coalesce(o.at, n.at) AS at FROM o FULL JOIN n ON o.k = n.k""")
def upsert_latest(spark, sf):
    """Natural-key upsert: newest change wins, the first-seen time of known keys stays."""
    old = read_table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit("1990-01-01").cast("timestamp_ntz").alias("at"))
    new = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("bal"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return merge.upsert(old, new, ["k"], ["at", "seq"], ["bal"]).select("k", "bal", "at")


@query("replace_keys", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N')
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'""")
def replace_keys(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_linenumber"]
    return merge.replace_keys(li.where("l_linestatus = 'F'").select(*cols), li.where("l_linestatus = 'O' AND l_returnflag = 'N'").select(*cols), ["l_orderkey"])


@query("refresh_quotes", f"""WITH {v.QUOTES_SQL}, q AS (SELECT contest_id, CASE snap_no % 3 WHEN 0 THEN '1x2' WHEN 1 THEN 'double_chance' ELSE 'total' END AS market, source % 5 AS source, outcome, price, opening, is_closing, recorded_at, snap_id, snap_no, raw FROM quotes),
old AS (SELECT contest_id, market, source, outcome, arg_max(price, (recorded_at, snap_id, snap_no, raw)) AS price, max(recorded_at) AS seen FROM q WHERE recorded_at < TIMESTAMP '1998-06-01' GROUP BY ALL),
new AS (SELECT contest_id, market, source, outcome, arg_max(price, (recorded_at, snap_id, snap_no, raw)) AS price, max(recorded_at) AS seen FROM q WHERE recorded_at >= TIMESTAMP '1998-06-01' AND market <> 'total' GROUP BY ALL)
SELECT contest_id, market, source, outcome, coalesce(n.price, o.price) AS price, CASE WHEN o.price IS NULL THEN n.price ELSE o.price END AS opening FROM old o FULL JOIN new n USING (contest_id, market, source, outcome)""")
def refresh_quotes(spark, sf):
    """Open quotes get the later price and keep the earlier one as opening."""
    keys = ["contest_id", "market", "source", "outcome"]
    order = ["recorded_at", "snap_id", "snap_no", "raw"]
    market = F.when(F.col("snap_no") % 3 == 0, "1x2").when(F.col("snap_no") % 3 == 1, "double_chance").otherwise("total")
    q = v.quotes(spark, sf).select("contest_id", market.alias("market"), (F.col("source") % 5).alias("source"), "outcome", "price", *order)
    q = q.withColumn("opening", F.col("price")).withColumn("is_closing", F.lit(False))
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    old = merge.newest(q.where(F.col("recorded_at") < cut), keys, order).select(*keys, "price", "opening", "is_closing")
    return merge.refresh_quotes(old, q.where(F.col("recorded_at") >= cut), order).select(*keys, "price", "opening")


@query("fill_missing", """WITH base AS (SELECT l_orderkey AS contest_id, l_suppkey AS team FROM lineitem WHERE l_returnflag = 'A'),
add AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT contest_id FROM base)) SELECT contest_id, team FROM base UNION ALL SELECT l_orderkey, l_suppkey FROM add""")
def fill_missing(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest_id"), F.col("l_suppkey").alias("team"), "l_returnflag", "l_shipdate")
    base = li.where("l_returnflag = 'A'").select("contest_id", "team")
    return merge.fill_missing(base, li.where("l_returnflag = 'R'").select("contest_id", "team", "l_shipdate"), ["contest_id"], ["contest_id", "team"], ["l_shipdate"])


@query("ledger_import", f"""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS match_date, 'Team ' || o_custkey AS home_name, 'Club ' || (o_orderkey % 9) AS away_name, CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS pick,
{sql_rnd('o_totalprice / 100000', 2)} AS odds, CASE WHEN o_orderstatus = 'F' THEN 'win' ELSE 'loss' END AS result, o_orderpriority, o_orderkey % 6 AS kind FROM orders),
known AS (SELECT match_date, home_name, pick FROM r WHERE o_orderpriority = '1-URGENT')
SELECT match_date, home_name, away_name, pick, odds, result FROM r WHERE kind <> 5 AND o_orderpriority <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.match_date = r.match_date AND k.home_name = r.home_name AND k.pick = r.pick)""")
def ledger_import_query(spark, sf):
    """Text rows ("A vs B", tick marks, two date formats) to ledger rows, without those already held."""
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders")
    date = F.when(k % 6 == 5, "unknown").when(k % 6 == 4, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    won = F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "✓").when(k % 3 == 1, "WIN").otherwise("1")).otherwise("LOSS")
    raw = o.select(date.alias("Date"), F.concat(F.lit("Team "), F.col("o_custkey"), F.lit(" vs "), F.lit("Club "), k % 9).alias("Match"), F.lit("L").alias("League"),
                   F.when(k % 2 == 0, " Home").otherwise("AWAY").alias("Side"), F.lit("rule").alias("Model"), rnd(F.col("o_totalprice") / 100000, 2).cast("string").alias("Odds"),
                   F.lit("10").alias("Kelly Stake $"), F.lit("0").alias("Kelly P&L $"), won.alias("Won"), "o_orderpriority")
    known = o.where("o_orderpriority = '1-URGENT'").select(F.lit("s").alias("strategy"), F.col("o_orderdate").cast("date").alias("match_date"), F.concat(F.lit("Team "), F.col("o_custkey")).alias("home_name"),
                                                            F.when(k % 2 == 0, "home").otherwise("away").alias("pick"))
    rows = ledger_import.import_rows(raw.where("o_orderpriority <> '1-URGENT'"), "match_list", "s")
    return ledger_import.without_known(rows, known).select("match_date", "home_name", "away_name", "pick", "odds", "result")


@query("merge_buckets", """WITH n AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS bal, max(o_orderdate) AS at FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 8 <> 3 GROUP BY o_custkey),
o AS (SELECT c_custkey AS k, c_acctbal AS bal, TIMESTAMP '1990-01-01' AS at FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.bal, o.bal) AS bal, coalesce(o.at, n.at) AS at FROM o FULL JOIN n ON o.k = n.k WHERE coalesce(o.k, n.k) % 5 <> 4""")
def merge_buckets(spark, sf):
    """Upsert and delete on a stored table of hash buckets; only buckets with changed keys are rewritten."""
    old = read_table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit("1990-01-01").cast("timestamp_ntz").alias("at"))
    new = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_custkey % 8 <> 3").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("bal"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    table = merge.KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}", ["k"], 16)
    table.create(old)
    table.upsert(new, ["at", "seq"], ["bal"])
    table.delete(table.read().where("k % 5 = 4"))
    return table.read().select("k", "bal", "at")


_NAMED = """names AS (SELECT s_suppkey AS id, n_name || ' ' || s_name AS name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query("resolve_contests", f"""WITH {v.CONTESTS_SQL}, {_NAMED},
q AS (SELECT contest_id AS row_id, CAST(ts AS DATE) AS day, CASE WHEN contest_id % 3 = 0 THEN h.s_name ELSE lower(h.name) END AS home, CASE WHEN contest_id % 5 = 0 THEN a.s_name ELSE upper(a.name) END AS away,
 home_score + CASE WHEN contest_id % 7 = 0 THEN 1 ELSE 0 END AS hs, away_score AS aw FROM contests JOIN names h ON h.id = home_id JOIN names a ON a.id = away_id WHERE contest_id % 4 = 0),
hit AS (SELECT q.*, c.contest_id, c.home_score <> q.hs OR c.away_score <> q.aw AS score_differs, row_number() OVER (PARTITION BY row_id ORDER BY c.contest_id) AS rn FROM q JOIN contests c ON CAST(c.ts AS DATE) = q.day
 JOIN names h ON h.id = c.home_id AND h.name ILIKE '%' || split_part(q.home, ' ', 1) || '%' JOIN names a ON a.id = c.away_id AND a.name ILIKE '%' || split_part(q.away, ' ', 1) || '%')
SELECT row_id, contest_id, score_differs FROM hit WHERE rn = 1""")
def resolve_contests(spark, sf):
    """Contests found by day, aliases and parts of names, with a flag where the score differs."""
    supplier, nation = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    names = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "n_name", "s_name").alias("name"), "s_name")
    aliases = names.select(F.concat(F.lit("Alias "), F.col("id").cast("string")).alias("alias"), F.col("s_name").alias("name"))
    games = v.contests(spark, sf)
    side = lambda s: names.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))
    k = F.col("contest_id")
    rows = games.where(k % 4 == 0).join(side("home"), "home_id").join(side("away"), "away_id").select(
        k.alias("row_id"), F.col("ts").cast("date").alias("day"), F.when(k % 3 == 0, F.concat(F.lit("ALIAS "), F.col("home_id").cast("string"))).otherwise(F.lower("home_name")).alias("home"),
        F.when(k % 5 == 0, F.concat(F.lit("alias "), F.col("away_id").cast("string"))).otherwise(F.upper("away_name")).alias("away"),
        (F.col("home_score") + (k % 7 == 0).cast("int")).alias("home_score"), "away_score")
    return rs.resolve_contests(rows, games, names.select("id", "name"), aliases)
