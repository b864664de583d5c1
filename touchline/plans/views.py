"""Contest, quote, ledger and rule-matrix views over the supplied tables, with the same views as SQL.

Each Spark view has a twin SQL text (`*_SQL`) used only by the DuckDB checks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import points, rnd
from touchline.operators.history import hot_keys, hot_limit
from touchline.sources.tables import read_table

# Per-participant measures of a contest, drawn from one lineitem row. Valid in Spark and in DuckDB.
SIDE_EXPR = {
    "score": "CAST(l_quantity AS INT) % 5",
    "xg": "CASE WHEN l_tax > 0 THEN l_discount * 20 END",
    "sot": "CASE WHEN l_tax > 0 THEN CAST(l_partkey % 7 AS DOUBLE) END",
    "shots": "CAST(CAST(l_quantity AS INT) % 17 + l_linenumber AS DOUBLE)",
    "box": "CAST(l_partkey % 5 AS DOUBLE)",
    "saves": "CAST(l_suppkey % 6 AS DOUBLE)",
    "pass_acc": "CAST(200 + l_partkey % 300 AS DOUBLE)",
    "pass_tot": "CAST(260 + l_partkey % 300 AS DOUBLE)",
    "poss": "CAST(35 + CAST(l_quantity AS INT) % 30 AS DOUBLE)",
    "corners": "CAST(l_linenumber + l_partkey % 4 AS DOUBLE)",
    "rating": "CAST(1400 + l_partkey % 250 AS DOUBLE)",
}
MEASURES = list(SIDE_EXPR)
STATS = MEASURES[1:]

_HOT: dict[tuple, list[tuple]] = {}


def hot_in(spark: SparkSession, sf: str, table: str, column: str) -> list[tuple]:
    """Hot keys of a raw column, found once per session by a one-column counting job.

    The row count comes from parquet footers; a table below the limit has no hot key at all.
    """
    limit = hot_limit(spark)
    key = (spark.sparkContext.applicationId, sf, table, column, limit)
    if key not in _HOT:
        raw = read_table(spark, sf, table).select(column)
        _HOT[key] = [] if raw.count() <= limit else hot_keys(raw, [column])
    return _HOT[key]


def rows_in(spark: SparkSession, sf: str, table: str) -> int:
    """Row count from parquet footers."""
    return read_table(spark, sf, table).count()


def hot_teams(spark, sf):
    return hot_in(spark, sf, "lineitem", "l_suppkey")


def hot_strategies(spark, sf):
    return hot_in(spark, sf, "orders", "o_orderpriority")


def contests(spark: SparkSession, sf: str, measures: list[str] = ("score",)) -> DataFrame:
    """Two-participant contests: the two first lines of an order meet; both must differ."""
    lines = read_table(spark, sf, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # the measures are drawn after the window, so that the shuffle carries the few columns they come from
    first2 = (lines.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
              .select("l_orderkey", F.col("l_suppkey").alias("team"), "rn", *[F.expr(SIDE_EXPR[m]).alias(m) for m in measures]))
    side = {1: "home", 2: "away"}
    pair = first2.groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("rn") == n, F.col(c))).alias(f"{side[n]}_{'id' if c == 'team' else c}")
        for n in (1, 2) for c in ("team", *measures)])
    heads = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("pool"))
    return (pair.where("home_id <> away_id").join(heads, "l_orderkey")
            .withColumnRenamed("l_orderkey", "contest_id"))


def participant_log(games: DataFrame, measures: list[str] = ("score",)) -> DataFrame:
    """Two rows per contest, each seen from one side (own measures, opponent's as *_ag)."""
    def view(me: str, you: str):
        return F.struct(
            F.lit(me).alias("side"), F.col(f"{me}_id").alias("team"), F.col(f"{you}_id").alias("opp"),
            *[F.col(f"{me}_{m}").alias(m) for m in measures],
            *[F.col(f"{you}_{m}").alias(f"{m}_ag") for m in measures])
    both = F.explode(F.array(view("home", "away"), view("away", "home"))).alias("v")
    log = games.select("contest_id", "ts", "pool", both).select("contest_id", "ts", "pool", "v.*")
    return log.withColumn("pts", points("score", "score_ag"))


def team_log(spark, sf, measures: list[str] = ("score",)) -> DataFrame:
    return participant_log(contests(spark, sf, measures), measures)


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Three-way price quotes of many sources per contest."""
    price = rnd(F.lit(1.05) + F.col("l_extendedprice") / 60000, 2)
    return read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("contest_id"), F.col("l_suppkey").alias("source"),
        F.when(F.col("l_returnflag") == "A", "home").when(F.col("l_returnflag") == "N", "draw").otherwise("away").alias("outcome"),
        price.alias("price"), F.when(F.col("l_linenumber") % 2 == 0, price + 0.05).alias("opening"),
        F.col("l_shipdate").alias("recorded_at"), (F.col("l_linestatus") == "F").alias("is_closing"),
        F.col("l_orderkey").alias("snap_id"), F.col("l_linenumber").alias("snap_no"), F.col("l_extendedprice").alias("raw"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of five strategies; open rows have no result."""
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").alias("result"),
        (F.lit(1.2) + (k % 30) / 10.0).alias("odds"), (F.lit(0.30) + (k % 50) / 100.0).alias("prob"),
        F.col("o_custkey").alias("owner"))


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-mining matrix, one row per (contest, side picked); NULL where an order has no lines."""
    agg = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.avg("l_quantity") / 20.0).alias("xg"), (F.avg("l_discount") * 45.0).alias("form"),
        (F.avg("l_tax") * 8.0 + 0.15).alias("mkt"))
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("league"),
        (F.col("c_acctbal") / 30.0 - 150.0).alias("elo"))
    k = F.col("o_orderkey")
    return (read_table(spark, sf, "orders").join(cust, "o_custkey")
            .join(agg, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(k.alias("contest_id"), F.col("o_orderdate").alias("ts"), "league",
                    F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "away").otherwise("home").alias("side"),
                    (F.lit(1.25) + (k * 7 % 226) / 100.0).alias("odds"),
                    rnd("xg", 4).alias("xg"), rnd("elo", 2).alias("elo"), rnd("form", 4).alias("form"),
                    rnd("mkt", 4).alias("mkt"), (F.col("o_orderstatus") == "F").cast("int").alias("won")))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Contests with best prices, a model's chances and a result; one per part."""
    best = quotes(spark, sf).groupBy("contest_id").agg(*[
        F.max(F.when((F.col("outcome") == s) & (F.col("price") > 1.0), F.col("price"))).alias(f"{s}_odds") for s in ("home", "draw", "away")])
    part = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("contest_id"), F.col("p_brand").alias("league"), F.col("p_type").alias("cluster"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("strength"))
    k, u = F.col("contest_id"), F.col("contest_id") * 37 % 100
    raw = {"home": 0.25 + (k * 13 % 61) / 100.0, "draw": 0.15 + (k * 29 % 23) / 100.0, "away": 0.15 + (k * 17 % 53) / 100.0}
    total = raw["home"] + raw["draw"] + raw["away"]
    return (part.join(best, "contest_id")
            .select("contest_id", "league", "cluster", "size", "strength", "home_odds", "draw_odds", "away_odds",
                    F.expr("timestamp_ntz'1998-01-01 00:00:00' + make_interval(0, 0, 0, cast(contest_id % 1400 as int), 0, 0, 0)").alias("ts"),
                    *[(x / total).alias(f"p_{s}") for s, x in raw.items()],
                    F.when(u < 45, "H").when(u < 70, "D").otherwise("A").alias("result")))


def sql_rnd(expr: str, digits: int = 6) -> str:
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(floor(({expr}) * {scale} + CAST(0.500001 AS DOUBLE)) / {scale})"


_SIDES = ", ".join(f"{e} AS {m}" for m, e in SIDE_EXPR.items())
_PAIR = ", ".join(f"max(CASE WHEN rn = {n} THEN {c} END) AS {s}_{'id' if c == 'team' else c}"
                  for n, s in ((1, "home"), (2, "away")) for c in ("team", *MEASURES))
CONTESTS_SQL = f"""first2 AS (
  SELECT l_orderkey, l_suppkey AS team, {_SIDES}, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
pair AS (SELECT l_orderkey, {_PAIR} FROM first2 WHERE rn <= 2 GROUP BY l_orderkey),
contests AS (SELECT p.l_orderkey AS contest_id, o.o_orderdate AS ts, o.o_orderpriority AS pool, p.* EXCLUDE (l_orderkey)
  FROM pair p JOIN orders o ON o.o_orderkey = p.l_orderkey WHERE p.home_id <> p.away_id)"""


def _log_side(me: str, you: str) -> str:
    own = ", ".join(f"{me}_{m} AS {m}" for m in MEASURES)
    opp = ", ".join(f"{you}_{m} AS {m}_ag" for m in MEASURES)
    return (f"SELECT contest_id, ts, pool, '{me}' AS side, {me}_id AS team, {you}_id AS opp, {own}, {opp}, "
            f"CASE WHEN {me}_score > {you}_score THEN 3 WHEN {me}_score = {you}_score THEN 1 "
            f"WHEN {me}_score < {you}_score THEN 0 END AS pts FROM contests")


LOG_SQL = f"{CONTESTS_SQL},\nlog AS ({_log_side('home', 'away')} UNION ALL {_log_side('away', 'home')})"
QUOTES_SQL = f"""quotes AS (SELECT l_partkey AS contest_id, l_suppkey AS source,
  CASE l_returnflag WHEN 'A' THEN 'home' WHEN 'N' THEN 'draw' ELSE 'away' END AS outcome,
  {sql_rnd('CAST(1.05 AS DOUBLE) + l_extendedprice / 60000', 2)} AS price,
  CASE WHEN l_linenumber % 2 = 0 THEN price + CAST(0.05 AS DOUBLE) END AS opening, l_shipdate AS recorded_at,
  l_linestatus = 'F' AS is_closing, l_orderkey AS snap_id, l_linenumber AS snap_no, l_extendedprice AS raw FROM lineitem)"""
LEDGER_SQL = """ledger AS (SELECT o_orderkey AS id, o_orderpriority AS strategy, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' END AS result,
  CAST(1.2 AS DOUBLE) + (o_orderkey % 30) / CAST(10 AS DOUBLE) AS odds,
  CAST(0.30 AS DOUBLE) + (o_orderkey % 50) / CAST(100 AS DOUBLE) AS prob, o_custkey AS owner FROM orders)"""
FACTORS_SQL = f"""agg AS (SELECT l_orderkey, avg(l_quantity) / CAST(20 AS DOUBLE) AS xg,
  avg(l_discount) * CAST(45 AS DOUBLE) AS form, avg(l_tax) * CAST(8 AS DOUBLE) + CAST(0.15 AS DOUBLE) AS mkt
  FROM lineitem GROUP BY l_orderkey),
factors AS (SELECT o_orderkey AS contest_id, o_orderdate AS ts, c_mktsegment AS league,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'away' ELSE 'home' END AS side,
  CAST(1.25 AS DOUBLE) + (o_orderkey * 7 % 226) / CAST(100 AS DOUBLE) AS odds,
  {sql_rnd('xg', 4)} AS xg, {sql_rnd('c_acctbal / CAST(30 AS DOUBLE) - 150', 2)} AS elo, {sql_rnd('form', 4)} AS form,
  {sql_rnd('mkt', 4)} AS mkt, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN agg ON l_orderkey = o_orderkey)"""
_RAW = {"home": ("0.25", 13, 61), "draw": ("0.15", 29, 23), "away": ("0.15", 17, 53)}
_RAW_SQL = ", ".join(f"CAST({a} AS DOUBLE) + (p_partkey * {m} % {d}) / CAST(100 AS DOUBLE) AS w_{s}" for s, (a, m, d) in _RAW.items())
SCORED_SQL = f"""{QUOTES_SQL}, best AS (SELECT contest_id, {", ".join(f"max(price) FILTER (outcome = '{s}' AND price > 1.0) AS {s}_odds" for s in _RAW)}
  FROM quotes GROUP BY contest_id),
raw AS (SELECT *, {_RAW_SQL} FROM part),
scored AS (SELECT p_partkey AS contest_id, p_brand AS league, p_type AS cluster, p_size AS size, p_retailprice AS strength, home_odds, draw_odds, away_odds,
  TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * (p_partkey % 1400) AS ts,
  {", ".join(f"w_{s} / (w_home + w_draw + w_away) AS p_{s}" for s in _RAW)},
  CASE WHEN p_partkey * 37 % 100 < 45 THEN 'H' WHEN p_partkey * 37 % 100 < 70 THEN 'D' ELSE 'A' END AS result
  FROM raw JOIN best ON contest_id = p_partkey)"""
