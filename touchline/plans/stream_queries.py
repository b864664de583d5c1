"""Queries that run the streams over the supplied event and order files until all input is read."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from touchline.operators import ledger as lg
from touchline.plans import ledger_queries as lq
from touchline.plans import rating_queries as rq
from touchline.plans import views as v
from touchline.plans.registry import ORACLES, query, rounded, sql_rounded
from touchline.session import cut
from touchline.sources.tables import read_table
from touchline.streaming import late_ratings as lr
from touchline.streaming import streams as sm
from touchline.streaming import timers as tm


def quote_stream(spark, sf):
    """Events as price snapshots: contest = user, market = event type, price = value."""
    raw = sm.read_files(spark, sf, read_table(spark, sf, "events").schema, "events.parquet")
    return raw.select(F.col("user_id").alias("contest_id"), F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("recorded_at"), F.col("value").alias("price"), "event_id")


_Q = "q AS (SELECT user_id AS contest_id, event_type AS market, ts AS recorded_at, value AS price, event_id FROM events)"
_START = "CAST(c_custkey * 7 % 26 AS INT)"


def games(spark, sf):
    k = F.col("c_custkey")
    start = F.lit("2024-01-03").cast("timestamp_ntz") + F.make_dt_interval(days=(k * 7 % 26).cast("int"))
    return read_table(spark, sf, "customer").select(k.alias("contest_id"), start.cast("timestamp").alias("starts_at"), F.when(k % 10 == 0, "Finished").otherwise("Not Started").alias("status"))


@query("stream_snapshots", f"""WITH RECURSIVE {_Q}, o AS MATERIALIZED (SELECT q.* FROM q JOIN customer ON c_custkey = contest_id WHERE c_custkey % 10 <> 0
 AND TIMESTAMP '2024-01-03' + INTERVAL 1 DAY * {_START} >= recorded_at AND TIMESTAMP '2024-01-03' + INTERVAL 1 DAY * {_START} < recorded_at + INTERVAL 36 HOUR),
a(contest_id, market, recorded_at) AS (SELECT contest_id, market, min(recorded_at) FROM o GROUP BY ALL UNION ALL
 SELECT * FROM (SELECT o.contest_id, o.market, min(o.recorded_at) AS t FROM a JOIN o ON o.contest_id = a.contest_id AND o.market = a.market AND o.recorded_at >= a.recorded_at + INTERVAL 25 MINUTE GROUP BY o.contest_id, o.market))
SELECT contest_id, market, o.recorded_at, price FROM o SEMI JOIN a USING (contest_id, market, recorded_at)""")
def stream_snapshots(spark, sf):
    """Snapshots of upcoming contests, at least 25 minutes apart."""
    rows = sm.spaced_snapshots(sm.in_look_ahead(quote_stream(spark, sf), games(spark, sf)))
    return _naive(sm.run_to_files(rows, sm.work_folder(spark, "snapshots")), "recorded_at")


def _naive(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("stream_opening", f"""WITH {_Q}, x AS (SELECT *, first(price) OVER w AS opening, count(*) OVER (PARTITION BY contest_id, market ORDER BY recorded_at, price) AS n FROM q WINDOW w AS (PARTITION BY contest_id, market ORDER BY recorded_at, price ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, (price - opening) / opening AS drift FROM x) SELECT contest_id, market, recorded_at, price, opening, n, {sql_rounded(['drift'])} FROM d""")
def stream_opening(spark, sf):
    got = sm.run_to_files(sm.opening_drift(quote_stream(spark, sf)), sm.work_folder(spark, "opening"))
    return rounded(_naive(got, "recorded_at"), ["contest_id", "market", "recorded_at", "price", "opening", "n"], ["drift"])


_CLOSED = "WHERE w + INTERVAL {width} <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("stream_windows", f"""WITH {_Q}, x AS (SELECT time_bucket(INTERVAL 30 MINUTE, recorded_at) AS w, * FROM q), g AS (SELECT w AS start, w + INTERVAL 30 MINUTE AS "end", market, count(*) AS n, min(price) AS low, max(price) AS high, avg(price) AS mean
FROM x {_CLOSED.format(width='30 MINUTE')} GROUP BY w, market) SELECT start, "end", market, n, low, high, {sql_rounded(['mean'])} FROM g""")
def stream_windows(spark, sf):
    """Closed 30-minute windows of prices per market."""
    got = sm.run_to_files(sm.price_windows(quote_stream(spark, sf)), sm.work_folder(spark, "windows"))
    return rounded(_naive(got, "start", "end"), ["start", "end", "market", "n", "low", "high"], ["mean"])


@query("stream_sliding", f"""WITH {_Q}, x AS (SELECT time_bucket(INTERVAL 15 MINUTE, recorded_at) - INTERVAL 15 MINUTE * k AS w, q.* FROM q, generate_series(0, 1) t(k)),
g AS (SELECT w AS start, w + INTERVAL 30 MINUTE AS "end", market, count(*) AS n, min(price) AS low, max(price) AS high, avg(price) AS mean FROM x {_CLOSED.format(width='30 MINUTE')} GROUP BY w, market)
SELECT start, "end", market, n, low, high, {sql_rounded(['mean'])} FROM g""")
def stream_sliding(spark, sf):
    got = sm.run_to_files(sm.price_windows(quote_stream(spark, sf), "30 minutes", "15 minutes"), sm.work_folder(spark, "sliding"))
    return rounded(_naive(got, "start", "end"), ["start", "end", "market", "n", "low", "high"], ["mean"])


@query("stream_sessions", f"""WITH {_Q}, x AS (SELECT *, CASE WHEN recorded_at - lag(recorded_at) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY contest_id ORDER BY recorded_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY contest_id ORDER BY recorded_at) AS sid FROM x), g AS (SELECT contest_id, min(recorded_at) AS start, max(recorded_at) + INTERVAL 2 HOUR AS "end", count(*) AS n, max(price) AS high FROM s GROUP BY contest_id, sid)
SELECT * FROM g WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, sf):
    """Closed spans of quoting per contest, two hours of silence apart."""
    got = sm.run_to_files(sm.quoting_sessions(quote_stream(spark, sf)), sm.work_folder(spark, "sessions"))
    return _naive(got, "start", "end")


@query("stream_thinned", """SELECT DISTINCT user_id AS contest_id, event_type AS market, time_bucket(INTERVAL 25 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket FROM events""")
def stream_thinned(spark, sf):
    """The cheap gap rule: one snapshot per 25-minute bucket."""
    rows = sm.thinned_snapshots(quote_stream(spark, sf)).select("contest_id", "market", "bucket")
    return _naive(sm.run_to_files(rows, sm.work_folder(spark, "thinned")), "bucket")


# ---- feeds of many files, one a trigger, not in the order of time ----------------------------------------------------

FILES, FIRST_DAY, DAYS, LATE = 6, "1992-01-01", 2500, "1400 days"


def arriving(df, at: str, jitter, folder: str):
    """A feed as a stream of FILES files, one a trigger: neighbouring files are swapped, rows with a jitter of 1 come a file late; a heartbeat ends it."""
    spark = df.sparkSession
    part = F.floor(F.datediff(F.col(at).cast("date"), F.lit(FIRST_DAY).cast("date")) * FILES / DAYS) + jitter
    rows = cut(df.withColumn("_file", F.least(part, F.lit(FILES - 1))))
    beat = spark.range(1).select(*[F.lit("2100-01-01" if c == at else None).cast(t).alias(c) for c, t in df.dtypes])
    for i in range(FILES):
        rows.where(F.col("_file") == (i ^ 1)).drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    beat.write.mode("append").parquet(f"{folder}/in")
    return sm.read_files(spark, f"{folder}/in", df.schema, per_batch=1)


def score_updates(spark, sf):
    """Updates of two feeds made of the contests: the first feed never ends every seventh contest and is late for every eleventh; the second repeats some
    finals with a score that must not be used, and is sometimes first with a phase."""
    games = v.contests(spark, sf).select("contest_id", "home_score", "away_score", (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("contest_id") % 24 * 3600).alias("kick"))
    k, h, a = F.col("contest_id"), F.col("home_score").cast("long"), F.col("away_score").cast("long")
    none, half_h, half_a = F.lit(None).cast("long"), F.least(h, F.lit(1)), F.least(a, F.lit(1))

    def update(priority, status, minute, home, away, when=F.lit(True)):
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(status).alias("status"), home.alias("home_score"), away.alias("away_score"),
                                     F.timestamp_seconds(F.col("kick") + minute * 60).alias("recorded_at")))

    end = F.when(k % 11 == 0, 650).otherwise(110)
    told = F.array(update(0, "Not Started", F.lit(-10), none, none), update(0, "1H", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")),
                   update(0, "1H", F.lit(3), F.lit(0).cast("long"), F.lit(0).cast("long")), update(0, "HT", F.lit(46), half_h, half_a), update(0, "2H", F.lit(61), half_h, half_a),
                   update(0, "Finished", F.lit(108), none, none, k % 13 == 0), update(0, "Finished", end, h, a, k % 7 != 0),
                   update(1, "2H", F.lit(60), half_h, half_a, k % 5 == 0), update(1, "Finished", F.lit(115), F.when((k % 7 == 0) | (k % 11 == 0), h).otherwise(h + 10), a,
                                                                                 (k % 3 == 0) | (k % 7 == 0) | (k % 11 == 0)))
    return games.select("contest_id", F.explode(F.array_compact(told)).alias("u")).select("contest_id", "u.*")


def _score_stream(spark, sf, folder):
    return arriving(score_updates(spark, sf), "recorded_at", F.col("contest_id") % 2, folder)


_UPDATES = f"""{v.CONTESTS_SQL}, g AS (SELECT contest_id AS k, CAST(home_score AS BIGINT) AS h, CAST(away_score AS BIGINT) AS a, ts + INTERVAL 1 HOUR * CAST(contest_id % 24 AS INT) AS kick FROM contests),
u AS (SELECT k, 0 AS priority, 'Not Started' AS status, NULL::BIGINT AS hs, NULL::BIGINT AS aw, kick - INTERVAL 10 MINUTE AS at_ FROM g
UNION ALL SELECT k, 0, '1H', 0, 0, kick FROM g UNION ALL SELECT k, 0, 'HT', least(h, 1), least(a, 1), kick + INTERVAL 46 MINUTE FROM g
UNION ALL SELECT k, 0, '2H', least(h, 1), least(a, 1), kick + INTERVAL 61 MINUTE FROM g UNION ALL SELECT k, 0, 'Finished', NULL, NULL, kick + INTERVAL 108 MINUTE FROM g WHERE k % 13 = 0
UNION ALL SELECT k, 0, 'Finished', h, a, kick + CASE WHEN k % 11 = 0 THEN INTERVAL 650 MINUTE ELSE INTERVAL 110 MINUTE END FROM g WHERE k % 7 <> 0
UNION ALL SELECT k, 1, '2H', least(h, 1), least(a, 1), kick + INTERVAL 60 MINUTE FROM g WHERE k % 5 = 0
UNION ALL SELECT k, 1, 'Finished', CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN h ELSE h + 10 END, a, kick + INTERVAL 115 MINUTE FROM g WHERE k % 3 = 0 OR k % 7 = 0 OR k % 11 = 0)"""


@query("stream_scores", f"""WITH {_UPDATES}, phase AS (SELECT k, 'phase' AS kind, at_, status, hs, aw, priority FROM u
 QUALIFY row_number() OVER (PARTITION BY k, status ORDER BY at_, priority, hs NULLS FIRST, aw NULLS FIRST) = 1),
done AS (SELECT * FROM u WHERE status = 'Finished' AND hs IS NOT NULL AND aw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, priority ORDER BY at_, hs, aw) = 1),
fin AS (SELECT coalesce(f.k, s.k) AS k, f.k IS NOT NULL AND (s.k IS NULL OR f.at_ <= s.at_ + INTERVAL 3 HOUR) AS own, f.at_ AS ft, f.hs AS fh, f.aw AS fa, s.at_ + INTERVAL 3 HOUR AS st, s.hs AS sh, s.aw AS sa
 FROM (SELECT * FROM done WHERE priority = 0) f FULL JOIN (SELECT * FROM done WHERE priority = 1) s ON f.k = s.k)
SELECT k AS contest_id, kind, at_ AS recorded_at, status, hs AS home_score, aw AS away_score, priority FROM phase
UNION ALL SELECT k, 'final', CASE WHEN own THEN ft ELSE st END, 'Finished', CASE WHEN own THEN fh ELSE sh END, CASE WHEN own THEN fa ELSE sa END, CASE WHEN own THEN 0 ELSE 1 END FROM fin""")
def stream_scores(spark, sf):
    """Every phase change and final score of two polled feeds, files not in time order."""
    folder = sm.work_folder(spark, "scores")
    got = sm.run_to_files(tm.score_events(_score_stream(spark, sf, folder), delay=LATE), folder)
    return _naive(got, "recorded_at")


@query("stream_settle", ORACLES["settle_open"])
def stream_settle(spark, sf):
    """Open picks graded by the final scores of two feeds; the second feed counts where the first has none within its grace."""
    folder = sm.work_folder(spark, "settle")
    graded = tm.settled_picks(_score_stream(spark, sf, folder), lq.picks(spark, sf), lg.settle_open, delay=LATE)
    return sm.run_to_files(graded.select("id", "result", "pnl"), folder)


@query("stream_health", f"""WITH {lq.CLV_SQL}, d AS (SELECT strategy, CAST(ts AS DATE) AS day, sum(clv) AS s, count(clv) AS c FROM clv WHERE clv IS NOT NULL GROUP BY ALL),
roll AS (SELECT strategy, day, sum(s) OVER w AS s, sum(c) OVER w AS n FROM d WINDOW w AS (PARTITION BY strategy ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
e AS (SELECT strategy, day, CAST(n AS BIGINT) AS n, s / n AS avg_clv, CASE WHEN s / n >= 0 THEN 'healthy' WHEN s / n >= -0.02 THEN 'warning' ELSE 'alert' END AS status FROM roll WHERE n >= 5),
t AS (SELECT *, lag(status) OVER (PARTITION BY strategy ORDER BY day) AS was FROM e)
SELECT strategy, day, n, status, was, CASE status WHEN 'alert' THEN 'alert' ELSE 'recovery' END AS event, {sql_rounded(['avg_clv'])} FROM t
WHERE (status = 'alert' AND coalesce(was, '') <> 'alert') OR (status <> 'alert' AND was = 'alert')""")
def stream_health(spark, sf):
    """Days on which a strategy's 30-day mean line value enters or leaves 'alert', kept up by daily sums that expire."""
    folder = sm.work_folder(spark, "health")
    values = lq.clv_ledger(spark, sf).select("strategy", F.col("ts").cast("timestamp").alias("ts"), "clv", "id")
    feed = arriving(values, "ts", F.col("id") % 2, folder)
    got = sm.run_to_files(tm.rolling_status(feed, delay=LATE), folder)
    return rounded(got, ["strategy", "day", "n", "status", "was", "event"], ["avg_clv"])


@query("stream_status", """WITH x AS (SELECT o_orderpriority AS strategy, o_orderdate AS ts, o_orderkey AS id, CASE WHEN o_totalprice >= 250000 THEN 'healthy' WHEN o_totalprice >= 150000 THEN 'warning' ELSE 'alert' END AS status FROM orders),
y AS (SELECT *, lag(status) OVER (PARTITION BY strategy ORDER BY ts, id) AS was FROM x) SELECT strategy, ts, id, status, was FROM y WHERE was IS NULL OR was <> status""")
def stream_status(spark, sf):
    """Rows at which a strategy's status changes."""
    raw = sm.read_files(spark, sf, read_table(spark, sf, "orders").schema, "orders.parquet")
    rows = raw.select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))

    def classify(x: pd.Series) -> pd.Series:
        return pd.Series("alert", index=x.index).mask(x >= 150000, "warning").mask(x >= 250000, "healthy")
    got = sm.status_changes(rows, classify, sm.work_folder(spark, "status"))
    return _naive(got, "ts").select("strategy", "ts", "id", "status", "was")


@query("stream_ratings", ORACLES["elo_pool"])
def stream_ratings(spark, sf):
    """Ratings kept up from a stream of contests equal the batch fold."""
    folder = sm.work_folder(spark, "ratings")
    contests = v.contests(spark, sf).select(*rq.GAME)
    contests.write.parquet(f"{folder}/in")
    shots, _ = lr.rate_batches(sm.read_files(spark, f"{folder}/in", contests.schema), ["pool"], folder)
    return rounded(shots, ["pool", "contest_id"], ["home_elo", "away_elo"], 5)


@query("stream_ratings_late", ORACLES["elo_pool"])
def stream_ratings_late(spark, sf):
    """The same ratings from many files that are not in the order of time: late contests replay what follows them."""
    folder = sm.work_folder(spark, "late")
    feed = arriving(v.contests(spark, sf).select(*rq.GAME), "ts", (F.col("contest_id") % 2).cast("int"), folder)
    return rounded(lr.rate_batches(feed, ["pool"], folder)[0], ["pool", "contest_id"], ["home_elo", "away_elo"], 5)
