"""Keyed state with event-time timers: scores of two feeds, and rolling line-value status.

A key's state is a few numbers (of contests: arrays, one state a bucket of contests) and goes when its last timer fires. Nothing is decided before the watermark has passed its time, so results
do not hang on the order in which rows arrive, as long as they are late by the watermark's delay at most. A feed that is done sends a heartbeat, a row with a null
key and a later time; it moves the watermark on and is counted nowhere.
"""
from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The status of a finished contest, and limits of the line-value status.
FINISHED = "Finished"
HEALTHY_CLV, WARNING_CLV, MIN_ROWS, ROLLING_DAYS = 0.0, -0.02, 5, 30

MICROS = 1_000_000
#: Contests share BUCKETS states, so that a batch calls Python once a bucket and not once a contest.
BUCKETS = 512
PHASE, NEVER = 0, np.iinfo(np.int64).min
EVENT = "contest_id long, kind string, at_us long, status string, home_score long, away_score long, priority int"


def _wake(state: GroupState, times: list[int]) -> None:
    """Set the timer to the next time (in microseconds) at which something is to be decided."""
    state.setTimeoutTimestamp(max(min(times) // 1000, state.getCurrentWatermarkMs() + 1))


def score_events(updates: DataFrame, grace_s: int = 3 * 3600, delay: str = "1 day", keep_s: int = 2 * 86400) -> DataFrame:
    """Phase changes and final scores of contests from polled updates of two feeds.

    updates(contest_id, priority, status, home_score, away_score, recorded_at timestamp): priority 0 is the first feed, 1 the second. Columns out: contest_id, kind,
    recorded_at, status, home_score, away_score, priority.

    kind 'phase': a contest's first update with a status, once, whichever feed has it (the first feed on equal times). kind 'final': once a contest. The first
    feed's finished score counts unless it comes later than grace_s after the second feed's; then the second feed's counts, at the end of its
    grace. Finished updates without both scores settle nothing. Among updates of the same time the lower score is taken. State is one entry per status and feed, and is
    removed keep_s after the final score, or after the last update of a contest that never ends.
    """
    src = updates.withColumn("at_us", F.unix_micros("recorded_at")).withWatermark("recorded_at", delay)
    src = src.select("contest_id", "priority", "status", "home_score", "away_score", "recorded_at", "at_us")

    grace, keep = grace_s * MICROS, keep_s * MICROS

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, names = pickle.loads(zlib.decompress(state.get[0])) if state.exists else (None, [])
        parts = [] if held is None else [held]
        for rows in batches:
            rows = rows[rows["contest_id"].notna() & rows["at_us"].notna()]
            if len(rows):
                parts += _entries(rows, names)
        if not parts:
            return
        e = _earliest({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
        now = state.getCurrentWatermarkMs() * 1000
        starts = np.flatnonzero(_changes(e["contest_id"]))
        game = np.cumsum(_changes(e["contest_id"])) - 1
        last, done = np.maximum.reduceat(e["last"], starts), np.maximum.reduceat(e["done"], starts)
        at_final, chosen = _finals(e, game, len(starts), grace)
        open_final = (chosen >= 0) & (done == NEVER)
        settled = open_final & (at_final < now)
        done[settled] = at_final[settled]
        told = (e["kind"] == PHASE) & ~e["told"] & (e["at"] < now)
        e["told"] |= told
        waiting = (e["kind"] == PHASE) & ~e["told"]
        late = open_final & ~settled
        busy = np.logical_or.reduceat(waiting, starts) | late
        end = np.maximum(done, last) + keep
        gone = ~busy & (end < now)
        if told.any() or settled.any():
            yield _told(e, names, np.concatenate([np.flatnonzero(told), chosen[settled]]), np.concatenate([e["at"][told], at_final[settled]]), int(told.sum()))
        e["last"], e["done"] = last[game], done[game]
        stay = ~gone[game]
        if not stay.any():
            if state.exists:
                state.remove()
            return
        state.update((zlib.compress(pickle.dumps(({c: x[stay] for c, x in e.items()}, names)), 1),))
        times = np.concatenate([e["at"][waiting], at_final[late], end[~busy & ~gone]])
        _wake(state, [int(times.min())])

    bucket = F.pmod(F.xxhash64("contest_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    events = src.select(bucket, "*").groupBy("bucket").applyInPandasWithState(track, EVENT, "data binary", "append", GroupStateTimeout.EventTimeTimeout)
    return events.select("contest_id", "kind", F.timestamp_micros("at_us").alias("recorded_at"), "status", "home_score", "away_score", "priority")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted run starts."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _entries(rows: pd.DataFrame, names: list) -> list[dict]:
    """Updates as entries: one for the status, one more for a finished score of either feed. `names` gets the statuses that are new."""
    codes, found = pd.factorize(rows["status"])
    names += [x for x in found if x not in names]
    code = np.array([*[names.index(x) for x in found], -1], np.int32)[codes]
    at, priority = rows["at_us"].to_numpy(np.int64), rows["priority"].to_numpy(np.int32)
    home, away = rows["home_score"], rows["away_score"]
    whole = lambda x: x.fillna(0).to_numpy(np.int64)
    phase = {"contest_id": rows["contest_id"].to_numpy(np.int64), "kind": np.full(len(rows), PHASE, np.int8), "name": code, "at": at, "priority": priority,
             "home": whole(home), "no_home": home.isna().to_numpy(), "away": whole(away), "no_away": away.isna().to_numpy(),
             "told": np.zeros(len(rows), bool), "last": at, "done": np.full(len(rows), NEVER)}
    done = (rows["status"] == FINISHED).to_numpy(bool) & ~phase["no_home"] & ~phase["no_away"] & ((priority == 0) | (priority == 1))
    return [phase, {c: x[done] for c, x in phase.items()} | {"kind": (PHASE + 1 + priority[done]).astype(np.int8)}]


def _earliest(e: dict) -> dict:
    """One entry a contest, kind and status: the earliest, by feed and lower score on equal times (an unknown score first)."""
    order = np.lexsort((np.where(e["no_away"], -1, e["away"]), np.where(e["no_home"], -1, e["home"]), e["priority"], e["at"], e["name"], e["kind"], e["contest_id"]))
    e = {c: x[order] for c, x in e.items()}
    starts = np.flatnonzero(_changes(e["contest_id"], e["kind"], e["name"]))
    return {c: x[starts] for c, x in e.items()} | {"told": np.logical_or.reduceat(e["told"], starts)} | {c: np.maximum.reduceat(e[c], starts) for c in ("last", "done")}


def _finals(e: dict, game: np.ndarray, n: int, grace: int) -> tuple[np.ndarray, np.ndarray]:
    """For each contest, when its final score is settled and by which entry (-1: none), from what is known."""
    at = []
    for kind in (PHASE + 1, PHASE + 2):
        found = np.flatnonzero(e["kind"] == kind)
        at.append(np.full(n, -1))
        at[-1][game[found]] = found
    own, other = at
    by_own = (own >= 0) & ((other < 0) | (e["at"][own] <= e["at"][other] + grace))
    return np.where(by_own, e["at"][own], e["at"][other] + grace), np.where(by_own, own, other)


def _told(e: dict, names: list, which: np.ndarray, at: np.ndarray, phases: int) -> pd.DataFrame:
    """Entries as rows of EVENT, phases first."""
    score = lambda c: pd.Series(pd.arrays.IntegerArray(e[c][which], e[f"no_{c}"][which]))
    kinds = np.where(np.arange(len(which)) < phases, "phase", "final")
    return pd.DataFrame({"contest_id": e["contest_id"][which], "kind": kinds, "at_us": at, "status": np.array([*names, None], object)[e["name"][which]],
                         "home_score": score("home"), "away_score": score("away"), "priority": e["priority"][which]})


def settled_picks(updates: DataFrame, picks: DataFrame, settle, **limits) -> DataFrame:
    """Open picks graded as their contests' final scores are settled, each once: a stream-static join of the final scores. Only contests with open picks, and
    heartbeats, get state."""
    wanted = picks.where(F.col("result").isNull()).select(F.col("contest_id").alias("_open")).distinct()
    asked = updates.join(wanted, F.col("contest_id") == F.col("_open"), "left").where("_open IS NOT NULL OR contest_id IS NULL").drop("_open")
    finals = score_events(asked, **limits).where("kind = 'final'").select("contest_id", "home_score", "away_score")
    return settle(picks, finals)


HEALTH = "strategy string, day_no int, n long, avg_clv double, status string, was string, event string"


def rolling_status(values: DataFrame, days: int = ROLLING_DAYS, least: int = MIN_ROWS, delay: str = "2 days") -> DataFrame:
    """Days on which a strategy's status, by the mean line value of the last `days` days, enters or leaves 'alert'.

    values(strategy, ts timestamp, clv). A day is judged once the watermark has passed its end; days without rows and windows with fewer than `least` values are not judged.
    Each task first sums its own rows by strategy and day. State is one (count, sum) for each day of the window, days that leave it are dropped; an idle
    strategy keeps its last status only. Rows with a null clv count nowhere.
    """
    day = F.unix_date(F.col("ts").cast("date"))
    src = values.where("clv IS NOT NULL OR strategy IS NULL").select("strategy", day.alias("day_no"), F.coalesce("clv", F.lit(0.0)).alias("clv"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = rows.groupby(["strategy", "day_no"], dropna=False)["clv"].agg(["size", "sum"]).reset_index()
            names = pd.Series([None if pd.isna(x) else x for x in got["strategy"]], dtype=object)
            yield got.assign(strategy=names).rename(columns={"size": "n", "sum": "total"})

    parts = src.mapInPandas(sums, "strategy string, day_no int, n long, total double")
    closed_at = F.timestamp_seconds((F.col("day_no") + 1).cast("long") * 86400)
    parts = parts.withColumn("closed_at", closed_at).withWatermark("closed_at", delay)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = json.loads(state.get[0]) if state.exists else {"days": {}, "open": [], "was": None}
        for rows in batches:
            for d, n, total in zip(rows["day_no"].tolist(), rows["n"].tolist(), rows["total"].tolist()):
                held = data["days"].get(str(d), [0, 0.0])
                data["days"][str(d)] = [held[0] + n, held[1] + total]
                if d not in data["open"]:
                    data["open"].append(d)
        if key[0] is None or pd.isna(key[0]):
            return
        now, out = state.getCurrentWatermarkMs(), []
        for d in sorted(x for x in data["open"] if (x + 1) * 86400_000 < now):
            data["open"].remove(d)
            inside = [v for x, v in data["days"].items() if d - days < int(x) <= d]
            n, total = sum(v[0] for v in inside), sum(v[1] for v in inside)
            if n < least:
                continue
            status = "healthy" if total / n >= HEALTHY_CLV else "warning" if total / n >= WARNING_CLV else "alert"
            if (status == "alert") != (data["was"] == "alert"):
                out.append((key[0], d, n, total / n, status, data["was"], "alert" if status == "alert" else "recovery"))
            data["was"] = status
        oldest = min(data["open"], default=now // 86400_000 + 1) - days
        data["days"] = {x: v for x, v in data["days"].items() if int(x) > oldest}
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH.split(", ")]).astype({"day_no": "int32"})
        state.update((json.dumps(data),))
        if data["open"]:
            _wake(state, [(min(data["open"]) + 1) * 86400 * MICROS])

    judged = parts.groupBy("strategy").applyInPandasWithState(judge, HEALTH, "data string", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.select("strategy", F.date_from_unix_date("day_no").alias("day"), "n", "avg_clv", "status", "was", "event")
