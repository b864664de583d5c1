"""Nested feed payloads (JSON text) to typed rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feed market and outcome names.
MARKETS = {"Match Winner": "1x2", "Goals Over/Under": "total", "Both Teams Score": "btts", "Asian Handicap": "handicap", "Double Chance": "double_chance"}
DOUBLE_CHANCE = {"home/draw": "1X", "draw/away": "2X", "home/away": "12"}

QUOTE_SCHEMA = ("data array<struct<bookmakerName:string, odds:array<struct<marketName:string, "
                "odds:array<struct<name:string, value:string, openingValue:string>>>>>>")
LINEUP_SCHEMA = "array<struct<team:struct<id:bigint>, formation:string, startXI:array<struct<player:struct<id:bigint>>>>>"

# Fixture and stat fields of the feed and their column names.
FIXTURE_FIELDS = {"id": "api_id bigint", "date": "date string", "statusName": "status string", "homeResult": "home_score int", "awayResult": "away_score int", "elapsed": "elapsed int"}
STAT_FIELDS = {"totalShots": "shots int", "shotsOnGoal": "shots_on_target int", "shotsInsideBox": "shots_inside_box int", "ballPossession": "possession double",
               "cornerKicks": "corners int", "passesAccurate": "passes_accurate int", "totalPasses": "passes_total int", "goalkeeperSaves": "gk_saves int",
               "yellowCards": "yellow_cards int", "redCards": "red_cards int", "fouls": "fouls int", "offsides": "offsides int"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def quote_rows(raw: DataFrame, text: str = "raw", keep: list[str] = ()) -> DataFrame:
    """bookmakers[] -> markets[] -> outcomes[] to one row per price. Unknown markets, unnamed sources and
    rows with a bad number are dropped; names are lower-cased."""
    doc = raw.select(*keep, F.from_json(text, QUOTE_SCHEMA).alias("d"))
    books = doc.select(*keep, F.explode("d.data").alias("b")).where(F.coalesce(F.col("b.bookmakerName"), F.lit("")) != "")
    markets = books.select(*keep, F.col("b.bookmakerName").alias("source"), F.explode("b.odds").alias("m"))
    rows = markets.select(*keep, "source", _lookup(MARKETS, F.col("m.marketName")).alias("market"), F.explode("m.odds").alias("o")).where(F.col("market").isNotNull())
    name = F.lower(F.col("o.name"))
    outcome = F.when(F.col("market") == "double_chance", _lookup(DOUBLE_CHANCE, name)).otherwise(name)
    opening = F.nullif(F.col("o.openingValue"), F.lit(""))
    bad = opening.isNotNull() & opening.try_cast("double").isNull()
    return rows.select(*keep, "market", "source", outcome.alias("outcome"), F.col("o.value").try_cast("double").alias("price"),
                       opening.try_cast("double").alias("opening"), F.lit(False).alias("is_closing"), bad.alias("_bad")).where(
        F.col("price").isNotNull() & F.col("outcome").isNotNull() & ~F.col("_bad")).drop("_bad")


def fixture_rows(raw: DataFrame, text: str = "raw", keep: list[str] = ()) -> DataFrame:
    """Fixture payload to a contest row: renames, null-safe casts, naive timestamp."""
    cols = []
    for field, target in FIXTURE_FIELDS.items():
        name, kind = target.split()
        value = F.get_json_object(text, f"$.{field}")
        cols.append((F.try_to_timestamp(value).cast("timestamp_ntz") if name == "date" else value.try_cast(kind)).alias(name))
    return raw.select(*keep, *cols)


def stat_rows(raw: DataFrame, text: str = "raw", keep: list[str] = ()) -> DataFrame:
    """Stats payload with ...Home / ...Away fields to home_ / away_ columns."""
    fields = ", ".join(f"{f}{s}: string" for f in STAT_FIELDS for s in ("Home", "Away"))
    doc = raw.select(*keep, F.from_json(text, f"struct<{fields}>").alias("d"))
    return doc.select(*keep, *[F.col(f"d.{f}{s}").try_cast(t.split()[1]).alias(f"{s.lower()}_{t.split()[0]}") for f, t in STAT_FIELDS.items() for s in ("Home", "Away")])


def lineup_rows(raw: DataFrame, text: str = "raw", keep: list[str] = ()) -> DataFrame:
    """Line-up payload to (team, formation, starter ids); teams without an id or starters are dropped."""
    doc = raw.select(*keep, F.explode(F.from_json(text, LINEUP_SCHEMA)).alias("t"))
    ids = F.filter(F.transform("t.startXI", lambda x: x["player"]["id"]), lambda x: x.isNotNull())
    return doc.select(*keep, F.col("t.team.id").alias("team"), F.nullif(F.col("t.formation"), F.lit("")).alias("formation"), ids.alias("starters")).where(
        F.col("team").isNotNull() & (F.size("starters") > 0))
