"""Matching free-text entity names to known entities."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_aliases(df: DataFrame, name: str, aliases: dict[str, str]) -> DataFrame:
    """Replace known aliases (lower-cased) by their canonical name."""
    table = F.create_map(*[F.lit(x) for k, val in aliases.items() for x in (k.lower(), val)])
    return df.withColumn(name, F.coalesce(table[F.lower(F.col(name))], F.col(name))) if aliases else df


def contains_match(left: DataFrame, right: DataFrame, block: list[str], text: str, name: str, key: str, order: str) -> DataFrame:
    """Case-insensitive containment inside a block (for example the same day), first hit by `order` kept.

    The join runs on the block key, never on containment alone; the rank filter keeps one row per key
    before anything is shuffled on.
    """
    hits = left.join(right, block).where(F.contains(F.lower(F.col(name)), F.lower(F.col(text))))
    w = W.partitionBy(key).orderBy(order)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


GRAM = 3


def _grams(text: str, least: int = GRAM):
    """All different substrings of `text` of `least` to GRAM characters."""
    c = F.col(text)
    made = [F.when(F.length(c) >= n, _of_length(c, n)).otherwise(F.array().cast("array<string>")) for n in range(least, GRAM + 1)]
    return F.array_distinct(F.concat(*made))


def _of_length(c, n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))


def containing(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, id): the names (id, name) that contain a word (word), letters in any case.

    An inverted index of the names' substrings of up to three characters; a word is looked up by its rarest one only, and containment is checked on what that finds. NULL and empty
    words find nothing.
    """
    low = names.select("id", F.lower("name").alias("name")).where("name IS NOT NULL")
    index = low.select("id", "name", F.explode(_grams("name", 1)).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = words.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    own = F.when(F.length("word") >= GRAM, _of_length(F.col("word"), GRAM)).otherwise(F.array("word"))
    # a word with a substring that no name has finds nothing
    keyed = asked.select("word", F.explode(F.array_distinct(own)).alias("gram")).join(held, "gram", "left")
    rarest = keyed.groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rarest.join(index, "gram").where(F.contains("name", F.col("word"))).select("word", "id").distinct()


def resolve_contests(rows: DataFrame, games: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The contest of each row (row_id, day, home, away, home_score, away_score): same day, and both sides' names contain the first word of what the row says.

    games(contest_id, ts, home_id, away_id, home_score, away_score), names(id, name), aliases(alias, name): an alias, letters in any case, stands for its name. A name that contains the
    whole text contains its first word, so that word decides. Contests without a score are left out; of several the smallest contest_id is taken; score_differs flags
    another score than the row's. Words are matched to names once; each contest then carries the words of its two sides, and rows meet contests by (day, word, word).
    """
    known = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    named = rows
    for side in ("home", "away"):
        named = named.join(known, F.lower(F.col(side)) == F.col("_alias"), "left")
        word = F.split(F.lower(F.trim(F.coalesce("_name", side))), " ")[0]
        named = named.withColumn(f"_{side}", word).drop("_alias", "_name")
    found = containing(named.select(F.explode(F.array("_home", "_away")).alias("word")), names)
    played = games.where("home_score IS NOT NULL AND away_score IS NOT NULL").select(
        F.col("ts").cast("date").alias("day"), "contest_id", "home_id", "away_id", F.col("home_score").alias("_hs"), F.col("away_score").alias("_as"))
    sides = (played.join(found.select(F.col("id").alias("home_id"), F.col("word").alias("_home")), "home_id")
             .join(found.select(F.col("id").alias("away_id"), F.col("word").alias("_away")), "away_id"))
    hits = named.join(sides, ["day", "_home", "_away"])
    first = hits.groupBy("row_id").agg(F.min_by(F.struct("contest_id", ((F.col("home_score") != F.col("_hs")) | (F.col("away_score") != F.col("_as"))).alias("score_differs")), "contest_id").alias("m"))
    return first.select("row_id", "m.contest_id", "m.score_differs")
