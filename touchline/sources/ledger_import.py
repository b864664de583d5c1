"""Import of past ledger rows from text tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of a win, and the column names of the two source layouts.
WIN = ["✓", "WIN", "1"]
LAYOUTS = {
    "match_list": {"date": "Date", "match": "Match", "league": "League", "pick": "Side", "rule": "Model", "odds": "Odds", "stake": "Kelly Stake $", "pnl": "Kelly P&L $", "won": "Won"},
    "bets": {"date": "Дата", "home": "Ставка_на", "away": "Проти", "league": "Ліга", "pick": "Сторона", "odds": "Коеф", "stake": "Стейк_$", "pnl": "PnL_$", "won": "WIN/LOSS"},
}
KEY = ["strategy", "match_date", "home_name", "pick"]


def import_rows(raw: DataFrame, layout: str, strategy: str, date_formats: tuple[str, ...] = ("yyyy-MM-dd", "dd.MM.yyyy")) -> DataFrame:
    """Text columns of a layout to ledger rows; rows without a readable date are dropped."""
    names = LAYOUTS[layout]

    def text(key: str):
        return F.trim(F.col(f"`{names[key]}`").cast("string"))
    date = F.coalesce(*[F.try_to_timestamp(text("date"), F.lit(f)) for f in date_formats]).cast("date")
    if "match" in names:
        parts = F.split(text("match"), " vs ", 2)
        home, away = F.trim(parts[0]), F.when(F.size(parts) == 2, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise("")
    else:
        home, away = text("home"), text("away")
    return raw.select(
        F.lit(strategy).alias("strategy"), date.alias("match_date"), home.alias("home_name"), away.alias("away_name"), F.lower(text("pick")).alias("pick"),
        text("league").alias("league"), text("odds").try_cast("double").alias("odds"), text("stake").try_cast("double").alias("stake"), text("pnl").try_cast("double").alias("pnl"),
        F.when(text("won").isin(*WIN), "win").otherwise("loss").alias("result")).where(F.col("match_date").isNotNull())


def without_known(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Only rows whose (strategy, date, home, pick) is not in the ledger yet."""
    return rows.join(ledger.select(*KEY), KEY, "left_anti")
