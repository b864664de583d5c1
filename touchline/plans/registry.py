"""Named queries and, where SQL can say the same, their check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from touchline.functions.scalars import rnd
from touchline.plans.views import sql_rnd

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, keep: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in cols])


def sql_rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{sql_rnd(c, digits)} AS {c}" for c in cols)
