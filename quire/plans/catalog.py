"""Registry of named queries: a Spark builder and (where SQL can express it)
an independent DuckDB oracle over the same raw tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

# Report tables carry doubles rounded to this many decimals (both engines).
REPORT_DIGITS = 6


@dataclass
class Query:
    name: str
    build: Builder
    oracle: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, doc: str = "") -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = Query(name, fn, oracle, doc or (fn.__doc__ or "").strip().split("\n")[0])
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = REPORT_DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(columns: list[tuple[str, str]], digits: int = REPORT_DIGITS) -> str:
    """Select list for the oracle: (name, kind) with kind 'd' for doubles."""
    return ", ".join(f"round({n}, {digits}) AS {n}" if k == "d" else n for n, k in columns)
