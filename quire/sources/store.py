"""The canonical store: facts by month, monthly history, and per-merchant tables in buckets.

* Facts (bank, PSP, webshop, marketplace, accounting) are Parquet by month. A
  feature run prunes them to the months its windows touch.
* History holds partial aggregates by merchant and month for features that
  cover all of it. Each month is a partition of its own; writing it again
  replaces it, so a new or corrected month is merged by writing that month.
* Tables of one row per merchant, and applications, are bucketed by merchant:
  joins among them move nothing. Facts are not: a merchant with a third of
  all rows would be one task; their aggregates combine before any shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expr import cutoff
from quire.operators.features.assemble import FAMILY_HISTORY, FAMILY_STATS, family_stats, featured, spine
from quire.session import shuffles_removed
from quire.sources.registry import ready
from quire.sources.schemas import AS_OF_COLUMN

#: Longest window of the features over raw rows, in days.
RAW_DAYS = 365
#: The partition column of facts.
MONTH = "_month"


def write_facts(df: DataFrame, name: str, path: str, months: Sequence[dt.date] | None = None) -> None:
    """The rows of a fact source, by month; only ``months`` (their first days) if given. Months that are written again
    are replaced whole; a job that fails replaces none."""
    month = F.trunc(AS_OF_COLUMN[name], "MM")
    rows = ready(df, name).withColumn(MONTH, month)
    if months is not None:
        rows = rows.filter(month.isin(list(months)))
    # by month, where Spark splits months that are large and joins small ones
    with shuffles_removed(df.sparkSession):
        (rows.hint("rebalance", F.col(MONTH))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(MONTH).parquet(f"{path}/{name}"))


def read_facts(spark: SparkSession, name: str, path: str, as_of: dt.date, days: int | None = RAW_DAYS) -> DataFrame:
    """A fact source up to ``as_of``, of the last ``days`` days (None: all), from the months that hold them."""
    rows = spark.read.parquet(f"{path}/{name}")
    date, month = F.col(AS_OF_COLUMN[name]), F.col(MONTH)
    rows = rows.filter((month <= F.lit(as_of)) & (date <= F.lit(as_of)))
    if days is not None:
        first = cutoff(as_of, days)
        rows = rows.filter((month >= F.lit(first.replace(day=1))) & (date >= F.lit(first)))
    return rows.drop(MONTH)


def merge_history(sources: Mapping[str, DataFrame], path: str, months: Sequence[dt.date] | None = None) -> None:
    """Partial aggregates of the given months (all if None), each month replacing what the history had of it."""
    for name, build in FAMILY_HISTORY.items():
        if sources.get(name) is None:
            continue
        df = ready(sources[name], name)
        if months is not None:
            df = df.filter(F.trunc(AS_OF_COLUMN[name], "MM").isin(list(months)))
        with shuffles_removed(df.sparkSession):
            (build(df).filter(F.col("month").isNotNull()).withColumn(MONTH, F.col("month")).drop("month")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(MONTH).parquet(f"{path}/{name}"))


def read_history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The history by family; a family that has none yet is left out."""
    found = {}
    for name in FAMILY_HISTORY:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}").withColumnRenamed(MONTH, "month")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return found


def write_by_merchant(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A table of few rows per merchant, in buckets by merchant_id, as a table of the catalog."""
    (df.repartition(buckets, "merchant_id").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "merchant_id").sortBy("merchant_id").saveAsTable(table))
    return df.sparkSession.table(table)


def write_statistics(sources: Mapping[str, DataFrame], as_of: dt.date, path: str, prefix: str, buckets: int,
                     history: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The spine and every family's statistics as bucketed tables ``<prefix>_<name>``."""
    tables = {"spine": spine(sources["merchants"], sources["applications"])}
    tables |= family_stats(sources, as_of, tuple(FAMILY_STATS), history)
    return {name: write_by_merchant(df, f"{prefix}_{name}", f"{path}/{name}", buckets) for name, df in tables.items()}


def features_of(tables: Mapping[str, DataFrame], as_of: dt.date, apply_defaults: bool = True) -> DataFrame:
    """The feature table from stored statistics: joins within buckets, no exchange."""
    j = tables["spine"]
    for family in FAMILY_STATS:
        j = j.join(tables[family].hint("merge"), "merchant_id", "left")
    return featured(j, as_of, apply_defaults)
