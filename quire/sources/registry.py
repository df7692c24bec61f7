"""Canonical sources in one place: read a Parquet folder, shape it, and check it without blocking."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.expr import nan_to_null
from quire.operators.quality import data_quality_report, observed, observed_report, required_columns_report
from quire.session import write_table
from quire.sources.schemas import OPTIONAL_SOURCES, POSTING_ORDER, REQUIRED_COLUMNS, SCHEMAS, completed


def empty_source(spark: SparkSession, name: str) -> DataFrame:
    """An absent optional source is an empty frame with the canonical schema."""
    return spark.createDataFrame([], SCHEMAS[name])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value in every double column."""
    return df.select(*[nan_to_null(F.col(f.name).cast("double")).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


#: Files whose places are sent to every task; more are met by a join.
FILES_SENT = 50_000
#: Rows of one file that a posting's place can tell apart.
FILE_ROWS = 1 << 36


def _one_slash(path: Column) -> Column:
    """Paths are written with one or three slashes after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+:)/*", "$1/")


def in_file_order(df: DataFrame, column: str = POSTING_ORDER) -> DataFrame:
    """``df``, read from Parquet files, with each row's place in them: files by path, rows as they stand in the file.

    The last posting of a day is the last row of that day, as files have no
    other order. Anything that is not read straight from files raises."""
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
        files = sorted(df.inputFiles())
    except AnalysisException as e:
        raise ValueError(f"rows without {column} have an order only where they are read straight from Parquet files") from e
    if len(files) < 2:
        return placed.withColumn(column, F.col("_row")).drop("_path", "_row")
    ranks = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _rank long")
    ranks = ranks.select(_one_slash(F.col("_file")).alias("_file"), "_rank")
    ranks = F.broadcast(ranks) if len(files) <= FILES_SENT else ranks.hint("merge")
    known = F.when(F.col("_rank").isNotNull(), F.col("_rank") * FILE_ROWS + F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("file without a place: "), F.col("_path"))).cast("long"))
    return (placed.join(ranks, _one_slash(F.col("_path")) == F.col("_file"), "left")
            .withColumn(column, known).drop("_path", "_row", "_file", "_rank"))


def ready(df: DataFrame, name: str) -> DataFrame:
    """What the operators take: NaN as null, every canonical column there, bank postings with a place."""
    if name == "bank" and POSTING_ORDER not in df.columns:
        df = in_file_order(df)
    return completed(without_nan(df), name)


def shaped(df: DataFrame, name: str) -> DataFrame:
    """Columns cast to the canonical types, NaN as null; columns that the source lacks are NULL and marked as
    absent, for the check of required columns; columns that the schema does not know are left out."""
    df = ready(df, name)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=df.schema[f.name].metadata)
                       for f in SCHEMAS[name].fields])


def load_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A canonical source from its Parquet folder, with all canonical columns. An optional source whose folder
    does not exist is empty; any other read error is raised."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if name in OPTIONAL_SOURCES and e.getCondition() == "PATH_NOT_FOUND":
            return empty_source(spark, name)
        raise
    return shaped(found, name)


def load_and_validate(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All sources by name, and the report of V1-V7 over them as a DataFrame. A failed check blocks nothing."""
    sources = {name: load_source(spark, name, path) for name, path in paths.items()}
    report = required_columns_report(spark, sources).unionByName(data_quality_report(sources))
    return sources, report


def store_and_validate(spark: SparkSession, paths: dict[str, str],
                       name: str = "source") -> tuple[dict[str, DataFrame], DataFrame]:
    """S9 in one pass: each source is read once, written under the shared folder, and checked on the way. The sources
    returned are the written tables; the report is that of ``load_and_validate``."""
    stored, seen, raw = {}, {}, {}
    for source, path in paths.items():
        raw[source] = load_source(spark, source, path)
        watched, *seen[source] = observed(raw[source], source) if source in REQUIRED_COLUMNS else (raw[source],)
        stored[source] = write_table(watched, f"{name}-{source}")
    report = observed_report(spark, {s: o for s, o in seen.items() if o})
    return stored, required_columns_report(spark, raw).unionByName(report)
