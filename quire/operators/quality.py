"""Validation report (V1-V8). Validation never blocks: it reports.

Each source is checked with ONE global aggregate (partial per partition,
one tiny final merge) and unpivoted to rows of
``(source, check, subject, value, threshold, passed)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.schemas import (ACCOUNTING_MIN_MONTHS, ENUM_DOMAINS, MARGIN_OUT_OF_RANGE_MAX, MIN_HISTORY_DAYS,
                                   NULL_CHECK_COLUMNS, NULL_RATE_MAX, REQUIRED_COLUMNS, is_absent)

REPORT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("check", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("passed", T.BooleanType()),
])

FEATURE_MISSING_ALERT = 0.20


def required_columns_report(spark: SparkSession, sources: dict[str, DataFrame]) -> DataFrame:
    """V1: required column names present in each source (schema metadata only); NULLs that stand in for a column that
    the source lacks do not count."""
    rows = []
    for src, req in REQUIRED_COLUMNS.items():
        df = sources.get(src)
        if df is None:
            continue
        for col in req:
            ok = not is_absent(df, col)
            rows.append((src, "required_column", col, 1.0 if ok else 0.0, 1.0, ok))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def _checks(src: str, df: DataFrame) -> list[tuple[str, str, Column, float, str]]:
    """(check, subject, aggregate value, threshold, comparison) for one source."""
    out: list[tuple[str, str, Column, float, str]] = []
    cols = {c for c in df.columns if not is_absent(df, c)}  # a column that is absent is V1's matter
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    for c in NULL_CHECK_COLUMNS.get(src, []):
        if c in cols:
            missing = F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
            out.append(("null_rate", c, F.avg(missing.cast("double")), NULL_RATE_MAX, "le"))
    if src in ENUM_DOMAINS and ENUM_DOMAINS[src][0] in cols:
        c, allowed = ENUM_DOMAINS[src]
        bad = F.col(c).isNull() | ~F.col(c).isin(*allowed)
        out.append(("enum_domain", c, F.count(F.when(bad, F.lit(1))).cast("double"), 0.0, "eq"))
    if src in MIN_HISTORY_DAYS and MIN_HISTORY_DAYS[src][0] in cols:
        c, days = MIN_HISTORY_DAYS[src]
        out.append(("history_days", c, F.datediff(F.max(c), F.min(c)).cast("double"), float(days), "ge"))
    if src == "accounting":
        if "gross_margin" in cols:
            gm = F.col("gross_margin")
            out.append(("range", "gross_margin",
                        F.avg(F.coalesce((gm < 0) | (gm > 1), F.lit(False)).cast("double")), MARGIN_OUT_OF_RANGE_MAX, "le"))
        if "month" in cols:
            out.append(("distinct_months", "month", F.count_distinct("month").cast("double"),
                        float(ACCOUNTING_MIN_MONTHS), "ge"))
    if src == "marketplace" and "account_health_score" in cols:
        h = F.col("account_health_score")
        out.append(("range", "account_health_score", F.avg(F.coalesce((h < 1) | (h > 10), F.lit(False)).cast("double")), 0.0, "le"))
    if src == "kyc":
        out.append(("non_empty", "rows", F.count(F.lit(1)).cast("double"), 1.0, "ge"))
    return out


def data_quality_report(sources: dict[str, DataFrame]) -> DataFrame:
    """V2-V7 for every present source, one aggregate job per source."""
    parts = []
    for src, df in sources.items():
        checks = _checks(src, df)
        if not checks:
            continue
        agg = df.agg(*[v.alias(f"c{i}") for i, (_, _, v, _, _) in enumerate(checks)])
        structs = []
        for i, (check, subject, _, thr, cmp) in enumerate(checks):
            v = F.col(f"c{i}")
            passed = {"le": v <= thr, "eq": v == thr, "ge": v >= thr}[cmp]
            structs.append(F.struct(F.lit(src).alias("source"), F.lit(check).alias("check"),
                                    F.lit(subject).alias("subject"), v.alias("value"),
                                    F.lit(thr).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed")))
        parts.append(agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def domain_table(spark: SparkSession) -> DataFrame:
    """(source, column, value): the allowed values of the enum columns."""
    return spark.createDataFrame([(src, c, v) for src, (c, allowed) in ENUM_DOMAINS.items() for v in allowed],
                                 "source string, column string, value string")


def value_counts(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(source, column, value, n): how often each value of the enum columns occurs, NULL included."""
    parts = [sources[src].groupBy(F.lit(src).alias("source"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             .agg(F.count(F.lit(1)).alias("n"))
             for src, (c, _) in ENUM_DOMAINS.items() if src in sources and not is_absent(sources[src], c)]
    return reduce(DataFrame.unionByName, parts)


def invalid_values(sources: Mapping[str, DataFrame], domains: DataFrame | None = None) -> DataFrame:
    """The values that occur but are not allowed, each with its rows: the difference of the two sets of values.
    NULL is a value that no domain allows. ``domains`` (source, column, value) defaults to the canonical ones."""
    counts = value_counts(sources)
    allowed = domains if domains is not None else domain_table(counts.sparkSession)
    return counts.join(allowed, ["source", "column", "value"], "left_anti")


def observed(df: DataFrame, src: str) -> tuple[DataFrame, Observation, list]:
    """V2-V7 in the pass that loads a source: ``df`` gathers the checks' figures as it is written or aggregated for the
    first time; afterwards ``observed_report`` has the report, without another scan."""
    checks = _checks(src, df)
    seen = Observation()
    # an observed metric cannot be a distinct aggregate; the months of a calendar are few
    exact = [F.size(F.collect_set(subject)).cast("double") if check == "distinct_months" else v
             for check, subject, v, _, _ in checks]
    return df.observe(seen, *[v.alias(f"c{i}") for i, v in enumerate(exact)]), seen, checks


def observed_report(spark: SparkSession, observations: Mapping[str, tuple[Observation, list]]) -> DataFrame:
    """The rows of ``data_quality_report`` from what was observed: one small row of figures per source."""
    rows = []
    for src, (seen, checks) in observations.items():
        got = seen.get
        for i, (check, subject, _, threshold, cmp) in enumerate(checks):
            v = got[f"c{i}"]
            passed = v is not None and {"le": v <= threshold, "eq": v == threshold, "ge": v >= threshold}[cmp]
            rows.append((src, check, subject, v, threshold, passed))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def feature_missing_alerts(raw_features: DataFrame, threshold: float = FEATURE_MISSING_ALERT) -> DataFrame:
    """V8: numeric features missing in more than 20% of rows (one aggregate + unpivot)."""
    numeric = [f.name for f in raw_features.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.DecimalType))]
    agg = raw_features.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c)
                             for c in numeric])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_pct"))
                                          for c in numeric])).alias("r")).select("r.*")
    return (long.filter(F.col("missing_pct") > threshold)
            .select("feature", F.round("missing_pct", 3).alias("missing_pct"),
                    F.lit("DATA_QUALITY_ALERT").alias("status"),
                    # Fixed value: the alert's text.
                    F.format_string("Feature '%s' has %.1f%% missing. Investigate data source before using in "
                                    "production.", F.col("feature"), F.col("missing_pct") * 100).alias("action")))
