"""Multi-grain aggregation: several GROUP BY grains from ONE scan.

A plan that branches from a source into several aggregates gets each branch
pruned differently by the optimizer, so exchanges are not reused and the source
is scanned once per branch. Instead each row is tagged with the grains it
belongs to (``explode`` of a small struct array: Spark's Expand, the same
mechanism GROUPING SETS uses), aggregated once on
``(merchant_id, g, k_date, k_str, k_int)``, and folded per merchant by
conditional aggregates. The whole family is then a single linear pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN_KEYS = ("g", "k_date", "k_str", "k_int")


def grain(tag: str, k_date: Column | None = None, k_str: Column | None = None, k_int: Column | None = None,
          when: Column | None = None) -> Column:
    s = F.struct(F.lit(tag).alias("g"),
                 (k_date if k_date is not None else F.lit(None)).cast("date").alias("k_date"),
                 (k_str if k_str is not None else F.lit(None)).cast("string").alias("k_str"),
                 (k_int if k_int is not None else F.lit(None)).cast("long").alias("k_int"))
    return F.when(when, s) if when is not None else s


def tag_grains(df: DataFrame, *grains: Column) -> DataFrame:
    """One output row per non-null grain struct, with columns g/k_date/k_str/k_int.

    Plain explode + Filter (both code-generated) rather than a lambda
    ``filter`` inside the generator, which is evaluated row by row."""
    x = df.select("*", F.explode(F.array(*grains)).alias("_grain")).filter(F.col("_grain").isNotNull())
    return x.select(*[F.col(c) for c in df.columns], *[F.col(f"_grain.{k}").alias(k) for k in GRAIN_KEYS])


def at(tag: str, value: Column, cond: Column | None = None) -> Column:
    """Value restricted to one grain (and an optional condition), NULL elsewhere."""
    c = F.col("g") == tag
    if cond is not None:
        c = c & cond
    return F.when(c, value)
