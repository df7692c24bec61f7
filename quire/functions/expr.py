"""Reusable column expressions: the helper reducers (CV, HHI, normalized slope,
refund / chargeback rates) and the calendar recipes.

All reducers are written over *sufficient statistics* (counts, sums, sums of
squares, min/max) so that Spark runs them as partial + final hash aggregates:
a merchant holding a third of all rows is combined map-side and never lands
as one unbounded group in a single task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def cutoff(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)


def in_window(date_col: Column, as_of: dt.date, days: int) -> Column:
    """Trailing window ``date >= as_of - days`` (the as-of upper bound is applied at scan)."""
    return date_col >= F.lit(cutoff(as_of, days))


def dbl(c: Column) -> Column:
    return c.cast("double")


def nan_to_null(c: Column) -> Column:
    """NaN never reaches a comparison: Spark orders NaN above every number."""
    return F.nanvl(c, F.lit(None).cast("double"))


def sample_std_from_moments(n: Column, s1: Column, s2: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares.

    Exact for decimal or integer sums but for the final double arithmetic; a
    double sum of squares rounds before. NULL when n < 2."""
    n_d, s1_d, s2_d = dbl(n), dbl(s1), dbl(s2)
    var = F.try_divide(s2_d - F.try_divide(s1_d * s1_d, n_d), n_d - 1)
    return F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))


def cv(n: Column, mean: Column, std: Column) -> Column:
    """H2: sample std / |mean|; fewer than 2 values or mean 0 gives 1.0."""
    return (F.when(F.coalesce(n, F.lit(0)) < 2, F.lit(1.0))
            .when(mean == 0, F.lit(1.0))
            .otherwise(F.try_divide(std, F.abs(mean))))


def hhi(sum_sq: Column, total: Column) -> Column:
    """H1: sum of squared shares = sum(v^2) / (sum v)^2; total 0 or no groups gives 1.0."""
    t = dbl(total)
    return F.when(F.coalesce(t, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.try_divide(dbl(sum_sq), t * t))


def slope_normalized_zero_filled(n_points: Column, sum_y: Column, sum_xy: Column) -> Column:
    """H3 over a zero-filled series x = 0..n-1 given n, sum(y) and sum(x*y).

    Empty buckets add nothing to sum(y) or sum(x*y), so no calendar spine is
    materialized. Fewer than 3 points or mean 0 gives 0.0."""
    n = dbl(n_points)
    sy = dbl(sum_y)
    sxy = dbl(sum_xy)
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    mean = F.try_divide(sy, n)
    return (F.when(F.coalesce(n, F.lit(0.0)) < 3, F.lit(0.0))
            .when(mean == 0, F.lit(0.0))
            .otherwise(F.try_divide(slope, F.abs(mean))))


def slope_normalized_observed(n: Column, slope: Column, mean: Column) -> Column:
    """H3 over observed points in order (no gap fill): ``slope`` is regr_slope(y, idx)."""
    return (F.when(F.coalesce(n, F.lit(0)) < 3, F.lit(0.0))
            .when(mean == 0, F.lit(0.0))
            .otherwise(F.coalesce(F.try_divide(slope, F.abs(mean)), F.lit(0.0))))


def week_start_day(date_col: Column) -> Column:
    """Epoch day of the Monday that starts the date's Mon-Sun week."""
    return F.datediff(F.date_trunc("week", date_col).cast("date"), F.lit(dt.date(1970, 1, 1)))


def cents(c: Column) -> Column:
    """Money, a decimal of two places, as exact long cents: integer sums stay on the primitive fast path
    (a decimal(18,2) sum widens to decimal(28,2), which Spark backs with BigDecimal).

    Up to 10^13 a double holds the cents with room to round; beyond, decimal arithmetic does."""
    exact = (c.cast("decimal(18,2)") * F.lit(100).cast("decimal(3,0)")).cast("long")
    return F.when(F.abs(c) < 10 ** 13, F.round(c.cast("double") * 100).cast("long")).otherwise(exact)


def eur(c: Column) -> Column:
    return c.cast("double") / 100.0


def weekly_slope_stats(date_col: Column, y: Column, cond: Column, anchor: dt.date | None = None) -> dict[str, Column]:
    """Aggregates that feed ``weekly_slope`` for a zero-filled weekly series (R9 + H3).

    Week starts are counted in days from ``anchor`` (the Monday of the window
    start) so sum(x * y) stays small and exact."""
    wk = week_start_day(date_col)
    if anchor is not None:
        wk = wk - F.lit((anchor - dt.timedelta(days=anchor.weekday()) - dt.date(1970, 1, 1)).days)
    return {
        "sy": F.sum(F.when(cond, y)),
        "swy": F.sum(F.when(cond, y.cast("double") * wk)),
        "wmin": F.min(F.when(cond, wk)),
        "wmax": F.max(F.when(cond, wk)),
    }


def weekly_slope(prefix: str) -> Column:
    c = lambda s: F.col(f"{prefix}_{s}")
    n = (c("wmax") - c("wmin")) / 7 + 1
    sxy = (dbl(c("swy")) - dbl(c("wmin")) * dbl(c("sy"))) / 7
    return slope_normalized_zero_filled(n, c("sy"), sxy)


def months_spanned(min_date: Column, max_date: Column) -> Column:
    """Number of calendar months from the first to the last observed month."""
    return F.months_between(F.trunc(max_date, "MM"), F.trunc(min_date, "MM")).cast("int") + 1


def month_ends_between(start: dt.date, end: dt.date) -> int:
    """Number of month-end dates in [start, end], at least 1 (a job parameter, not data)."""
    count = 0
    y, m = start.year, start.month
    while True:
        nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
        last = nxt - dt.timedelta(days=1)
        if last > end:
            break
        if last >= start:
            count += 1
        y, m = nxt.year, nxt.month
    return max(count, 1)
