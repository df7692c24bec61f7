"""Bank features (cash flow, volatility, balances, suppliers, seasonality, ad spend).

Plan (one linear pipeline, one scan of the postings):

* multi-grain partial/final aggregation on (merchant, grain, key):
  totals of all history, day totals (R10 closing balance, daily credits), month totals (seasonality,
  trailing-6-observed-month GMV J16, supplier months), counterparty credit
  totals (inflow HHI H1);
* one conditional fold per merchant (J7 windows applied to the day keys).

No operator holds a merchant's raw postings in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import (cents, cutoff, cv, dbl, eur, hhi, in_window, month_ends_between,
                                  months_spanned, sample_std_from_moments)
from quire.functions.grains import GRAIN_KEYS, at, grain, tag_grains

# Minimum distinct credit days for the 30/90/180-day volatility.
VOLATILITY_WINDOWS = {"30d": (30, 10), "90d": (90, 30), "180d": (180, 60)}
PREFIX = "bk_"


_N_MONTHS = 13  # calendar months a 365-day window can touch
_LAST_MONTH_COLS = [f"_mv{i}" for i in range(_N_MONTHS)] + [f"_mo{i}" for i in range(_N_MONTHS)]


def _months_back(as_of: dt.date, i: int) -> dt.date:
    y, m = as_of.year, as_of.month - i
    while m <= 0:
        y, m = y - 1, m + 12
    return dt.date(y, m, 1)


def _last_months_columns(as_of: dt.date, observed: Column) -> list[Column]:
    """Per calendar month (0 = as-of month, going back): credits and whether the
    month is observed. Fixed columns instead of a collected list, so the fold
    stays a plain hash aggregate."""
    kd = F.col("k_date")
    cols = []
    for i in range(_N_MONTHS):
        is_i = kd == F.lit(_months_back(as_of, i))
        cols.append(eur(F.sum(at("m", F.col("credit_365"), is_i & observed))).alias(f"_mv{i}"))
    for i in range(_N_MONTHS):
        is_i = kd == F.lit(_months_back(as_of, i))
        cols.append(F.count(at("m", F.lit(1), is_i & observed)).alias(f"_mo{i}"))
    return cols


def _last_observed_mean(k: int) -> Column:
    """Mean of the ``k`` most recent observed months (static over 13 columns)."""
    total, taken = F.lit(0.0), F.lit(0)
    seen = F.lit(0)
    for i in range(_N_MONTHS):
        o = F.col(f"_mo{i}") > 0
        take = o & (seen < k)
        total = total + F.when(take, F.col(f"_mv{i}")).otherwise(F.lit(0.0))
        taken = taken + F.when(take, 1).otherwise(0)
        seen = seen + F.when(o, 1).otherwise(0)
    return F.when(taken > 0, total / taken)


def bank_history(bank: DataFrame) -> DataFrame:
    """Partial aggregates of each merchant and month: what ``bank_stats`` needs of all history."""
    settled = F.when(F.col("category") == "psp_settlement", cents(F.col("amount")))
    return (bank.groupBy("merchant_id", F.trunc("date", "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(settled).alias("psp_settle")))


def bank_stats(bank: DataFrame, as_of: dt.date, history: DataFrame | None = None) -> DataFrame:
    """Per-merchant sufficient statistics for every bank feature, from ONE scan.

    Grains: t (row count and settlement sum of all history), day (R10 closing
    balance, daily credits, window sums; the 180 d that windows reach), month
    (credits in 365 d, supplier presence in 180 d) and counterparty (credits in
    90 d, for the inflow HHI). A posting outside a grain's window gives no key
    of it, so old days are not shuffled. The month list kept per merchant is
    bounded by the 13 calendar months a 365-day window can touch.

    With ``history`` (as ``bank_history`` gives it) the postings are read for the last 365 days only; row counts and
    settlement sums of months before that of ``as_of`` come from the history."""
    b = bank.filter(F.col("date") <= F.lit(as_of))
    month_start = as_of.replace(day=1)
    if history is not None:
        b = b.filter(F.col("date") >= F.lit(cutoff(as_of, 365)))
    d = F.col("date")
    amt = F.col("amount")
    credit = F.col("direction") == "CREDIT"
    debit = F.col("direction") == "DEBIT"
    cat = F.col("category")
    sup = cat == "supplier_payment"
    w = {days: in_window(d, as_of, days) for days in (30, 90, 180, 365)}
    x = tag_grains(b.select("merchant_id", "date", "amount", "direction", "category", "balance_after",
                            "posting_seq", "counterparty_name"),
                   grain("t", when=None if history is None else d >= F.lit(month_start)),
                   grain("d", k_date=d, when=w[180]),
                   grain("m", k_date=F.trunc(d, "MM"), when=w[365]),
                   grain("c", k_str=F.col("counterparty_name"),
                         when=credit & w[90] & F.col("counterparty_name").isNotNull()))
    c = cents(amt)  # exact long cents keep the sums on the primitive fast path
    g = x.groupBy("merchant_id", *GRAIN_KEYS).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(c).alias("net"),
            F.sum(F.when(credit, c)).alias("credit"),
            F.count(F.when(credit, F.lit(1))).alias("n_credit"),
            F.sum(F.when(debit, F.abs(c))).alias("debit_abs"),
            F.sum(F.when(cat == "advertising", F.abs(c))).alias("ad_abs"),
            F.count(F.when(sup, F.lit(1))).alias("sup_n"),
            F.sum(F.when(sup, F.abs(c))).alias("sup_s1"),
            F.sum(F.when(sup, c.cast("double") * c.cast("double"))).alias("sup_s2"),
            F.sum(F.when(cat == "psp_settlement", c)).alias("psp_settle"),
            # The balance of the day's last posting
            F.max_by("balance_after", F.when(F.col("balance_after").isNotNull(), F.col("posting_seq")))
             .alias("close_bal"),
            F.sum(F.when(credit & w[365], c)).alias("credit_365"),
            F.count(F.when(credit & w[365], F.lit(1))).alias("n_credit_365"),
            F.count(F.when(sup & w[180], F.lit(1))).alias("sup_180"),
        )
    kd = F.col("k_date")
    ever = F.col("g") == "t"
    if history is not None:
        old = history.filter(F.col("month") < F.lit(month_start)).select(
            "merchant_id", F.lit("t").alias("g"), "n", "psp_settle")
        g = g.unionByName(old, allowMissingColumns=True)
    wk = {days: in_window(kd, as_of, days) for days in (30, 90, 180)}
    has_credit = F.col("n_credit") > 0
    aggs: list[Column] = [
        F.sum(F.when(ever, F.col("n"))).alias("rows_all"),
        eur(F.sum(F.when(ever, F.col("psp_settle")))).alias("psp_settle_all"),
    ]
    for days in (90, 180):
        aggs += [eur(F.sum(at("d", F.col("net"), wk[days]))).alias(f"net_{days}"),
                 F.min(at("d", kd, wk[days])).alias(f"dmin_{days}"),
                 F.max(at("d", kd, wk[days])).alias(f"dmax_{days}"),
                 F.sum(at("d", F.col("n"), wk[days])).alias(f"rows_{days}"),
                 F.avg(at("d", F.when(F.col("close_bal") < 0, 1.0).otherwise(0.0), wk[days])).alias(f"negpct_{days}")]
    for label, (days, _) in VOLATILITY_WINDOWS.items():
        cond = wk[days] & has_credit
        aggs += [F.count(at("d", F.lit(1), cond)).alias(f"cdays_{label}"),
                 F.avg(at("d", dbl(F.col("credit")), cond)).alias(f"cmean_{label}"),
                 F.stddev_samp(at("d", dbl(F.col("credit")), cond)).alias(f"cstd_{label}")]
    observed = F.col("n_credit_365") > 0
    aggs += [
        F.avg(at("d", dbl(F.col("close_bal")), wk[90])).alias("avgbal_90"),
        eur(F.sum(at("d", F.col("debit_abs"), wk[90]))).alias("debit_abs_90"),
        F.sum(at("d", F.col("ad_abs"), wk[90])).alias("ad_90"),
        F.sum(at("d", F.col("credit"), wk[90])).alias("credit_90"),
        F.sum(at("d", F.col("sup_n"), wk[180])).alias("sup_n_180"),
        F.sum(at("d", F.col("sup_s1"), wk[180])).alias("sup_s1_180"),
        F.sum(at("d", F.col("sup_s2"), wk[180])).alias("sup_s2_180"),
        F.count(at("m", F.lit(1), observed)).alias("rev_months"),
        F.max(at("m", dbl(F.col("credit_365")), observed)).alias("rev_month_max"),
        F.avg(at("m", dbl(F.col("credit_365")), observed)).alias("rev_month_mean"),
        *_last_months_columns(as_of, observed),
        F.count(at("m", F.lit(1), F.col("sup_180") > 0)).alias("sup_months_180"),
        F.sum(at("c", dbl(F.col("net")) * dbl(F.col("net")))).alias("cp_sq"),
        F.sum(at("c", dbl(F.col("net")))).alias("cp_total"),
    ]
    out = g.groupBy("merchant_id").agg(*aggs)
    out = out.withColumn("rev_last6_mean", _last_observed_mean(6)).drop(*_LAST_MONTH_COLS)
    return out.select("merchant_id", *[F.col(n).alias(PREFIX + n) for n in out.columns if n != "merchant_id"])


def bank_feature_columns(as_of: dt.date) -> dict[str, Column]:
    """Feature expressions over ``bank_stats`` columns, NULL-safe for merchants
    without postings (they get the operator's own fallback values)."""
    c = lambda n: F.col(PREFIX + n)
    z = lambda x: F.coalesce(x, F.lit(0))
    f: dict[str, Column] = {}
    for days, label in ((90, "3m"), (180, "6m")):
        f[f"monthly_net_cashflow_avg_{label}"] = F.when(
            z(c(f"rows_{days}")) > 0, dbl(c(f"net_{days}")) / months_spanned(c(f"dmin_{days}"), c(f"dmax_{days}")))
    c3, c6 = f["monthly_net_cashflow_avg_3m"], f["monthly_net_cashflow_avg_6m"]
    f["cashflow_trend_delta"] = F.coalesce(
        F.when(c6 != 0, F.try_divide(c3 - c6, F.abs(c6))), F.lit(0.0))
    for label, (_, min_obs) in VOLATILITY_WINDOWS.items():
        f[f"revenue_volatility_{label}"] = F.when(
            z(c(f"cdays_{label}")) >= min_obs,
            cv(c(f"cdays_{label}"), c(f"cmean_{label}"), c(f"cstd_{label}"))).otherwise(F.lit(0.50))
    f["revenue_volatility_delta"] = f["revenue_volatility_30d"] - f["revenue_volatility_90d"]
    f["negative_balance_pct_90d"] = F.when(z(c("rows_90")) > 0, c("negpct_90")).otherwise(F.lit(1.0))
    daily_opex = dbl(z(c("debit_abs_90"))) / 90
    f["days_cash_on_hand"] = F.when((z(c("rows_90")) > 0) & (daily_opex > 0),
                                    F.try_divide(c("avgbal_90"), daily_opex)).otherwise(F.lit(0.0))
    f["overdraft_dependency"] = F.when(z(c("rows_180")) > 0, c("negpct_180")).otherwise(F.lit(1.0))
    f["inflow_concentration_hhi"] = hhi(c("cp_sq"), c("cp_total"))
    n_month_ends = month_ends_between(cutoff(as_of, 180), as_of)
    enough_sup = z(c("sup_n_180")) >= 3
    f["supplier_pay_punctuality"] = F.when(
        enough_sup, dbl(z(c("sup_months_180"))) / F.lit(float(n_month_ends))).otherwise(F.lit(0.50))
    sup_mean = F.try_divide(dbl(c("sup_s1_180")), dbl(c("sup_n_180")))
    f["supplier_payout_lumpiness"] = F.when(
        enough_sup, cv(c("sup_n_180"), sup_mean,
                       sample_std_from_moments(c("sup_n_180"), c("sup_s1_180"), c("sup_s2_180")))
    ).otherwise(F.lit(1.0))
    f["seasonality_index"] = F.when(z(c("rev_months")) >= 6,
                                    F.try_divide(c("rev_month_max"), c("rev_month_mean"))).otherwise(F.lit(2.0))
    f["ad_spend_ratio_3m"] = F.when(dbl(z(c("credit_90"))) > 0,
                                    F.try_divide(dbl(z(c("ad_90"))), dbl(c("credit_90")))).otherwise(F.lit(0.35))
    f["monthly_gmv_avg_6m"] = F.when(z(c("rev_months")) >= 1, c("rev_last6_mean")).otherwise(F.lit(0.0))
    return f
