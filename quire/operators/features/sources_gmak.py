"""Webshop, marketplace, accounting and KYC features.

These sources are optional: a merchant without rows (or an absent source,
passed as an empty DataFrame with the canonical schema) gets no values from
the operator and the registry defaults apply.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import (cents, cv, dbl, hhi, in_window, sample_std_from_moments, slope_normalized_observed,
                                  weekly_slope, weekly_slope_stats)
from quire.functions.grains import GRAIN_KEYS, at, grain, tag_grains
from quire.sources.schemas import is_absent

WEBSHOP_MIN_ORDERS_90D = 10
# KYC verification level scores (others score as basic).
KYC_LEVEL_SCORES = {"basic": 0.33, "enhanced": 0.67, "full": 1.0}
# What a KYC source gives that lacks the column.
KYC_ABSENT = {"ubo_director_match": False, "ubo_verified": False, "identity_changes_12m": 3, "last_kyc_date": 730.0}


# ---------------------------------------------------------------- webshop (G)
def webshop_history(ws: DataFrame) -> DataFrame:
    """Orders of each merchant and month: what ``webshop_stats`` needs of all history."""
    return ws.groupBy("merchant_id", F.trunc("order_date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def webshop_stats(ws: DataFrame, as_of: dt.date, history: DataFrame | None = None) -> DataFrame:
    """One scan: merchant grain (conditional counts / moments) + SKU grain
    (completed gross in 90 d, for the HHI), folded per merchant.

    With ``history`` (as ``webshop_history`` gives it) orders are read for the last 90 days only; the orders of months
    before that of ``as_of`` are counted by the history."""
    w = ws.filter(F.col("order_date") <= F.lit(as_of))
    month_start = as_of.replace(day=1)
    fresh = F.lit(True)
    if history is not None:
        w = w.filter(in_window(F.col("order_date"), as_of, 90) | (F.col("order_date") >= F.lit(month_start)))
        fresh = F.col("order_date") >= F.lit(month_start)
    in90 = in_window(F.col("order_date"), as_of, 90)
    status = F.col("status")
    comp = in90 & (status == "completed")
    gross_c = cents(F.col("gross_amount"))  # ratios of cents: the unit falls out
    x = tag_grains(w, grain("m"), grain("s", k_str=F.col("sku_id"), when=comp & F.col("sku_id").isNotNull()))
    m = lambda v: F.when(F.col("g") == "m", v)
    aggs = [
        F.sum(gross_c).alias("grain_gross"),
        F.count(m(F.when(fresh, F.lit(1)))).alias("ws_rows_all"),
        F.count(m(F.when(in90, F.lit(1)))).alias("ws_n90"),
        F.count(m(F.when(in90 & (status == "cancelled"), F.lit(1)))).alias("ws_cancelled"),
        F.count(m(F.when(in90 & (status == "returned"), F.lit(1)))).alias("ws_returned"),
        F.sum(m(F.when(in90, F.col("is_repeat_customer").cast("double")))).alias("ws_repeat_sum"),
        F.count(m(F.when(in90, F.col("is_repeat_customer")))).alias("ws_repeat_n"),
        F.count(m(F.when(comp, F.lit(1)))).alias("ws_comp_n"),
        F.count(m(F.when(comp & (F.col("fulfillment_days") <= 3), F.lit(1)))).alias("ws_comp_fast"),
        F.sum(m(F.when(comp, gross_c))).alias("ws_comp_s1"),
        F.sum(m(F.when(comp, gross_c.cast("double") * gross_c.cast("double")))).alias("ws_comp_s2"),
        F.sum(m(F.when(comp, cents(F.col("discount_amount"))))).alias("ws_comp_discount"),
    ]
    for k, v in weekly_slope_stats(F.col("order_date"), F.lit(1), (F.col("g") == "m") & in90).items():
        aggs.append(v.alias(f"wsw_{k}"))
    g = x.groupBy("merchant_id", *GRAIN_KEYS).agg(*aggs)
    base = [c for c in g.columns if c.startswith("ws") and c != "ws_rows_all"]
    if history is not None:
        old = history.filter(F.col("month") < F.lit(month_start)).select(
            "merchant_id", F.lit("t").alias("g"), F.col("n").alias("ws_rows_all"))
        g = g.unionByName(old, allowMissingColumns=True)
    v = dbl(F.col("grain_gross"))
    out = g.groupBy("merchant_id").agg(*[F.max(at("m", F.col(c))).alias(c) for c in base],
                                       F.sum(F.when(F.col("g").isin("m", "t"), F.col("ws_rows_all"))).alias("ws_rows_all"),
                                       F.coalesce(F.max(at("m", F.col("ws_n90"))), F.lit(0)).alias("_n90"),
                                       F.sum(at("s", v * v)).alias("sku_sq"), F.sum(at("s", v)).alias("sku_total"))
    out = out.withColumn("ws_n90", F.col("_n90")).drop("_n90")
    return out.withColumn("ws_repeat", F.try_divide(F.col("ws_repeat_sum"), F.col("ws_repeat_n"))) \
              .drop("ws_repeat_sum", "ws_repeat_n")


def webshop_feature_columns() -> dict[str, Column]:
    c = F.col
    ok = F.coalesce(c("ws_n90"), F.lit(0)) >= WEBSHOP_MIN_ORDERS_90D
    n = dbl(c("ws_n90"))
    comp_n = c("ws_comp_n")
    rev = dbl(c("ws_comp_s1"))
    f = {
        "cancellation_rate_90d": F.try_divide(dbl(c("ws_cancelled")), n),
        "return_rate_90d": F.try_divide(dbl(c("ws_returned")), n),
        "order_volume_trend_90d": weekly_slope("wsw"),
        "fulfillment_timeliness_pct": F.when(comp_n > 0, dbl(c("ws_comp_fast")) / dbl(comp_n)).otherwise(F.lit(0.0)),
        "repeat_customer_rate_90d": c("ws_repeat"),
        "aov_stability_cv": F.when(comp_n > 1, cv(comp_n, rev / dbl(comp_n),
                                                  sample_std_from_moments(comp_n, c("ws_comp_s1"), c("ws_comp_s2"))))
                             .otherwise(F.lit(0.50)),
        "sku_concentration_hhi": F.when(comp_n > 0, hhi(c("sku_sq"), c("sku_total"))).otherwise(F.lit(1.0)),
        "discount_intensity_90d": F.when(rev > 0, dbl(c("ws_comp_discount")) / rev).otherwise(F.lit(0.20)),
    }
    return {k: F.when(ok, v) for k, v in f.items()}


# ------------------------------------------------------------ marketplace (H)
def marketplace_stats(mp: DataFrame, as_of: dt.date) -> DataFrame:
    """One scan of the monthly snapshots: month index among the 180-day rows
    (window bounded by months x marketplaces), then one conditional fold."""
    m = mp.filter(F.col("month") <= F.lit(as_of))
    in180 = in_window(F.col("month"), as_of, 180)
    in90 = in_window(F.col("month"), as_of, 90)
    idx = F.row_number().over(Window.partitionBy("merchant_id", in180).orderBy("month", "marketplace")) - 1
    m = m.withColumn("_in180", in180).withColumn("_idx", idx.cast("double"))
    six = F.col("_in180")
    s6 = lambda v: F.when(six, v)
    health = F.col("account_health_score")
    return m.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("mp_rows_all"),
        F.count(F.when(in90, F.lit(1))).alias("mp_n90"),
        F.max(F.when(in90, F.col("payout_hold_active").cast("int"))).alias("mp_hold90"),
        F.count(s6(F.lit(1))).alias("mp_n180"),
        F.avg(s6(health)).alias("mp_health_avg"),
        F.regr_slope(s6(health), s6(F.col("_idx"))).alias("mp_health_slope"),
        F.count(s6(health)).alias("mp_health_n"),
        F.sum(s6(F.col("order_count"))).alias("mp_orders"),
        F.sum(s6(F.col("late_shipment_count"))).alias("mp_late"),
        F.sum(s6(F.col("negative_feedback_count"))).alias("mp_neg"),
        F.sum(s6(F.col("policy_violation_count"))).alias("mp_viol"),
        F.avg(s6(F.col("marketplace_gmv_share"))).alias("mp_share"),
        F.avg(s6(F.col("payout_lag_days"))).alias("mp_lag"),
    )


def marketplace_feature_columns() -> dict[str, Column]:
    c = F.col
    ok = F.coalesce(c("mp_n180"), F.lit(0)) > 0
    orders = c("mp_orders")
    f = {
        "marketplace_account_health_avg": c("mp_health_avg"),
        # a month without a value leaves the trend to its default
        "marketplace_account_health_trend": F.when(
            c("mp_health_n") == c("mp_n180"),
            slope_normalized_observed(c("mp_health_n"), c("mp_health_slope"), c("mp_health_avg"))),
        "marketplace_payout_hold_flag": F.when(c("mp_n90") > 0, F.coalesce(c("mp_hold90") == 1, F.lit(False)))
                                         .otherwise(F.lit(True)),
        "marketplace_late_shipment_rate": F.when(orders > 0, dbl(c("mp_late")) / dbl(orders)).otherwise(F.lit(0.20)),
        "marketplace_negative_feedback_rate": F.when(orders > 0, dbl(c("mp_neg")) / dbl(orders)).otherwise(F.lit(0.10)),
        "marketplace_policy_violations_6m": F.coalesce(c("mp_viol"), F.lit(0)).cast("int"),
        "marketplace_gmv_share": c("mp_share"),
        "marketplace_payout_lag_avg": c("mp_lag"),
    }
    return {k: F.when(ok, v) for k, v in f.items()}


# ------------------------------------------------------------- accounting (I)
def accounting_stats(acc: DataFrame, as_of: dt.date) -> DataFrame:
    """One scan of the monthly records: month index among the 180-day rows, then one fold."""
    a = acc.filter(F.col("month") <= F.lit(as_of))
    in180 = in_window(F.col("month"), as_of, 180)
    idx = F.row_number().over(Window.partitionBy("merchant_id", in180).orderBy("month")) - 1
    a = a.withColumn("_in180", in180).withColumn("_idx", idx.cast("double"))
    s6 = lambda v: F.when(F.col("_in180"), v)
    gm = dbl(F.col("gross_margin"))
    due = F.col("btw_due") > 0
    return a.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("acc_rows_all"),
        F.count(s6(F.lit(1))).alias("acc_n180"),
        # exact sum of the stored margins, then one division: partition-order independent
        F.try_divide(dbl(F.sum(s6(F.col("gross_margin")))), dbl(F.count(s6(F.col("gross_margin"))))).alias("acc_gm_avg"),
        F.regr_slope(s6(gm), s6(F.col("_idx"))).alias("acc_gm_slope"),
        F.count(s6(gm)).alias("acc_gm_n"),
        F.sum(s6(F.col("gross_revenue"))).alias("acc_rev"),
        F.sum(s6(F.col("ebitda"))).alias("acc_ebitda"),
        F.sum(s6(F.col("owner_draws"))).alias("acc_draws"),
        F.count(s6(F.when(due, F.lit(1)))).alias("acc_due_n"),
        F.avg(s6(F.when(due, F.col("btw_paid_on_time").cast("double")))).alias("acc_vat"),
        F.avg(s6(F.col("ap_days"))).alias("acc_ap"),
        F.avg(s6(F.col("ar_days"))).alias("acc_ar"),
        F.avg(s6(F.col("revenue_bank_delta"))).alias("acc_rbd"),
    )


def accounting_feature_columns() -> dict[str, Column]:
    c = F.col
    ok = F.coalesce(c("acc_n180"), F.lit(0)) > 0
    rev = dbl(c("acc_rev"))
    f = {
        "gross_margin_avg_6m": c("acc_gm_avg"),
        "gross_margin_trend": F.when(
            c("acc_gm_n") == c("acc_n180"),
            slope_normalized_observed(c("acc_gm_n"), c("acc_gm_slope"), c("acc_gm_avg"))),
        "ebitda_margin_avg": F.when(rev > 0, dbl(c("acc_ebitda")) / rev).otherwise(F.lit(0.0)),
        "vat_punctuality": F.when(c("acc_due_n") > 0, c("acc_vat")).otherwise(F.lit(1.0)),
        "ap_days_avg": c("acc_ap"),
        "ar_days_avg": c("acc_ar"),
        "revenue_bank_delta_avg": c("acc_rbd"),
        "owner_draw_ratio_6m": F.when(rev > 0, dbl(c("acc_draws")) / rev).otherwise(F.lit(0.0)),
    }
    return {k: F.when(ok, v) for k, v in f.items()}


# -------------------------------------------------------------------- KYC (J)
def kyc_latest(kyc: DataFrame) -> DataFrame:
    """One KYC row per merchant, the latest ``last_kyc_date`` (ties by kvk number)."""
    # latest date first, then the smallest kvk number; nulls last in both
    days = F.datediff(F.col("last_kyc_date"), F.lit(dt.date(1970, 1, 1)))
    order = F.struct(F.coalesce(-days, F.lit(2 ** 31 - 1)), F.coalesce(F.col("kvk_number"), F.lit("\uffff")))
    cols = [c for c in kyc.columns if c != "merchant_id"]
    return (kyc.groupBy("merchant_id").agg(F.min_by(F.struct(*cols), order).alias("_k"))
            .select("merchant_id", "_k.*"))


def kyc_stats(kyc: DataFrame, as_of: dt.date) -> DataFrame:
    instead = {c: v for c, v in KYC_ABSENT.items() if is_absent(kyc, c)}
    value = lambda c: F.lit(instead[c]) if c in instead else F.col(c)
    days = value("last_kyc_date") if "last_kyc_date" in instead else dbl(F.datediff(F.lit(as_of), F.col("last_kyc_date")))
    k = kyc_latest(kyc)
    level = F.col("verification_level")
    score = F.lit(KYC_LEVEL_SCORES["basic"])
    for name, val in reversed(list(KYC_LEVEL_SCORES.items())):
        score = F.when(level == name, F.lit(val)).otherwise(score)
    return k.select(
        "merchant_id",
        F.lit(1).alias("kyc_rows"),
        value("ubo_director_match").alias("kyc_ubo_match"),
        value("ubo_verified").alias("kyc_ubo_verified"),
        value("identity_changes_12m").alias("kyc_id_changes"),
        days.alias("kyc_days"),
        score.alias("kyc_level_score"),
    )


def kyc_feature_columns() -> dict[str, Column]:
    c = F.col
    return {
        "ubo_director_match": c("kyc_ubo_match"),
        "ubo_verified": c("kyc_ubo_verified"),
        "identity_changes_12m": c("kyc_id_changes"),
        "kyc_days_since_last": c("kyc_days"),
        "kyc_verification_level_score": c("kyc_level_score"),
    }
