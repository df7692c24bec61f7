"""Feature-table assembly (J2, A12, F1-F3, X1-X3): one row per loan application.

Every family produces per-merchant statistics keyed by ``merchant_id``; they
are left-joined onto the application spine and turned into features by one
projection. Each family aggregate ends hash-partitioned on merchant_id, so the
joins line up on that partitioning instead of re-shuffling the facts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.expr import dbl
from quire.operators.features.bank import bank_feature_columns, bank_history, bank_stats
from quire.operators.features.psp import psp_feature_columns, psp_history, psp_stats
from quire.operators.features.registry import DEFAULTS, FEATURE_COLUMNS, with_default
from quire.operators.features.sources_gmak import (accounting_feature_columns, accounting_stats,
                                                   kyc_feature_columns, kyc_stats, marketplace_feature_columns,
                                                   marketplace_stats, webshop_feature_columns, webshop_history,
                                                   webshop_stats)
from quire.sources.registry import empty_source, ready

# Fixed value: days per month used for trading history.
DAYS_PER_MONTH = 30.44
RECON_MAX_DELTA = 0.20


def spine(merchants: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications joined to the first merchant row per merchant_id (inner)."""
    # first row by (company_name, kvk_number): a partial aggregate, not a per-merchant window
    order = F.struct(F.coalesce(F.col("company_name"), F.lit("\uffff")), F.coalesce(F.col("kvk_number"), F.lit("\uffff")))
    m = (merchants.groupBy("merchant_id")
         .agg(F.min_by(F.struct("incorporation_date", "kvk_active", "sanctions_hit"), order).alias("_m"))
         .select("merchant_id", "_m.*"))
    a = applications.select("application_id", "merchant_id", "requested_amount", "requested_tenor_months")
    return a.join(m, "merchant_id", "inner")


FAMILY_STATS = {"bank": bank_stats, "psp": psp_stats, "webshop": webshop_stats, "marketplace": marketplace_stats,
                "accounting": accounting_stats, "kyc": kyc_stats}


#: Families whose statistics can take a stored history in place of old rows.
FAMILY_HISTORY = {"bank": bank_history, "psp": psp_history, "webshop": webshop_history}


def family_stats(sources: Mapping[str, DataFrame], as_of: dt.date, families: Sequence[str] = tuple(FAMILY_STATS),
                 history: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Per-merchant statistics of the given families; only their sources are touched. With ``history`` (monthly
    partial aggregates by family, see ``quire.sources.store``) old rows are not read."""
    spark = sources["merchants"].sparkSession
    get = lambda n: ready(sources[n], n) if sources.get(n) is not None else empty_source(spark, n)
    known = history or {}
    return {family: FAMILY_STATS[family](get(family), as_of, *([known[family]] if family in known else []))
            for family in families}


def joined_stats(sources: Mapping[str, DataFrame], as_of: dt.date, families: Sequence[str] = tuple(FAMILY_STATS),
                 history: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Application spine left-joined to the families' per-merchant statistics."""
    j = spine(sources["merchants"], sources["applications"])
    for stats in family_stats(sources, as_of, families, history).values():
        j = j.join(stats, "merchant_id", "left")
    return j


def feature_columns(as_of: dt.date) -> dict[str, Column]:
    """All 65 feature expressions over ``joined_stats`` (NULL = not produced).

    Bank and PSP operators always run, so a merchant without rows gets their own
    fallback values: their statistics are NULL after the left join, which is
    the all-NULL row the expressions are written for."""
    c = F.col
    z = lambda x: F.coalesce(x, F.lit(0))
    cols: dict[str, Column] = {}
    cols.update(bank_feature_columns(as_of))
    cols.update(psp_feature_columns(as_of))
    cols.update(webshop_feature_columns())
    cols.update(marketplace_feature_columns())
    cols.update(accounting_feature_columns())
    cols.update(kyc_feature_columns())
    # Cash-flow coverage of the monthly instalment; a missing 6m cash flow stays missing.
    tenor = dbl(c("requested_tenor_months"))
    instalment = F.when(tenor != 0, dbl(c("requested_amount")) / tenor)
    cols["net_cashflow_coverage"] = F.when(F.coalesce(instalment, F.lit(0.0)) > 0,
                                           cols["monthly_net_cashflow_avg_6m"] / instalment).otherwise(F.lit(0.0))
    # F1 / R2: bank settlement credits vs PSP paid net, all history.
    psp_net = dbl(z(c("ps_paid_net_all")))
    cols["bank_psp_recon_delta"] = F.when(
        psp_net > 0, F.abs(dbl(z(c("bk_psp_settle_all"))) - psp_net) / psp_net).otherwise(F.lit(1.0))
    # data coverage, 8 tests over row counts.
    tests = [z(c("bk_rows_all")) >= 30, z(c("ps_rows_all")) >= 30, z(c("bk_rows_all")) >= 180,
             z(c("ps_paid_all")) >= 10, z(c("ws_rows_all")) >= 10, z(c("mp_rows_all")) > 0,
             z(c("acc_rows_all")) > 0, z(c("kyc_rows")) > 0]
    cols["data_coverage_score"] = dbl(sum((t.cast("int") for t in tests), F.lit(0))) / F.lit(8.0)
    # trading history in months.
    cols["trading_months"] = dbl(F.datediff(F.lit(as_of), c("incorporation_date"))) / DAYS_PER_MONTH
    assert set(cols) == set(FEATURE_COLUMNS), set(FEATURE_COLUMNS) ^ set(cols)
    return cols


def compute_features(sources: Mapping[str, DataFrame], as_of: dt.date, apply_defaults: bool = True,
                     history: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The 70-field feature table (plus application_id), one row per application.

    ``sources`` maps canonical names (merchants, applications, bank, psp,
    webshop, marketplace, accounting, kyc) to DataFrames; optional sources may
    be missing or None. With ``history`` the bank, PSP and webshop rows of the
    last 365 days are read, and older ones come as monthly partial aggregates."""
    return featured(joined_stats(sources, as_of, history=history), as_of, apply_defaults)


def featured(j: DataFrame, as_of: dt.date, apply_defaults: bool = True) -> DataFrame:
    """The feature table from the spine with all families' statistics; one projection."""
    cols = feature_columns(as_of)
    c = F.col
    out = [c("application_id"), c("merchant_id")]
    for name in FEATURE_COLUMNS:
        out.append((with_default(name, cols[name]) if apply_defaults else cols[name]).alias(name))
    out += [F.coalesce(c("kvk_active"), F.lit(False)).alias("kvk_active"),
            F.coalesce(c("sanctions_hit"), F.lit(False)).alias("sanctions_hit"),
            dbl(c("requested_amount")).alias("requested_amount"),
            dbl(c("requested_tenor_months")).alias("requested_tenor_months")]
    return j.select(*out)


def defaulted(raw: DataFrame) -> DataFrame:
    """A raw feature table with the registry's defaults; one projection."""
    return raw.select(*[with_default(c, F.col(c)).alias(c) if c in FEATURE_COLUMNS else F.col(c) for c in raw.columns])


def family_features(sources: dict[str, DataFrame], as_of: dt.date, family: str) -> DataFrame:
    """One family's raw features (before defaults) for every application, from the sources it needs."""
    j = joined_stats(sources, as_of, tuple(FAMILY_STATS) if family == "cross" else (family,))
    cols = feature_columns(as_of)
    names = FAMILY_FEATURES[family]
    return j.select("application_id", "merchant_id", *[cols[n].alias(n) for n in names])


FAMILY_FEATURES: dict[str, list[str]] = {
    "bank": ["monthly_net_cashflow_avg_3m", "monthly_net_cashflow_avg_6m", "cashflow_trend_delta",
             "revenue_volatility_30d", "revenue_volatility_90d", "revenue_volatility_180d",
             "revenue_volatility_delta", "negative_balance_pct_90d", "days_cash_on_hand", "overdraft_dependency",
             "inflow_concentration_hhi", "supplier_pay_punctuality", "supplier_payout_lumpiness",
             "seasonality_index", "ad_spend_ratio_3m", "monthly_gmv_avg_6m"],
    "psp": ["settlement_delay_p95", "settlement_delay_median", "settlement_delay_std",
            "settlement_timing_variability", "refund_rate_30d", "refund_rate_90d", "refund_rate_ltm",
            "chargeback_rate_30d", "chargeback_rate_90d", "chargeback_rate_ltm", "refund_trend_3m",
            "platform_concentration", "gpv_trend_90d", "payment_method_card_pct", "dispute_win_rate",
            "buyer_concentration_hhi"],
    "webshop": ["cancellation_rate_90d", "return_rate_90d", "order_volume_trend_90d", "fulfillment_timeliness_pct",
                "repeat_customer_rate_90d", "aov_stability_cv", "sku_concentration_hhi", "discount_intensity_90d"],
    "marketplace": ["marketplace_account_health_avg", "marketplace_account_health_trend",
                    "marketplace_payout_hold_flag", "marketplace_late_shipment_rate",
                    "marketplace_negative_feedback_rate", "marketplace_policy_violations_6m",
                    "marketplace_gmv_share", "marketplace_payout_lag_avg"],
    "accounting": ["gross_margin_avg_6m", "gross_margin_trend", "ebitda_margin_avg", "vat_punctuality",
                   "ap_days_avg", "ar_days_avg", "revenue_bank_delta_avg", "owner_draw_ratio_6m"],
    "kyc": ["ubo_director_match", "ubo_verified", "identity_changes_12m", "kyc_days_since_last",
            "kyc_verification_level_score"],
    "cross": ["net_cashflow_coverage", "bank_psp_recon_delta", "data_coverage_score", "trading_months"],
}

assert len(DEFAULTS) == sum(len(v) for v in FAMILY_FEATURES.values())
