"""Feature registry: the 65 features, their pessimistic defaults and types.

A default fills a feature that is NULL, NaN or not produced (e.g. a merchant
without webshop orders in the last 90 days).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pessimistic default per feature (must equal the reference).
DEFAULTS: dict[str, float | int | bool] = {
    "cancellation_rate_90d": 0.10,
    "return_rate_90d": 0.15,
    "order_volume_trend_90d": -0.10,
    "fulfillment_timeliness_pct": 0.70,
    "repeat_customer_rate_90d": 0.20,
    "aov_stability_cv": 0.50,
    "sku_concentration_hhi": 1.0,
    "discount_intensity_90d": 0.20,
    "marketplace_account_health_avg": 0.0,
    "marketplace_account_health_trend": -0.10,
    "marketplace_payout_hold_flag": True,
    "marketplace_late_shipment_rate": 0.20,
    "marketplace_negative_feedback_rate": 0.10,
    "marketplace_policy_violations_6m": 3,
    "marketplace_gmv_share": 0.0,
    "marketplace_payout_lag_avg": 14.0,
    "gross_margin_avg_6m": 0.0,
    "gross_margin_trend": -0.10,
    "ebitda_margin_avg": -0.10,
    "vat_punctuality": 0.0,
    "ap_days_avg": 90.0,
    "ar_days_avg": 60.0,
    "revenue_bank_delta_avg": 0.20,
    "owner_draw_ratio_6m": 0.20,
    "ubo_director_match": False,
    "ubo_verified": False,
    "identity_changes_12m": 3,
    "kyc_days_since_last": 730.0,
    "kyc_verification_level_score": 0.33,
    "dispute_win_rate": 0.0,
    "buyer_concentration_hhi": 1.0,
    "monthly_net_cashflow_avg_3m": 0.0,
    "monthly_net_cashflow_avg_6m": 0.0,
    "cashflow_trend_delta": -0.20,
    "revenue_volatility_30d": 0.50,
    "revenue_volatility_90d": 0.50,
    "revenue_volatility_180d": 0.50,
    "revenue_volatility_delta": 0.10,
    "net_cashflow_coverage": 0.0,
    "negative_balance_pct_90d": 1.0,
    "overdraft_dependency": 1.0,
    "days_cash_on_hand": 0.0,
    "inflow_concentration_hhi": 1.0,
    "settlement_delay_p95": 12.0,
    "settlement_delay_median": 5.0,
    "settlement_delay_std": 5.0,
    "settlement_timing_variability": 1.0,
    "supplier_pay_punctuality": 0.50,
    "supplier_payout_lumpiness": 1.0,
    "refund_rate_30d": 0.10,
    "refund_rate_90d": 0.10,
    "refund_rate_ltm": 0.10,
    "chargeback_rate_30d": 0.02,
    "chargeback_rate_90d": 0.02,
    "chargeback_rate_ltm": 0.02,
    "refund_trend_3m": 0.0,
    "platform_concentration": 1.0,
    "seasonality_index": 2.0,
    "gpv_trend_90d": -0.10,
    "payment_method_card_pct": 0.25,
    "ad_spend_ratio_3m": 0.35,
    "bank_psp_recon_delta": 1.0,
    "data_coverage_score": 0.0,
    "trading_months": 0.0,
    "monthly_gmv_avg_6m": 0.0,
}

# The 54 shadow-model inputs, in model order.
ML_FEATURES: list[str] = [
    "monthly_net_cashflow_avg_3m", "monthly_net_cashflow_avg_6m", "cashflow_trend_delta",
    "revenue_volatility_30d", "revenue_volatility_90d", "revenue_volatility_180d",
    "revenue_volatility_delta", "net_cashflow_coverage", "negative_balance_pct_90d",
    "overdraft_dependency", "days_cash_on_hand", "inflow_concentration_hhi",
    "settlement_delay_p95", "settlement_delay_median", "settlement_timing_variability",
    "supplier_pay_punctuality", "supplier_payout_lumpiness",
    "refund_rate_30d", "refund_rate_ltm", "chargeback_rate_30d", "chargeback_rate_ltm",
    "refund_trend_3m", "dispute_win_rate", "buyer_concentration_hhi",
    "platform_concentration", "seasonality_index", "gpv_trend_90d", "payment_method_card_pct",
    "ad_spend_ratio_3m",
    "bank_psp_recon_delta", "data_coverage_score",
    "cancellation_rate_90d", "return_rate_90d", "fulfillment_timeliness_pct",
    "repeat_customer_rate_90d", "aov_stability_cv", "sku_concentration_hhi", "discount_intensity_90d",
    "marketplace_account_health_avg", "marketplace_late_shipment_rate",
    "marketplace_negative_feedback_rate", "marketplace_gmv_share",
    "gross_margin_avg_6m", "gross_margin_trend", "ebitda_margin_avg", "vat_punctuality",
    "ap_days_avg", "revenue_bank_delta_avg", "owner_draw_ratio_6m",
    "identity_changes_12m", "kyc_days_since_last", "kyc_verification_level_score",
    "monthly_gmv_avg_6m", "trading_months",
]

BOOL_FEATURES = {k for k, v in DEFAULTS.items() if isinstance(v, bool)}
INT_FEATURES = {"marketplace_policy_violations_6m", "identity_changes_12m"}
DOUBLE_FEATURES = [k for k in DEFAULTS if k not in BOOL_FEATURES and k not in INT_FEATURES]

# Output column order of the feature table: keys, the 65 registry features,
# then the merchant / application pass-through fields.
PASS_THROUGH = ["kvk_active", "sanctions_hit", "requested_amount", "requested_tenor_months"]
FEATURE_COLUMNS = list(DEFAULTS)


def spark_type(name: str) -> str:
    if name in BOOL_FEATURES:
        return "boolean"
    if name in INT_FEATURES:
        return "int"
    return "double"


def with_default(name: str, c: Column) -> Column:
    """NULL or NaN -> registry default; cast to the registry type."""
    t = spark_type(name)
    v = c.cast(t)
    if t == "double":
        v = F.nanvl(v, F.lit(None).cast("double"))
    return F.coalesce(v, F.lit(DEFAULTS[name]).cast(t))
