"""Canonical source schemas, required columns and data-quality specs.

Engine code only sees these schemas; the adapters in ``quire.sources.adapters``
map other layouts onto them. Money is decimal(18,2) so that sums are exact and
independent of partitioning; ratios are computed in double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: The column that orders the postings of a day.
POSTING_ORDER = "posting_seq"

S = T.StringType()
D = T.DateType()
DBL = T.DoubleType()
I = T.IntegerType()
L = T.LongType()
B = T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "merchants": _schema(
        ("merchant_id", S), ("company_name", S), ("kvk_number", S), ("incorporation_date", D),
        ("annual_gmv", DBL), ("n_psps", I), ("sector", S), ("sanctions_hit", B), ("kvk_active", B),
        ("is_bad_synthetic", B), ("has_webshop", B), ("primary_marketplace", S)),
    "applications": _schema(
        ("application_id", S), ("merchant_id", S), ("requested_amount", I),
        ("requested_tenor_months", I), ("purpose", S), ("application_date", D)),
    "bank": _schema(
        ("transaction_id", S), ("merchant_id", S), ("date", D), ("amount", MONEY), ("direction", S),
        ("counterparty_name", S), ("category", S), ("balance_after", MONEY), ("posting_seq", L)),
    "psp": _schema(
        ("psp_transaction_id", S), ("merchant_id", S), ("psp_name", S), ("order_date", D),
        ("settlement_date", D), ("gross_amount", MONEY), ("fee_amount", MONEY), ("net_amount", MONEY),
        ("status", S), ("refund_amount", MONEY), ("payment_method", S), ("buyer_id", S),
        ("dispute_outcome", S)),
    "webshop": _schema(
        ("order_id", S), ("merchant_id", S), ("order_date", D), ("channel", S), ("gross_amount", MONEY),
        ("discount_amount", MONEY), ("item_count", I), ("sku_id", S), ("status", S),
        ("fulfillment_days", I), ("is_repeat_customer", B), ("customer_id", S)),
    "marketplace": _schema(
        ("merchant_id", S), ("marketplace", S), ("month", D), ("gmv", MONEY), ("order_count", L),
        ("cancelled_count", L), ("late_shipment_count", L), ("return_count", L),
        ("negative_feedback_count", L), ("account_health_score", DBL), ("payout_hold_active", B),
        ("payout_lag_days", DBL), ("policy_violation_count", L), ("marketplace_gmv_share", DBL)),
    "accounting": _schema(
        ("merchant_id", S), ("month", D), ("gross_revenue", MONEY), ("cogs", MONEY),
        ("gross_profit", MONEY), ("gross_margin", DBL), ("total_opex", MONEY), ("ebitda", MONEY),
        ("accounts_receivable", MONEY), ("accounts_payable", MONEY), ("ap_days", DBL), ("ar_days", DBL),
        ("cash_balance", MONEY), ("btw_accrued", MONEY), ("btw_due", MONEY), ("btw_paid", MONEY),
        ("btw_paid_on_time", B), ("owner_draws", MONEY), ("revenue_bank_delta", DBL)),
    "kyc": _schema(
        ("merchant_id", S), ("kvk_number", S), ("kvk_verified", B), ("ubo_name", S), ("ubo_verified", B),
        ("ubo_director_match", B), ("pep_match", B), ("sanctions_match", B),
        ("identity_changes_12m", I), ("last_kyc_date", D), ("verification_level", S)),
}

# Required column names per source (must equal the reference).
REQUIRED_COLUMNS: dict[str, list[str]] = {
    "bank": ["transaction_id", "merchant_id", "date", "amount", "direction", "counterparty_name",
             "category", "balance_after"],
    "psp": ["psp_transaction_id", "merchant_id", "psp_name", "order_date", "settlement_date",
            "gross_amount", "fee_amount", "net_amount", "status", "refund_amount"],
    "webshop": ["order_id", "merchant_id", "order_date", "channel", "gross_amount", "discount_amount",
                "item_count", "sku_id", "status", "fulfillment_days", "is_repeat_customer", "customer_id"],
    "marketplace": ["merchant_id", "marketplace", "month", "gmv", "order_count", "cancelled_count",
                    "late_shipment_count", "return_count", "negative_feedback_count",
                    "account_health_score", "payout_hold_active", "payout_lag_days",
                    "policy_violation_count", "marketplace_gmv_share"],
    "accounting": ["merchant_id", "month", "gross_revenue", "cogs", "gross_profit", "gross_margin",
                   "total_opex", "ebitda", "accounts_receivable", "accounts_payable", "ap_days",
                   "ar_days", "cash_balance", "btw_accrued", "btw_due", "btw_paid", "btw_paid_on_time",
                   "owner_draws", "revenue_bank_delta"],
    "kyc": ["merchant_id", "kvk_number", "kvk_verified", "ubo_name", "ubo_verified",
            "ubo_director_match", "pep_match", "sanctions_match", "identity_changes_12m",
            "last_kyc_date", "verification_level"],
}

# Columns whose null rate must stay at or below 1%.
NULL_CHECK_COLUMNS: dict[str, list[str]] = {
    "bank": ["merchant_id", "date", "amount"],
    "psp": ["merchant_id", "order_date", "gross_amount", "status"],
    "webshop": ["merchant_id", "order_date", "gross_amount", "status"],
    "marketplace": ["merchant_id", "month", "gmv", "account_health_score"],
    "accounting": ["merchant_id", "month", "gross_revenue", "gross_margin"],
    "kyc": ["merchant_id", "kvk_number", "ubo_director_match"],
}

# Allowed enum domains (column, allowed values).
ENUM_DOMAINS: dict[str, tuple[str, list[str]]] = {
    "psp": ("status", ["paid", "refunded", "chargeback", "failed"]),
    "webshop": ("status", ["completed", "cancelled", "returned"]),
    "marketplace": ("marketplace", ["bol.com", "amazon"]),
    "kyc": ("verification_level", ["basic", "enhanced", "full"]),
}

# Minimum history span in days, by source and date column.
MIN_HISTORY_DAYS: dict[str, tuple[str, int]] = {
    "bank": ("date", 180),
    "psp": ("order_date", 180),
    "webshop": ("order_date", 90),
}

NULL_RATE_MAX = 0.01
ACCOUNTING_MIN_MONTHS = 3
MARGIN_OUT_OF_RANGE_MAX = 0.01

# Date column used for the as-of upper bound at scan time.
AS_OF_COLUMN: dict[str, str] = {
    "bank": "date", "psp": "order_date", "webshop": "order_date",
    "marketplace": "month", "accounting": "month",
}

OPTIONAL_SOURCES = ("webshop", "marketplace", "accounting", "kyc")

#: Field metadata that marks a column which the source does not have.
ABSENT = "absent"


def is_absent(df: DataFrame, column: str) -> bool:
    """Whether the source lacks the column: it is not there, or stands in as NULLs only."""
    return column not in df.columns or bool(df.schema[column].metadata.get(ABSENT))


def completed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a typed NULL column, marked as absent, for each canonical column that it lacks. The place of a
    bank posting is not made up: ``quire.sources.registry.in_file_order`` takes it from the files."""
    lacking = [f for f in SCHEMAS[name].fields if f.name not in df.columns and f.name != POSTING_ORDER]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name, metadata={ABSENT: True}) for f in lacking])
