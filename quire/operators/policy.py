"""Credit policy as one projection over the feature table.

Hard knockouts, 15 scored gates, the decision ladder, loan sizing, pricing
and the decision envelope are column expressions: no UDF, no per-row Python,
no shuffle. Gates are a table by policy version; the scorecard and the oracle
read the same thresholds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.features.registry import FEATURE_COLUMNS

# Loan product and decision thresholds (must equal the reference).
LOAN_MIN_EUR = 10_000
HARD_CAP_EUR = 25_000
TENOR_MIN_MONTHS = 3
TENOR_MAX_MONTHS = 18
PRICING_BANDS = {"A": 0.110, "B": 0.125, "C": 0.140}
PRICING_A_MAX_AMBER = 1
PRICING_A_MIN_COVERAGE = 2.0
PRICING_C_MAX_COVERAGE = 1.5
MIN_TRADING_MONTHS = 24
MIN_MONTHLY_GMV = 25_000
MAX_RECON_DELTA = 0.20
MAX_NEGATIVE_BALANCE_PCT = 0.50
RED_DECLINE_THRESHOLD = 3
RED_MANUAL_THRESHOLD = 2
TOTAL_FLAGS_MANUAL_THRESHOLD = 5
CASHFLOW_DEBT_SERVICE_RATIO = 0.33
REVENUE_ANCHOR_MULTIPLIER = 2.5
SHADOW_NOTE_THRESHOLD = 0.3
MODEL_VERSION = "champion_v1.0"

# Scored gates in evaluation order: (feature, green, red, type, reason code).
GATES: list[tuple[str, float, float, str, str]] = [
    ("revenue_volatility_90d", 0.25, 0.45, "standard", "HIGH_REV_VOLATILITY"),
    ("net_cashflow_coverage", 1.80, 1.20, "inverted", "WEAK_CASHFLOW_COVERAGE"),
    ("supplier_pay_punctuality", 0.90, 0.70, "inverted", "LATE_SUPPLIER_PAYMENTS"),
    ("ad_spend_ratio_3m", 0.15, 0.30, "standard", "HIGH_AD_DEPENDENCY"),
    ("refund_rate_ltm", 0.03, 0.08, "standard", "HIGH_REFUND_RATE"),
    ("chargeback_rate_ltm", 0.005, 0.015, "standard", "HIGH_CHARGEBACKS"),
    ("settlement_delay_p95", 5, 10, "standard", "SETTLEMENT_DELAYS"),
    ("platform_concentration", 0.40, 0.65, "standard", "PLATFORM_CONCENTRATION"),
    ("vat_punctuality", 0.90, 0.70, "inverted", "LOW_VAT_PUNCTUALITY"),
    ("gross_margin_avg_6m", 0.35, 0.15, "inverted", "LOW_GROSS_MARGIN"),
    ("revenue_bank_delta_avg", 0.05, 0.15, "standard", "REVENUE_INFLATION_SIGNAL"),
    ("marketplace_account_health_avg", 8.0, 5.0, "inverted", "POOR_MARKETPLACE_HEALTH"),
    ("marketplace_late_shipment_rate", 0.02, 0.08, "standard", "HIGH_LATE_SHIPMENT_RATE"),
    ("cancellation_rate_90d", 0.03, 0.08, "standard", "HIGH_CANCELLATION_RATE"),
    ("return_rate_90d", 0.05, 0.12, "standard", "HIGH_RETURN_RATE"),
]

#: The gates by policy version; ``apply_policy`` takes other versions as a table of the same columns.
POLICY_VERSION = "v1"
GATE_COLUMNS = "version string, position int, feature string, green double, red double, type string, code string"

# Reason code -> explanation text.
REASON_EXPLANATIONS: dict[str, str] = {
    "INSUFFICIENT_HISTORY": "Business has less than 24 months of trading history.",
    "KVK_INVALID": "KvK registration is not active.",
    "RECON_FAIL": "Bank and PSP records show >20% revenue mismatch — possible data integrity issue.",
    "PERSISTENT_NEGATIVE_BALANCE": "Bank account was negative on >50% of the last 90 days.",
    "SANCTIONS_HIT": "Sanctions or PEP screening returned a positive match.",
    "REVENUE_TOO_LOW": "Average monthly GMV is below EUR 25,000 minimum threshold.",
    "HIGH_REV_VOLATILITY": "Revenue volatility (CV) exceeds 0.45 over the past 90 days.",
    "HIGH_REFUND_RATE": "Refund rate exceeds 8% of gross revenue over the last 12 months.",
    "SETTLEMENT_DELAYS": "95th-percentile settlement delay exceeds 10 days.",
    "HIGH_CHARGEBACKS": "Chargeback rate exceeds 1.5% of transactions.",
    "PLATFORM_CONCENTRATION": "Revenue is highly concentrated on a single platform (HHI > 0.65).",
    "WEAK_CASHFLOW_COVERAGE": "Net monthly cashflow covers less than 1.2x the loan instalment.",
    "LATE_SUPPLIER_PAYMENTS": "Less than 70% of supplier payments are made on time.",
    "HIGH_AD_DEPENDENCY": "Advertising spend exceeds 30% of revenue in the last 3 months.",
    "NO_BANK_DATA": "No bank transaction data available — cannot underwrite.",
    "LIMITED_DATA": "PSP data unavailable; max loan amount capped at EUR 15,000.",
    "YEAR1_CAP": "Year-1 pilot: maximum loan amount capped at EUR 25,000.",
    "UBO_MISMATCH": "UBO / director identity mismatch — application declined pending KYC resolution.",
    "LOW_VAT_PUNCTUALITY": "BTW/VAT payments are late or incomplete in 30%+ of filing periods.",
    "LOW_GROSS_MARGIN": "Gross margin is below 15% — insufficient buffer for debt service.",
    "REVENUE_INFLATION_SIGNAL": "Accounting revenue exceeds bank credits by >15% — reconciliation required.",
    "POOR_MARKETPLACE_HEALTH": "Marketplace account health score below 5.0 — enforcement risk.",
    "HIGH_LATE_SHIPMENT_RATE": "Late shipment rate exceeds 8% — customer satisfaction risk.",
    "HIGH_CANCELLATION_RATE": "Order cancellation rate exceeds 8% — demand quality concern.",
    "HIGH_RETURN_RATE": "Return rate exceeds 12% — product or fulfilment quality concern.",
    "BELOW_MIN_LOAN_SIZE": "Calculated loan amount falls below the EUR 10,000 minimum — insufficient cashflow or GMV for this request.",
}


def _get(df: DataFrame, name: str, default) -> Column:
    """``features.get(name, default)``: an absent column takes the default;
    NaN is treated as missing (NULL) rather than as a comparable number."""
    if name not in df.columns:
        return F.lit(default)
    c = F.col(name)
    if dict(df.dtypes).get(name) in ("double", "float"):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return F.coalesce(c, F.lit(default)) if default is not None else c


def knockout_codes(df: DataFrame) -> Column:
    """K1-K8: triggered knockout codes in rule order (empty array = all passed)."""
    rules = [
        (_get(df, "sanctions_hit", False), "SANCTIONS_HIT"),
        (~_get(df, "kvk_active", False), "KVK_INVALID"),
        (~_get(df, "ubo_director_match", False), "UBO_MISMATCH"),
        (_get(df, "bank_psp_recon_delta", 1.0) > MAX_RECON_DELTA, "RECON_FAIL"),
        (_get(df, "trading_months", 0.0) < MIN_TRADING_MONTHS, "INSUFFICIENT_HISTORY"),
        (_get(df, "monthly_gmv_avg_6m", 0.0) < MIN_MONTHLY_GMV, "REVENUE_TOO_LOW"),
        (_get(df, "negative_balance_pct_90d", 1.0) > MAX_NEGATIVE_BALANCE_PCT, "PERSISTENT_NEGATIVE_BALANCE"),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]), lambda x: x.isNotNull())


def gate_table(spark: SparkSession, sets: dict[str, list[tuple]] | None = None) -> DataFrame:
    """One row per gate and policy version, in evaluation order."""
    rows = [(version, i, feature, float(green), float(red), kind, code)
            for version, gates in (sets or {POLICY_VERSION: GATES}).items()
            for i, (feature, green, red, kind, code) in enumerate(gates, 1)]
    return spark.createDataFrame(rows, GATE_COLUMNS)


def with_gates(features: DataFrame, gates: DataFrame | None = None, version: str = POLICY_VERSION) -> DataFrame:
    """``features`` with ``gates``: an array of (position, feature, value, status, code) in evaluation order.

    The gates come from a table, a few rows per policy version, and are evaluated
    as one array per application: adding a gate or a version changes rows, not
    the plan. A column ``policy_version`` of the features chooses each row's
    version, else ``version`` holds for all; a version without gates is an
    error. A missing value is the red boundary itself, which scores amber."""
    table = gates if gates is not None else gate_table(features.sparkSession)
    sets = table.groupBy(F.col("version").alias("_version")).agg(F.sort_array(F.collect_list(F.struct(
        "position", "feature", "green", "red", "type", "code"))).alias("_gates"))
    chosen = F.col("policy_version") if "policy_version" in features.columns else F.lit(version)
    named = [c for c in FEATURE_COLUMNS if c in features.columns]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in named]), F.array(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in named]))

    def evaluated(g: Column) -> Column:
        v = F.coalesce(F.element_at(F.col("_values"), g["feature"]), g["red"])
        up = g["type"] == "standard"
        status = (F.when(F.when(up, v > g["red"]).otherwise(v < g["red"]), "red")
                  .when(F.when(up, v > g["green"]).otherwise(v < g["green"]), "amber").otherwise("green"))
        return F.struct(g["position"].alias("position"), g["feature"].alias("feature"), v.alias("value"),
                        status.alias("status"), g["code"].alias("code"))

    known = F.coalesce(F.col("_gates"), F.raise_error(F.concat(F.lit("no gates of policy version "), F.col("_version"))))
    return (features.withColumn("_version", chosen).join(F.broadcast(sets), "_version", "left")  # a few rows: the versions
            .withColumn("_values", values).withColumn("gates", F.transform(known, evaluated))
            .drop("_version", "_gates", "_values"))


def apply_policy(features: DataFrame, gates: DataFrame | None = None, version: str = POLICY_VERSION) -> DataFrame:
    """Adds the policy result columns to the feature table, by the gates of a policy version (see ``with_gates``)."""
    df = with_gates(features, gates, version)
    n_gates = F.size("gates")
    of = lambda status: F.filter("gates", lambda g: g["status"] == status)
    red = F.size(of("red"))
    hold = F.when(_get(df, "marketplace_payout_hold_flag", False), 1).otherwise(0)
    amber = F.size(of("amber")) + hold
    gate_codes = F.transform(of("red"), lambda g: g["code"])
    ko = knockout_codes(df)
    df = df.withColumn("_ko", ko).withColumn("_red", red).withColumn("_amber", amber) \
           .withColumn("_gate_codes", gate_codes)
    ko_hit = F.size("_ko") > 0
    r, a = F.col("_red"), F.col("_amber")
    decision = (F.when(ko_hit, "DECLINE").when(r >= RED_DECLINE_THRESHOLD, "DECLINE")
                .when((r >= RED_MANUAL_THRESHOLD) | (r + a >= TOTAL_FLAGS_MANUAL_THRESHOLD), "MANUAL_REVIEW")
                .otherwise("APPROVE"))
    df = df.withColumn("decision", decision)
    declined = F.col("decision") == "DECLINE"

    # Sizing, only when not declined
    requested = _get(df, "requested_amount", 0.0).cast("double")
    tenor = _get(df, "requested_tenor_months", 6.0).cast("double")
    cf_cap = _get(df, "monthly_net_cashflow_avg_6m", 0.0) * tenor * CASHFLOW_DEBT_SERVICE_RATIO
    rev_cap = _get(df, "monthly_gmv_avg_6m", 0.0) * REVENUE_ANCHOR_MULTIPLIER
    others = F.least(requested, cf_cap, rev_cap)
    capped = F.greatest(F.least(others, F.lit(float(HARD_CAP_EUR))), F.lit(0.0))
    below_min = (capped > 0) & (capped < LOAN_MIN_EUR)
    amount_codes = F.filter(F.array(F.when(F.lit(float(HARD_CAP_EUR)) <= others, F.lit("YEAR1_CAP")),
                                    F.when(below_min, F.lit("BELOW_MIN_LOAN_SIZE"))), lambda x: x.isNotNull())
    amount = F.bround(F.when(below_min, F.lit(0.0)).otherwise(capped), -2)

    coverage = _get(df, "net_cashflow_coverage", 0.0)
    band = (F.when((r == 0) & (a <= PRICING_A_MAX_AMBER) & (coverage > PRICING_A_MIN_COVERAGE), "A")
            .when((r >= 1) | (coverage < PRICING_C_MAX_COVERAGE), "C").otherwise("B"))
    tenor_max = F.greatest(F.lit(TENOR_MIN_MONTHS).cast("double"),
                           F.least(tenor, F.lit(float(TENOR_MAX_MONTHS)))).cast("int")
    pass_rate = F.round(F.greatest(F.lit(n_gates) - r - a, F.lit(0)).cast("double") / n_gates, 4)

    codes = (F.when(ko_hit, F.col("_ko"))
             .when(declined, F.col("_gate_codes"))
             .otherwise(F.concat(F.col("_gate_codes"), amount_codes)))
    flags = (F.when(declined, F.array().cast("array<string>"))
             .when(F.col("decision") == "MANUAL_REVIEW",
                   F.array(F.format_string("%d red flags, %d amber flags", r, a)))
             .otherwise(F.array(F.lit("YEAR1_ALL_MANUAL_REVIEW"))))
    expl_map = F.create_map(*[x for k, v in REASON_EXPLANATIONS.items() for x in (F.lit(k), F.lit(v))])
    df = (df.withColumn("max_amount", F.when(declined, F.lit(0.0)).otherwise(amount))
            .withColumn("pricing_band", F.when(~declined, band))
            .withColumn("tenor_max_months", F.when(declined, F.lit(0)).otherwise(tenor_max))
            .withColumn("reason_codes", codes)
            .withColumn("explanations", F.transform("reason_codes", lambda c: F.coalesce(expl_map[c], c)))
            .withColumn("manual_review_flags", flags)
            .withColumn("red_flags", F.when(ko_hit, F.lit(None).cast("int")).otherwise(r))
            .withColumn("amber_flags", F.when(ko_hit, F.lit(None).cast("int")).otherwise(a))
            .withColumn("signal_pass_rate", F.when(ko_hit, F.lit(0.0)).otherwise(pass_rate)))
    return df.drop("_ko", "_red", "_amber", "_gate_codes", "gates")


POLICY_COLUMNS = ["decision", "max_amount", "pricing_band", "tenor_max_months", "reason_codes", "explanations",
                  "manual_review_flags", "red_flags", "amber_flags", "signal_pass_rate"]


def decision_envelope(decided: DataFrame, decided_at: dt.datetime, score_col: str | None = None) -> DataFrame:
    """The decision envelope; the shadow score is attached, never consulted."""
    apr_map = F.create_map(*[x for k, v in PRICING_BANDS.items() for x in (F.lit(k), F.lit(v))])
    score = F.col(score_col).cast("double") if score_col else F.lit(None).cast("double")
    # The score's notes.
    note = (F.when(score.isNull(), F.lit("Shadow ML model not yet available."))
            .when(score > SHADOW_NOTE_THRESHOLD,
                  F.format_string("Shadow ML model estimates elevated risk (score: %.2f). This is for monitoring "
                                  "only and did NOT influence the decision.", score))
            .otherwise(F.format_string("Shadow ML model estimates lower risk (score: %.2f). Informational only.",
                                       score)))
    return decided.select(
        "application_id", "merchant_id",
        F.lit(decided_at).cast("timestamp").alias("timestamp"),
        "decision",
        F.col("max_amount").alias("max_amount_eur"),
        "pricing_band",
        F.when(F.col("pricing_band").isNotNull(), apr_map[F.col("pricing_band")]).alias("apr"),
        "tenor_max_months", "reason_codes", "explanations", "manual_review_flags", "signal_pass_rate",
        F.round(score, 4).alias("shadow_ml_score"),
        note.alias("shadow_ml_note"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(True).alias("requires_credit_officer"),
    )
