"""Registered queries over the driver's tables (canonical views via adapters).

Each query is a Spark DataFrame plan plus, where SQL can express it, an
independent DuckDB oracle string over the same raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.features.assemble import FAMILY_FEATURES, compute_features, defaulted, family_features
from quire.operators.features.registry import BOOL_FEATURES, FEATURE_COLUMNS, INT_FEATURES, PASS_THROUGH
from quire.plans.catalog import register, round_doubles, sql_round
from quire.plans.fixture_sql import with_views
from quire.plans.oracle_features import feature_ctes
from quire.session import write_table
from quire.sources.adapters import FIXTURE_AS_OF, FixtureSources, fixture

AS_OF = FIXTURE_AS_OF


def fx(spark: SparkSession, sf_dir: str):
    return fixture(spark, sf_dir, AS_OF)


_TABLES: dict[tuple, DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Tables consumed by many downstream jobs (features, decisions) are
    written once per session under the checkpoint folder and read back."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _TABLES:
        _TABLES[key] = write_table(build(), name)
    return _TABLES[key]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defaulted(raw_features(spark, sf_dir))


def raw_features(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """Feature snapshots before defaults, stored once for each as-of date."""
    return _stored(spark, sf_dir, f"features-{as_of.isoformat()}",
                   lambda: compute_features(fx(spark, sf_dir).sources(), as_of, apply_defaults=False))


def _kind(n: str) -> str:
    return "b" if n in BOOL_FEATURES else ("i" if n in INT_FEATURES else "d")


FEATURE_SELECT = [("application_id", "s"), ("merchant_id", "s")] + [(n, _kind(n)) for n in FEATURE_COLUMNS] + \
    [("kvk_active", "b"), ("sanctions_hit", "b"), ("requested_amount", "d"), ("requested_tenor_months", "d")]


def _oracle(select: str, extra: dict[str, str] | None = None) -> str:
    ctes = feature_ctes(AS_OF)
    if extra:
        ctes.update(extra)
    return with_views(select, ctes)


# --------------------------------------------------------------------------- scans
SCAN_COLUMNS = {
    "merchants": ("v_merchants", ["merchant_id", "company_name", "kvk_number", "incorporation_date", "annual_gmv",
                                  "n_psps", "sector", "sanctions_hit", "kvk_active", "is_bad_synthetic",
                                  "has_webshop", "primary_marketplace"]),
    "applications": ("v_applications", ["application_id", "merchant_id", "requested_amount",
                                         "requested_tenor_months", "purpose", "application_date"]),
    "bank": ("v_bank", ["transaction_id", "merchant_id", "date", "amount", "direction", "counterparty_name", "category",
                        "balance_after", "posting_seq"]),
    "psp": ("v_psp", ["psp_transaction_id", "merchant_id", "psp_name", "order_date", "settlement_date", "gross_amount", "fee_amount",
                      "net_amount", "status", "refund_amount", "payment_method", "buyer_id", "dispute_outcome"]),
    "webshop": ("v_webshop", ["order_id", "merchant_id", "order_date", "channel", "gross_amount", "discount_amount",
                              "item_count", "sku_id", "status", "fulfillment_days", "is_repeat_customer",
                              "customer_id"]),
    "marketplace": ("v_marketplace", ["merchant_id", "marketplace", "month", "gmv", "order_count",
                                      "cancelled_count", "late_shipment_count", "return_count",
                                      "negative_feedback_count", "account_health_score", "payout_hold_active",
                                      "payout_lag_days", "policy_violation_count", "marketplace_gmv_share"]),
    "accounting": ("v_accounting", ["merchant_id", "month", "gross_revenue", "gross_margin", "cogs", "gross_profit",
                                    "total_opex", "ebitda", "accounts_receivable", "accounts_payable",
                                    "cash_balance", "btw_accrued", "btw_paid",
                                    "btw_due", "btw_paid_on_time", "owner_draws", "ap_days", "ar_days",
                                    "revenue_bank_delta"]),
    "kyc": ("v_kyc", ["merchant_id", "kvk_number", "ubo_name", "kvk_verified", "ubo_director_match", "ubo_verified",
                      "pep_match", "sanctions_match", "identity_changes_12m", "last_kyc_date",
                      "verification_level"]),
    "consents": ("v_consents", ["merchant_id", "consent_type", "action", "event_ts", "event_id", "expires_at"]),
}


def _scan_query(source: str):
    view, cols = SCAN_COLUMNS[source]

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(fixture(spark, sf_dir, AS_OF, materialized=False), source)  # read in place, nothing is written
        return df.select(*cols)

    build.__doc__ = f"S-scan: canonical {source} view over the driver tables"
    register(f"scan_{source}", with_views(f"SELECT {', '.join(cols)} FROM {view}"))(build)


for _s in SCAN_COLUMNS:
    _scan_query(_s)


# --------------------------------------------------------------------------- features (A-K, X)
@register("features", _oracle(f"SELECT {sql_round(FEATURE_SELECT)} FROM feat"))
def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70-field feature table with registry defaults, one row per application."""
    return round_doubles(features(spark, sf_dir))


def _family_query(family: str):
    names = FAMILY_FEATURES[family]
    src = {"bank": "bank_f", "psp": "psp_f", "webshop": "webshop_f", "marketplace": "marketplace_f",
           "accounting": "accounting_f", "kyc": "kyc_f", "cross": "feat_raw"}[family]
    cols = [("application_id", "s"), ("merchant_id", "s")] + [(n, _kind(n)) for n in names]
    sel = ", ".join(("sp." + n if n in ("application_id", "merchant_id") else f"f.{n}") for n, _ in cols)
    if family == "cross":
        inner = f"SELECT {sel} FROM sp JOIN feat_raw f ON f.application_id = sp.application_id"
    else:
        inner = f"SELECT {sel} FROM sp LEFT JOIN {src} f ON f.merchant_id = sp.merchant_id"
    oracle = _oracle(f"SELECT {sql_round(cols)} FROM fam_{family}", {f"fam_{family}": inner})

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(family_features(fx(spark, sf_dir).sources(), AS_OF, family))

    build.__doc__ = f"{family} feature family before registry defaults (NULL = not produced)"
    register(f"features_{family}", oracle)(build)


for _f in FAMILY_FEATURES:
    _family_query(_f)


# --------------------------------------------------------------------------- features from plain files
from quire.session import shared_folder  # noqa: E402
from quire.sources.registry import load_and_validate  # noqa: E402
from quire.sources.schemas import ENUM_DOMAINS, REQUIRED_COLUMNS, SCHEMAS  # noqa: E402

# What a source without the optional columns gives (and one of KYC without its date).
_WITHOUT_OPTIONAL = {"payment_method_card_pct": "0.25", "dispute_win_rate": "0.5", "buyer_concentration_hhi": "1.0",
                     "kyc_days_since_last": "730.0"}


def plain_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The sources as Parquet folders with no more than the required columns, KYC without its date; bank postings have
    their order from the files alone."""
    base = shared_folder(spark, "plain-files")
    sources = fx(spark, sf_dir).sources()
    for name in sources:
        df = sources[name]
        if name == "bank":  # as exported: by merchant and day, in the order of posting
            df = df.repartitionByRange("merchant_id", "date").sortWithinPartitions("merchant_id", "date", "posting_seq")
        columns = REQUIRED_COLUMNS.get(name, SCHEMAS[name].names)
        df.select(*[c for c in columns if c != "last_kyc_date"]).write.option("compression", "zstd").parquet(f"{base}/{name}")
    return {name: f"{base}/{name}" for name in sources}


@register("features_from_files", _oracle("SELECT " + ", ".join(
    f"CAST({_WITHOUT_OPTIONAL[n]} AS DOUBLE) AS {n}" if n in _WITHOUT_OPTIONAL else sql_round([(n, k)])
    for n, k in FEATURE_SELECT) + " FROM feat"))
def q_features_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table from Parquet folders that have only the required columns, in file order."""
    sources, _ = load_and_validate(spark, plain_files(spark, sf_dir))
    return round_doubles(compute_features(sources, AS_OF))


# --------------------------------------------------------------------------- features from the monthly store
from quire.sources import store as ST  # noqa: E402
from quire.sources.schemas import AS_OF_COLUMN  # noqa: E402


_STORES: dict[tuple, str] = {}


def stored_by_month(spark: SparkSession, sf_dir: str) -> str:
    """The fact sources and their history, written in two batches of months, as a portfolio grows; the second batch
    writes a month of the first again. Each fact source is written once, here, and what is derived from it reads that."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key in _STORES:
        return _STORES[key]
    path = _STORES[key] = shared_folder(spark, "store")
    f = FixtureSources(spark, sf_dir, AS_OF, materialized=False)
    f.keep("merchants", fx(spark, sf_dir).merchants)
    for name in sorted(AS_OF_COLUMN, key="psp".__ne__):  # PSP first: other sources are derived from it
        if name == "bank":
            f.scratch_balances()
        ST.write_facts(getattr(f, name), name, path + "/facts")
        f.keep(name, ST.read_facts(spark, name, path + "/facts", AS_OF, None))
        f.clear_scratch()
    sources = f.sources()
    bank = sources["bank"].select(F.explode(F.sequence(F.trunc(F.min("date"), "MM"), F.trunc(F.max("date"), "MM"),
                                                       F.expr("interval 1 month"))))
    months = [r[0] for r in bank.collect()]  # calendar months
    for batch in (months[:-1], months[-2:]):
        ST.merge_history(sources, path + "/history", batch)
    return path


@register("features_from_store", _oracle(f"SELECT {sql_round(FEATURE_SELECT)} FROM feat"))
def q_features_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B4, C8, C9, D1, F1, F2 from merged monthly state, all else from the months that the windows touch."""
    path = stored_by_month(spark, sf_dir)
    f = fx(spark, sf_dir)
    sources = {"merchants": f.merchants, "applications": f.applications, "kyc": f.kyc}
    for name in AS_OF_COLUMN:  # of the monthly tables all months count
        days = ST.RAW_DAYS if name in ("bank", "psp", "webshop") else None
        sources[name] = ST.read_facts(spark, name, path + "/facts", AS_OF, days)
    return round_doubles(compute_features(sources, AS_OF, history=ST.read_history(spark, path + "/history")))


# --------------------------------------------------------------------------- policy (K, P)
from quire.operators import policy as P  # noqa: E402
from quire.plans.oracle_policy import policy_ctes  # noqa: E402


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "decisions", lambda: P.apply_policy(features(spark, sf_dir)))


def _policy_oracle(select: str, extra: dict[str, str] | None = None) -> str:
    ctes = policy_ctes("feat")
    if extra:
        ctes.update(extra)
    return _oracle(select, ctes)


DECISION_SELECT = [("application_id", "s"), ("merchant_id", "s"), ("decision", "s"), ("max_amount", "d"),
                   ("pricing_band", "s"), ("apr", "d"), ("tenor_max_months", "i"), ("reason_codes", "s"),
                   ("explanations", "s"), ("manual_review_flags", "s"), ("red_flags", "i"), ("amber_flags", "i"),
                   ("signal_pass_rate", "d")]


@register("decisions", _policy_oracle(f"SELECT {sql_round(DECISION_SELECT)} FROM pol_out"))
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K8 + P1-P13: knockouts, gates, decision ladder, sizing, pricing per application."""
    d = decided(spark, sf_dir)
    apr = F.create_map(*[x for k, v in P.PRICING_BANDS.items() for x in (F.lit(k), F.lit(v))])
    return round_doubles(d.select(
        "application_id", "merchant_id", "decision", "max_amount", "pricing_band",
        apr[F.col("pricing_band")].alias("apr"), "tenor_max_months",
        F.concat_ws("|", "reason_codes").alias("reason_codes"),
        F.concat_ws("|", "explanations").alias("explanations"),
        F.concat_ws("|", "manual_review_flags").alias("manual_review_flags"),
        "red_flags", "amber_flags", "signal_pass_rate"))


def _gate_union_sql() -> str:
    parts = []
    for i, (feat, green, red, kind, code) in enumerate(P.GATES):
        v = f"coalesce(CAST({feat} AS DOUBLE), {float(red)!r})"
        r, a = (f"{v} > {red}", f"{v} > {green}") if kind == "standard" else (f"{v} < {red}", f"{v} < {green}")
        parts.append(f"SELECT application_id, merchant_id, {i + 1} AS gate_position, '{feat}' AS gate, "
                     f"round({v}, 6) AS value, CASE WHEN {r} THEN 'red' WHEN {a} THEN 'amber' ELSE 'green' END AS status, "
                     f"CASE WHEN {r} THEN '{code}' END AS reason_code FROM feat")
    return " UNION ALL ".join(parts)


@register("gate_evaluation", _oracle("SELECT * FROM gates_long", {"gates_long": _gate_union_sql()}))
def q_gate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored gate per application (value, red/amber/green, reason code)."""
    f = P.with_gates(features(spark, sf_dir))
    return (f.select("application_id", "merchant_id", F.explode("gates").alias("g"))
            .select("application_id", "merchant_id", F.col("g.position").alias("gate_position"), F.col("g.feature").alias("gate"),
                    F.round("g.value", 6).alias("value"), "g.status", F.when(F.col("g.status") == "red", F.col("g.code"))
                    .alias("reason_code")))


# --------------------------------------------------------------------------- validation + reconciliation (V, R)
from quire.functions.expr import in_window  # noqa: E402
from quire.operators import quality as Q  # noqa: E402
from quire.operators import reconcile as R  # noqa: E402
from quire.plans import oracle_misc as OM  # noqa: E402

QUALITY_SOURCES = ("bank", "psp", "webshop", "marketplace", "accounting", "kyc")


def _quality_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    f = fixture(spark, sf_dir, AS_OF, materialized=False)  # read in place, no copies
    return {s: getattr(f, s).drop("k") if "k" in getattr(f, s).columns else getattr(f, s) for s in QUALITY_SOURCES}


@register("quality_report", with_views(OM.quality_sql({k: v[1] for k, v in SCAN_COLUMNS.items()})))
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V7: null rates, enum domains, ranges, history span, months, non-empty per source."""
    return round_doubles(Q.data_quality_report(_quality_sources(spark, sf_dir)))


_ENUM_SQL = " UNION ALL ".join(
    f"SELECT '{src}' AS source, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, "
    f"coalesce({c} IN ({', '.join(repr(v) for v in allowed)}), false) AS valid FROM {OM.VIEW_OF[src]} GROUP BY {c}"
    for src, (c, allowed) in ENUM_DOMAINS.items())


@register("enum_values", with_views(f"SELECT * FROM ({_ENUM_SQL})"))
def q_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the enum columns with its rows, and whether the domain has it."""
    sources = _quality_sources(spark, sf_dir)
    counts, domains = Q.value_counts(sources), Q.domain_table(spark)
    allowed = counts.join(domains, ["source", "column", "value"], "left_semi").withColumn("valid", F.lit(True))
    return allowed.unionByName(Q.invalid_values(sources).withColumn("valid", F.lit(False)))


@register("quality_report_on_load", with_views(OM.quality_sql({k: v[1] for k, v in SCAN_COLUMNS.items()})))
def q_quality_report_on_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V7 gathered while the sources are first written, without a scan of their own."""
    f, seen = FixtureSources(spark, sf_dir, AS_OF, materialized=False), {}
    for name in sorted(QUALITY_SOURCES, key="psp".__ne__):  # PSP first: other sources are derived from its table
        watched, *seen[name] = Q.observed(getattr(f, name), name)
        f.keep(name, write_table(watched, f"checked-{name}"))
    return round_doubles(Q.observed_report(spark, {name: seen[name] for name in QUALITY_SOURCES}))


@register("required_columns")
def q_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: required column names per source (schema metadata; rows-only check)."""
    return Q.required_columns_report(spark, _quality_sources(spark, sf_dir))


ALERT_SELECT = [("feature", "s"), ("missing_pct", "d"), ("status", "s")]


@register("feature_missing_alerts", _oracle(
    "SELECT feature, missing_pct, status FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END), 3) AS missing_pct, "
        f"'DATA_QUALITY_ALERT' AS status, avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END) AS p FROM feat_raw"
        for n in FEATURE_COLUMNS if n not in BOOL_FEATURES) + ") WHERE p > 0.2"))
def q_feature_missing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: numeric features (before defaults) missing in more than 20% of applications."""
    raw = raw_features(spark, sf_dir)
    return Q.feature_missing_alerts(raw.select(*FEATURE_COLUMNS)).select("feature", "missing_pct", "status")


@register("reconciliation", with_views(OM.recon_sql(AS_OF)))
def q_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank settlement credits vs PSP paid net per merchant, delta and pass flag."""
    f = fx(spark, sf_dir)
    return R.reconcile_bank_psp(f.merchants, f.bank, f.psp, AS_OF)


@register("reconciliation_from_store", with_views(OM.recon_sql(AS_OF)))
def q_reconciliation_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 from merged monthly state and the rows of the current month."""
    path = stored_by_month(spark, sf_dir)
    now = [ST.read_facts(spark, name, path + "/facts", AS_OF, AS_OF.day - 1) for name in ("bank", "psp")]
    return R.reconcile_bank_psp(fx(spark, sf_dir).merchants, *now, AS_OF, ST.read_history(spark, path + "/history"))


@register("accounting_derived", with_views(OM.accounting_derived_sql(AS_OF)))
def q_accounting_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month grid join of bank credits, month-end cash, quarterly VAT, P&L derivations."""
    f = fx(spark, sf_dir)
    return R.accounting_derived(f.accounting, f.bank, AS_OF)


@register("daily_closing_balance", with_views(OM.daily_balance_sql(AS_OF)))
def q_daily_closing_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing balance, posting count and net per merchant and day."""
    return R.daily_closing_balance(fx(spark, sf_dir).bank, AS_OF)


@register("weekly_gpv_series", with_views(OM.weekly_gpv_sql(AS_OF)))
def q_weekly_gpv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled Mon-Sun weekly paid GPV over the last 90 days per merchant."""
    p = fx(spark, sf_dir).psp.filter(F.col("order_date") <= F.lit(AS_OF))
    cond = (F.col("status") == "paid") & in_window(F.col("order_date"), AS_OF, 90)
    return R.weekly_series(p, "order_date", F.col("gross_amount"), cond, "gross")


# --------------------------------------------------------------------------- monitoring (W)
import datetime as _dt  # noqa: E402

from quire.operators import monitor as M  # noqa: E402
from quire.operators.features.registry import ML_FEATURES  # noqa: E402
from quire.plans.oracle_features import feature_ctes_prefixed  # noqa: E402

REFERENCE_AS_OF = _dt.date(2000, 8, 1)


def _decisions_oracle(select: str, extra: dict[str, str] | None = None) -> str:
    return _policy_oracle(select, extra)


@register("portfolio_metrics", _decisions_oracle(
    "SELECT count(*) AS total_applications, "
    "round(count(*) FILTER (WHERE decision IN ('APPROVE','MANUAL_REVIEW')) / count(*), 3) AS approval_rate, "
    "round(count(*) FILTER (WHERE decision = 'DECLINE') / count(*), 3) AS decline_rate, "
    "coalesce(round(avg(max_amount) FILTER (WHERE decision IN ('APPROVE','MANUAL_REVIEW')), 2), 0.0) AS avg_approved_amount, "
    "CAST(NULL AS VARCHAR) AS error FROM pol"))
def q_portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, approval and decline rates, average approved amount."""
    return M.portfolio_metrics(decided(spark, sf_dir))


@register("pricing_distribution", _decisions_oracle(
    "SELECT pricing_band, count(*) AS n FROM pol WHERE decision IN ('APPROVE','MANUAL_REVIEW') "
    "AND pricing_band IS NOT NULL GROUP BY pricing_band"))
def q_pricing_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing band counts among approved / manual-review decisions."""
    return M.pricing_distribution(decided(spark, sf_dir))


@register("decline_reasons", _decisions_oracle(
    "SELECT u.reason_code, count(*) AS n FROM pol CROSS JOIN unnest(pol.reason_codes) AS u(reason_code) "
    "WHERE decision = 'DECLINE' GROUP BY u.reason_code"))
def q_decline_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason-code counts over declined applications."""
    return M.decline_reasons(decided(spark, sf_dir))


# A frozen score for the mean-score columns: the granted amount over 100,000
_AMOUNT_SCORE = "CAST(max_amount AS DOUBLE) / 100000"


def _with_amount_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).withColumn("shadow_ml_score", F.col("max_amount").cast("double") / 100000)


def _impact_sql(by: str, flag: bool) -> str:
    cols = (f"{by}, count(decision) AS total, count(*) FILTER (WHERE decision IN ('APPROVE','MANUAL_REVIEW')) AS approved"
            + (f", count(*) FILTER (WHERE decision = 'DECLINE') AS declined, round(avg({_AMOUNT_SCORE}), 6) AS avg_ml_score"
               if flag else ""))
    inner = (f"SELECT {cols} FROM pol p LEFT JOIN (SELECT DISTINCT merchant_id, {by} FROM v_merchants) m "
             f"ON m.merchant_id = p.merchant_id WHERE {by} IS NOT NULL GROUP BY {by}")
    sel = f"SELECT *, round(CAST(approved AS DOUBLE) / total, 3) AS approval_rate"
    if flag:
        sel += (", CASE WHEN round(CAST(approved AS DOUBLE) / total, 3) < "
                "(sum(approved) OVER () * 1.0 / sum(total) OVER ()) * 0.8 THEN 'REVIEW' ELSE 'OK' END AS flag")
    return f"{sel} FROM ({inner})"


@register("adverse_impact_sector", _decisions_oracle(_impact_sql("sector", True)))
def q_adverse_impact_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval rate by sector with the 80%-of-overall review flag."""
    return round_doubles(M.adverse_impact(_with_amount_score(spark, sf_dir), fx(spark, sf_dir).merchants, "sector"))


@register("adverse_impact_platforms", _decisions_oracle(_impact_sql("n_psps", False)))
def q_adverse_impact_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval rate by number of PSPs."""
    return M.adverse_impact(decided(spark, sf_dir), fx(spark, sf_dir).merchants, "n_psps", flag=False)


@register("run_summary", _decisions_oracle(
    "SELECT count(*) FILTER (WHERE decision = 'APPROVE') AS n_approve, "
    "count(*) FILTER (WHERE decision = 'MANUAL_REVIEW') AS n_manual_review, "
    "count(*) FILTER (WHERE decision = 'DECLINE') AS n_decline, "
    "round(avg(max_amount) FILTER (WHERE decision = 'APPROVE'), 6) AS approve_avg_amount, "
    "count(*) FILTER (WHERE decision = 'APPROVE' AND pricing_band = 'A') AS approve_band_A, "
    "count(*) FILTER (WHERE decision = 'APPROVE' AND pricing_band = 'B') AS approve_band_B, "
    "count(*) FILTER (WHERE decision = 'APPROVE' AND pricing_band = 'C') AS approve_band_C, "
    f"round(avg({_AMOUNT_SCORE}) FILTER (WHERE decision = 'APPROVE'), 6) AS approve_avg_score FROM pol"))
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision counts, APPROVE-only average amount, band counts and mean (frozen) score."""
    return round_doubles(M.run_summary(_with_amount_score(spark, sf_dir)))


@register("score_by_decision_frozen", _decisions_oracle(
    f"SELECT decision, round(avg({_AMOUNT_SCORE}), 4) AS avg_shadow_score FROM pol GROUP BY decision"))
def q_score_by_decision_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean (frozen) score per decision."""
    return M.score_by_decision(_with_amount_score(spark, sf_dir))


def _psi_lineitem_sql() -> str:
    return """SELECT 'l_extendedprice' AS feature, round(sum((a - e) * ln(a / e)), 4) AS psi,
  CASE WHEN round(sum((a - e) * ln(a / e)), 4) < 0.1 THEN 'stable'
       WHEN round(sum((a - e) * ln(a / e)), 4) < 0.2 THEN 'moderate_shift' ELSE 'significant_drift' END AS status
FROM (SELECT b.bin, greatest(coalesce(c.ce, 0) * 1.0 / r.n_e, 0.0001) AS e, greatest(coalesce(c.ca, 0) * 1.0 / r.n_a, 0.0001) AS a
      FROM (SELECT unnest(range(1, 11)) AS bin) b CROSS JOIN psi_rng r
      LEFT JOIN (SELECT bin, count(*) FILTER (WHERE side = 'e') AS ce, count(*) FILTER (WHERE side = 'a') AS ca
                 FROM (SELECT side, least(10, """ + " + ".join(
        f"(CASE WHEN v >= lo + {k} * ((hi - lo) / 10) THEN 1 ELSE 0 END)" for k in range(11)) + """) AS bin
                       FROM psi_vals CROSS JOIN psi_rng) GROUP BY bin) c ON c.bin = b.bin)"""


_PSI_CTES = {
    "psi_mid": "SELECT CAST(min(l_shipdate) AS DATE) + CAST(datediff('day', CAST(min(l_shipdate) AS DATE), "
               "CAST(max(l_shipdate) AS DATE)) / 2 AS INTEGER) AS mid FROM lineitem",
    "psi_vals": "SELECT CASE WHEN CAST(l_shipdate AS DATE) < mid THEN 'e' ELSE 'a' END AS side, l_extendedprice AS v "
                "FROM lineitem, psi_mid WHERE l_extendedprice IS NOT NULL",
    "psi_rng": "SELECT min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE side = 'e') AS n_e, "
               "count(*) FILTER (WHERE side = 'a') AS n_a FROM psi_vals",
}


@register("psi_lineitem_price", with_views(_psi_lineitem_sql(), _PSI_CTES))
def q_psi_lineitem_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of l_extendedprice, first half of the ship-date range vs second half."""
    li = fx(spark, sf_dir).table("lineitem").select(F.col("l_shipdate").cast("date").alias("d"), "l_extendedprice")
    days = li.agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    mid = days.select(F.date_add("d0", F.floor(F.datediff("d1", "d0") / 2).cast("int"))).scalar()  # one value, in the plan
    v = li.filter(F.col("l_extendedprice").isNotNull()).select(
        F.lit("l_extendedprice").alias("feature"), F.col("l_extendedprice").alias("value"), "d")
    return M.psi_from_long(v.filter(F.col("d") < mid).drop("d"), v.filter(F.col("d") >= mid).drop("d"))


def _drift_sql() -> str:
    feats = [f for f in ML_FEATURES]
    def long(t: str) -> str:
        return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {t}" for f in feats)
    return f"""SELECT feature, round(sum((a - e) * ln(a / e)), 4) AS psi,
  CASE WHEN round(sum((a - e) * ln(a / e)), 4) < 0.1 THEN 'stable'
       WHEN round(sum((a - e) * ln(a / e)), 4) < 0.2 THEN 'moderate_shift' ELSE 'significant_drift' END AS status
FROM (SELECT r.feature, b.bin, greatest(coalesce(c.ce, 0) * 1.0 / r.n_e, 0.0001) AS e,
             greatest(coalesce(c.ca, 0) * 1.0 / r.n_a, 0.0001) AS a
      FROM dr_rng r CROSS JOIN (SELECT unnest(range(1, 11)) AS bin) b
      LEFT JOIN (SELECT feature, bin, count(*) FILTER (WHERE side = 'e') AS ce, count(*) FILTER (WHERE side = 'a') AS ca
                 FROM (SELECT x.feature, side, least(10, {' + '.join(f"(CASE WHEN v >= lo + {k} * ((hi - lo) / 10) THEN 1 ELSE 0 END)" for k in range(11))}) AS bin
                       FROM dr_all x JOIN dr_rng r2 ON r2.feature = x.feature) GROUP BY 1, 2) c
        ON c.feature = r.feature AND c.bin = b.bin)
GROUP BY feature""", {
        "dr_all": f"SELECT feature, v, 'e' AS side FROM ({long('ref_feat')}) WHERE v IS NOT NULL AND NOT isnan(v) "
                  f"UNION ALL SELECT feature, v, 'a' AS side FROM ({long('feat')}) WHERE v IS NOT NULL AND NOT isnan(v)",
        "dr_rng": "SELECT feature, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE side = 'e') AS n_e, "
                  "count(*) FILTER (WHERE side = 'a') AS n_a FROM dr_all GROUP BY feature",
    }


def _drift_oracle() -> str:
    sql, extra = _drift_sql()
    ctes = feature_ctes(AS_OF)
    ctes.update(feature_ctes_prefixed(REFERENCE_AS_OF, "ref_"))
    ctes.update(extra)
    return with_views(sql, ctes)


@register("drift_report", _drift_oracle())
def q_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI per model feature, portfolio a year earlier vs now."""
    ref = defaulted(raw_features(spark, sf_dir, REFERENCE_AS_OF))
    return M.drift_report(ref, features(spark, sf_dir), ML_FEATURES)


# Frozen score: a fixed function of a stored double, at full precision
_FROZEN = ("SELECT (c_acctbal + 1000) / 11000.0 AS s, CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS y "
           "FROM customer WHERE c_acctbal IS NOT NULL")


def _frozen_score() -> "F.Column":
    return (F.col("c_acctbal") + 1000) / F.lit(11000.0)


@register("auc_brier_frozen", with_views(
    "SELECT round((sum(y * (rk + (cnt - 1) / 2.0)) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, "
    "sum(y) AS P, sum(1 - y) AS N, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(y), 6) AS default_rate "
    "FROM (SELECT s, y, rank() OVER (ORDER BY s) AS rk, count(*) OVER (PARTITION BY s) AS cnt FROM fr)",
    {"fr": _FROZEN}))
def q_auc_brier_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rank AUC, Brier and default rate on the frozen customer score table."""
    c = fx(spark, sf_dir).table("customer").filter(F.col("c_acctbal").isNotNull())
    scored = c.select(_frozen_score().alias("score"), (F.col("c_nationkey") % 5 == 0).cast("int").alias("label"))
    return M.auc_brier(scored, "score", "label")


@register("score_quartiles_frozen", with_views(
    "SELECT tier, count(*) AS n, round(avg(s), 6) AS mean_score, round(quantile_cont(s, 0.25), 6) AS q25, "
    "round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75 FROM "
    "(SELECT s, CASE WHEN s < 0.2 THEN 'low' WHEN s < 0.4 THEN 'medium' ELSE 'high' END AS tier FROM fr) GROUP BY tier",
    {"fr": _FROZEN}))
def q_score_quartiles_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 + L10: mean and exact quartiles of the score per risk tier (frozen scores)."""
    c = fx(spark, sf_dir).table("customer").filter(F.col("c_acctbal").isNotNull())
    s = _frozen_score()
    scored = c.select(s.alias("shadow_ml_score"), M.risk_tier(s).alias("tier"))
    return M.score_quartiles(scored, by="tier")


# --------------------------------------------------------------------------- scorecard + cases (D, J17)
from quire.operators import scorecard as SC  # noqa: E402
from quire.operators.policy import GATES  # noqa: E402


def _card_sql() -> str:
    parts = []
    bounds = {f: (g, r, k) for f, (g, r, k) in SC.DISPLAY_ONLY_THRESHOLDS.items()} | {f: (g, r, k) for f, g, r, k, _ in GATES}
    patterns = {fmt: (pattern, factor) for fmt, pattern, factor in SC.THRESHOLD_FORMATS}
    for pos, (name, label, source, fmt, scored) in enumerate(SC.DASHBOARD_SIGNALS, 1):
        green, red, kind = bounds.get(name, (None, None, None))
        lab = label.replace("'", "''")
        if fmt == "bool":
            status = f"CASE WHEN {name} IS NULL THEN 'none' WHEN {name} THEN 'green' ELSE 'red' END"
            disp = f"CASE WHEN {name} IS NULL THEN '—' WHEN {name} THEN '✓ Match' ELSE '✗ Mismatch' END"
            val = "CAST(NULL AS DOUBLE)"
            flag = f"CAST({name} AS BOOLEAN)"
        else:
            v = f"CAST({name} AS DOUBLE)"
            if kind == "standard":
                status = f"CASE WHEN {v} IS NULL THEN 'none' WHEN {v} <= {green} THEN 'green' WHEN {v} <= {red} THEN 'amber' ELSE 'red' END"
            else:
                status = f"CASE WHEN {v} IS NULL THEN 'none' WHEN {v} >= {green} THEN 'green' WHEN {v} >= {red} THEN 'amber' ELSE 'red' END"
            body = {"pct": f"printf('%.1f', {v} * 100) || '%'", "ratio": f"printf('%.2f', {v}) || '×'",
                    "days": f"printf('%.1f', {v}) || ' days'", "hhi": f"printf('%.3f', {v})",
                    "score": f"printf('%.1f', {v}) || ' / 10'"}[fmt]
            disp = f"CASE WHEN {v} IS NULL THEN '—' ELSE {body} END"
            val = f"round({v}, 6)"
            flag = "CAST(NULL AS BOOLEAN)"
        if fmt == "bool":
            text = f"'{SC.FLAG_TEXT}'"
        else:
            pattern, factor = patterns[fmt]
            word = [f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)" if pattern == "%s" else f"printf('{pattern}', {x} * {factor})"
                    for x in (green, red)]
            sign = "≤", ">"
            if kind == "inverted":
                sign = "≥", "<"
            text = f"'Green {sign[0]} ' || {word[0]} || '  ·  Red {sign[1]} ' || {word[1]}"
        parts.append(f"SELECT application_id, merchant_id, {pos} AS position, '{name}' AS name, '{lab}' AS label, "
                     f"'{source}' AS source, {str(scored).lower()} AS scored, {val} AS value, {flag} AS flag, "
                     f"{status} AS status, {disp} AS display_value, {text} AS thresholds FROM feat")
    return " UNION ALL ".join(parts)


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.scorecard(features(spark, sf_dir))


@register("scorecard", _oracle("SELECT * FROM card", {"card": _card_sql()}))
def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1r-D5r: 18 dashboard signals per application: value, status, display text, thresholds."""
    return round_doubles(card(spark, sf_dir))


@register("scorecard_status_counts", _oracle(
    "SELECT application_id, merchant_id, count(*) FILTER (WHERE status = 'green') AS n_green, "
    "count(*) FILTER (WHERE status = 'amber') AS n_amber, count(*) FILTER (WHERE status = 'red') AS n_red, "
    "count(*) FILTER (WHERE status = 'none') AS n_none FROM card GROUP BY 1, 2", {"card": _card_sql()}))
def q_scorecard_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6r: green / amber / red / no-data counts per application."""
    return SC.status_counts(card(spark, sf_dir))


@register("case_selection", _decisions_oracle(
    "SELECT bucket, arg_min(application_id, k * 1000000 + rn) AS application_id, "
    "CASE bucket WHEN 'approve' THEN 'Healthy merchant' WHEN 'manual' THEN 'Flagged for review' "
    "WHEN 'credit' THEN 'Credit decline' ELSE 'KYC decline' END AS scenario FROM ("
    "SELECT application_id, bucket, CASE WHEN bucket IN ('approve', 'manual') THEN len(reason_codes) ELSE 0 END AS k, "
    "row_number() OVER (ORDER BY application_id) AS rn FROM (SELECT *, CASE WHEN decision = 'APPROVE' THEN 'approve' "
    "WHEN decision = 'MANUAL_REVIEW' THEN 'manual' WHEN decision = 'DECLINE' AND list_contains(reason_codes, 'UBO_MISMATCH') "
    "THEN 'kyc' WHEN decision = 'DECLINE' THEN 'credit' END AS bucket FROM pol) WHERE bucket IS NOT NULL) GROUP BY bucket"))
def q_case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17/D7r: one representative application per decision bucket."""
    return SC.select_cases(decided(spark, sf_dir))


_SELECTED = ("SELECT bucket, arg_min(application_id, k * 1000000 + rn) AS application_id FROM ("
             "SELECT application_id, bucket, CASE WHEN bucket IN ('approve', 'manual') THEN len(reason_codes) ELSE 0 END AS k, "
             "row_number() OVER (ORDER BY application_id) AS rn FROM (SELECT *, CASE WHEN decision = 'APPROVE' THEN 'approve' "
             "WHEN decision = 'MANUAL_REVIEW' THEN 'manual' WHEN decision = 'DECLINE' AND list_contains(reason_codes, "
             "'UBO_MISMATCH') THEN 'kyc' WHEN decision = 'DECLINE' THEN 'credit' END AS bucket FROM pol) "
             "WHERE bucket IS NOT NULL) GROUP BY bucket")
_CASE_SCORECARD = ["name", "label", "source", "display_value", "status", "thresholds"]


@register("case_records", _decisions_oracle(
    "SELECT c.bucket, c.application_id, CASE c.bucket " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in SC.SCENARIOS.items()) + " END AS scenario, o.merchant_id, o.decision, o.max_amount, "
    "o.pricing_band, o.tenor_max_months, o.reason_codes, o.explanations, o.manual_review_flags, o.signal_pass_rate, "
    f"round(CAST(p.requested_amount AS DOUBLE), 6) AS requested_amount, round(CAST(p.requested_tenor_months AS DOUBLE), 6) "
    f"AS requested_tenor_months, round({_AMOUNT_SCORE.replace('max_amount', 'p.max_amount')}, 6) AS shadow_ml_score, "
    "m.company_name, m.sector, m.annual_gmv, k.scorecard FROM selected c JOIN pol_out o ON o.application_id = c.application_id "
    "JOIN pol p ON p.application_id = c.application_id LEFT JOIN v_merchants m ON m.merchant_id = o.merchant_id "
    f"LEFT JOIN (SELECT application_id, string_agg(concat_ws('|', {', '.join(_CASE_SCORECARD)}), chr(10) ORDER BY position) "
    "AS scorecard FROM card GROUP BY 1) k ON k.application_id = c.application_id",
    {"selected": _SELECTED, "card": _card_sql()}))
def q_case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8r: selected cases with merchant facts, decision, (frozen) score and the ordered scorecard as text lines."""
    cases = SC.case_records(_with_amount_score(spark, sf_dir), card(spark, sf_dir), fx(spark, sf_dir).merchants)
    line = lambda s: F.concat_ws("|", *[s[c] for c in _CASE_SCORECARD])
    texts = [F.concat_ws("|", c).alias(c) if c in ("reason_codes", "explanations", "manual_review_flags")
             else F.array_join(F.transform(c, line), "\n").alias(c) if c == "scorecard" else F.col(c) for c in cases.columns]
    return round_doubles(cases.select(*texts))


# --------------------------------------------------------------------------- audit + consents
from quire.operators import audit as AU  # noqa: E402
from quire.session import ensure_checkpoint_dir  # noqa: E402
from quire.sources.adapters import CONSENT_AS_OF  # noqa: E402

DECIDED_AT = _dt.datetime(2001, 8, 1, 9, 0, 0)


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.consent_records(fx(spark, sf_dir).consents)


_CONSENT_SQL = ("SELECT merchant_id, consent_type, CASE consent_type WHEN 'psd2_aisp' THEN '[\"transactions\",\"balances\"]' "
                "ELSE '[\"transactions\"]' END AS scope, action, event_ts AS timestamp, event_id, "
                "CASE WHEN action = 'GRANTED' THEN coalesce(CAST(expires_at AS DATE), CAST(event_ts AS DATE) + 90) END "
                "AS expires_at, true AS revocable FROM v_consents")


@register("consent_log", with_views(_CONSENT_SQL))
def q_consent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent events as log records (scope JSON, expiry, revocable)."""
    return consents(spark, sf_dir)


@register("granted_consents", with_views(f"SELECT * FROM ({_CONSENT_SQL}) WHERE action = 'GRANTED'"))
def q_granted_consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 (as specified): GRANTED records, newest first per merchant."""
    return AU.granted_consents(consents(spark, sf_dir))


@register("active_consents", with_views(
    "SELECT merchant_id, consent_type, last.timestamp AS granted_at, last.expires_at AS expires_at, last.scope AS scope "
    "FROM (SELECT merchant_id, consent_type, arg_max({'action': action, 'expires_at': expires_at, 'timestamp': timestamp, "
    "'scope': scope}, {'t': timestamp, 'e': event_id}) AS last FROM (" + _CONSENT_SQL + ") GROUP BY 1, 2) "
    f"WHERE last.action = 'GRANTED' AND last.expires_at > DATE '{CONSENT_AS_OF.isoformat()}'"))
def q_active_consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 truly-active: latest event per merchant and type is an unexpired grant."""
    return AU.active_consents(consents(spark, sf_dir), CONSENT_AS_OF)


_TEXTS = ("reason_codes", "explanations", "manual_review_flags")
_STAMP = DECIDED_AT.strftime("%Y-%m-%d %H:%M:%S")


@register("decision_envelopes", _policy_oracle(
    f"SELECT application_id, merchant_id, TIMESTAMP '{_STAMP}' AS timestamp, decision, max_amount AS max_amount_eur, "
    "pricing_band, apr, tenor_max_months, reason_codes, explanations, manual_review_flags, signal_pass_rate, "
    "CAST(NULL AS DOUBLE) AS shadow_ml_score, 'Shadow ML model not yet available.' AS shadow_ml_note, "
    f"'{P.MODEL_VERSION}' AS model_version, true AS requires_credit_officer FROM pol_out"))
def q_decision_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision envelopes before there is a model, so without a score."""
    env = P.decision_envelope(decided(spark, sf_dir), DECIDED_AT)
    return round_doubles(env.select(*[F.concat_ws("|", c).alias(c) if c in _TEXTS
                                      else F.col(c).cast("timestamp_ntz").alias(c) if c == "timestamp" else F.col(c)
                                      for c in env.columns]))


_SNAPSHOT = [(n, k) for n, k in FEATURE_SELECT if n not in ("application_id", "merchant_id")]


@register("decision_log", _policy_oracle(
    f"SELECT p.merchant_id, '{DECIDED_AT.isoformat()}.000000Z' AS timestamp, p.decision, p.max_amount AS max_amount_eur, "
    "p.pricing_band, array_to_string(p.reason_codes, '|') AS reason_codes, CAST(NULL AS DOUBLE) AS shadow_ml_score, "
    f"'{P.MODEL_VERSION}' AS model_version, DATE '{DECIDED_AT.date().isoformat()}' AS decision_date, "
    + ", ".join(f"round(p.{n}, 6) AS snap_{n}" if k == "d" else f"p.{n} AS snap_{n}" for n, k in _SNAPSHOT) + " FROM pol p"))
def q_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions appended to the audit table, twice as one batch, and read back; the snapshot parsed."""
    env = P.decision_envelope(decided(spark, sf_dir), DECIDED_AT)
    rows = AU.decision_log_rows(env, features(spark, sf_dir))
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-audit/decision_log-{uuid.uuid4().hex}"
    for _ in range(2):  # a batch that is written again is there once
        AU.append_decision_log(rows, path, "run-1")
    log = AU.load_decision_log(spark, path, since=DECIDED_AT.date(), until=DECIDED_AT.date())
    kinds = {"d": "double", "b": "boolean", "i": "int"}
    snapshot = F.from_json("features_json", ", ".join(f"{n} {kinds[k]}" for n, k in _SNAPSHOT))
    return round_doubles(log.withColumn("_snapshot", snapshot).select(
        "merchant_id", "timestamp", "decision", "max_amount_eur", "pricing_band",
        F.concat_ws("|", "reason_codes_list").alias("reason_codes"), "shadow_ml_score", "model_version", "decision_date",
        *[F.col(f"_snapshot.{n}").alias(f"snap_{n}") for n, _ in _SNAPSHOT]))


# --------------------------------------------------------------------------- shadow model (L)
from quire.operators import shadow as SH  # noqa: E402

_MODELS: dict[tuple, SH.ShadowModel] = {}


def shadow_model(spark: SparkSession, sf_dir: str) -> SH.ShadowModel:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _MODELS:
        frame = SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants)
        _MODELS[key] = SH.train_shadow(frame)
    return _MODELS[key]


_TRAIN_SQL = ("SELECT f.merchant_id, " + ", ".join(f"coalesce(CAST(f.{c} AS DOUBLE), 0.0) AS {c}" for c in ML_FEATURES)
              + ", CAST(m.is_bad_synthetic AS INTEGER) AS label FROM feat f JOIN "
              "(SELECT DISTINCT merchant_id, is_bad_synthetic FROM v_merchants) m ON m.merchant_id = f.merchant_id")


@register("training_frame", _oracle("SELECT merchant_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ML_FEATURES)
                                    + ", label FROM tf", {"tf": _TRAIN_SQL}))
def q_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the 54 model inputs with the default label (inner join on merchants)."""
    return round_doubles(SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants))


def scored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = shadow_model(spark, sf_dir)
    d = decided(spark, sf_dir)
    scored = model.score(d.select("application_id", *ML_FEATURES))
    return d.join(scored.select("application_id", "shadow_ml_score"), "application_id", "left")


@register("shadow_decisions")
def q_shadow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 + L10 + P14: decision envelopes with the calibrated shadow score and risk tier (rows-only)."""
    s = scored_decisions(spark, sf_dir)
    env = P.decision_envelope(s, DECIDED_AT, score_col="shadow_ml_score")
    return env.withColumn("risk_tier", M.risk_tier(F.col("shadow_ml_score"))) \
              .withColumn("reason_codes", F.to_json("reason_codes")) \
              .withColumn("explanations", F.to_json("explanations")) \
              .withColumn("manual_review_flags", F.to_json("manual_review_flags"))


@register("case_records_shadow")
def q_case_records_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8r + L9: case records with the calibrated score and the model's top features, as exported (rows-only)."""
    labels = {s[0]: s[1] for s in SC.DASHBOARD_SIGNALS}
    top = SH.importances_frame(spark, shadow_model(spark, sf_dir), labels)
    cases = SC.case_records(scored_decisions(spark, sf_dir), card(spark, sf_dir), fx(spark, sf_dir).merchants, top)
    path = shared_folder(spark, "cases")
    AU.export_cases_json(cases, path)  # S16
    return spark.read.schema(cases.schema).json(path)


@register("shadow_metrics")
def q_shadow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated AUC mean/std and Brier of the calibrated model (rows-only)."""
    m = shadow_model(spark, sf_dir).metrics
    frame = SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants)
    counts = frame.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("label").alias("n_positives"))
    return counts.select("n_samples", "n_positives",
                         F.lit(m["auc_cv_mean"]).cast("double").alias("auc_cv_mean"),
                         F.lit(m["auc_cv_std"]).cast("double").alias("auc_cv_std"),
                         F.lit(m["brier_cv_mean"]).cast("double").alias("brier_cv_mean"),
                         F.lit(m["folds"]).alias("folds"), F.lit(m["n_trees"]).alias("n_trees"))


@register("shadow_score_by_decision")
def q_shadow_score_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + W11: mean and quartiles of the logged shadow score per decision (rows-only)."""
    s = scored_decisions(spark, sf_dir)
    return M.score_quartiles(s, by="decision").join(M.score_by_decision(s), "decision")


@register("feature_importances")
def q_feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-8 mean importances of the fold models with display labels (rows-only)."""
    labels = {s[0]: s[1] for s in SC.DASHBOARD_SIGNALS}
    return SH.importances_frame(spark, shadow_model(spark, sf_dir), labels)


@register("holdout_split", _oracle(
    "SELECT split, label, count(*) AS n FROM (SELECT label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY "
    f"md5(concat(merchant_id, ':{SH.SEED}')), merchant_id) <= round(count(*) OVER (PARTITION BY label) * {SH.HOLDOUT_SHARE}) "
    "THEN 'holdout' ELSE 'train' END AS split FROM tf) GROUP BY split, label", {"tf": _TRAIN_SQL}))
def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stratified 70/30 split of the training frame with per-class counts."""
    frame = SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants)
    return SH.holdout_split(frame).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("holdout_metrics")
def q_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated model fit on the 70% split, AUC / Brier on the 30% hold-out (rows-only)."""
    frame = SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants)
    return SH.holdout_evaluation(frame)


@register("shadow_logistic_metrics")
def q_shadow_logistic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: balanced logistic base model with the same calibration and CV metrics (rows-only)."""
    frame = SH.training_frame(features(spark, sf_dir), fx(spark, sf_dir).merchants)
    m = SH.train_shadow(frame, model_type="logistic").metrics
    return spark.range(1).select(*[F.lit(m[k]).alias(k) for k in ("auc_cv_mean", "auc_cv_std", "brier_cv_mean",
                                                                  "n_samples", "folds", "model_type")])
