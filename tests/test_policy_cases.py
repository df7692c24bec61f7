"""Policy on hand-built feature rows: the walkthrough's four cases, gate
boundaries, sizing edges. Expected values derived from the policy rules."""

import math

import pytest
from pyspark.sql import functions as F

from quire.operators import policy as P


def merchant(name, **f):
    base = dict(revenue_volatility_90d=0.12, refund_rate_ltm=0.02, settlement_delay_p95=3.0,
                chargeback_rate_ltm=0.002, platform_concentration=0.30, net_cashflow_coverage=4.0,
                supplier_pay_punctuality=0.98, ad_spend_ratio_3m=0.06, vat_punctuality=0.99,
                gross_margin_avg_6m=0.40, revenue_bank_delta_avg=0.01, marketplace_account_health_avg=9.0,
                marketplace_late_shipment_rate=0.01, cancellation_rate_90d=0.01, return_rate_90d=0.02,
                days_cash_on_hand=300.0, monthly_gmv_avg_6m=80_000.0, trading_months=40.0, kvk_active=True,
                sanctions_hit=False, ubo_director_match=True, bank_psp_recon_delta=0.03,
                negative_balance_pct_90d=0.0, requested_amount=15_000.0, requested_tenor_months=6.0,
                monthly_net_cashflow_avg_6m=18_000.0)
    base.update({k: (float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for k, v in f.items()})
    base["application_id"] = name
    base["merchant_id"] = name
    return base


CASES = [
    merchant("clean"),
    merchant("flagged", revenue_volatility_90d=0.33, platform_concentration=0.50, settlement_delay_p95=7,
             gross_margin_avg_6m=0.23, net_cashflow_coverage=17.0, monthly_gmv_avg_6m=88_000,
             days_cash_on_hand=527, monthly_net_cashflow_avg_6m=20_000),
    merchant("two_reds", chargeback_rate_ltm=0.020, revenue_volatility_90d=0.50, refund_rate_ltm=0.05,
             platform_concentration=0.60, gross_margin_avg_6m=0.25, net_cashflow_coverage=1.4,
             settlement_delay_p95=8, supplier_pay_punctuality=0.78, ad_spend_ratio_3m=0.22, vat_punctuality=0.80,
             revenue_bank_delta_avg=0.10, marketplace_account_health_avg=6.5, marketplace_late_shipment_rate=0.05,
             cancellation_rate_90d=0.05, return_rate_90d=0.09, days_cash_on_hand=40, monthly_gmv_avg_6m=45_000,
             trading_months=30, monthly_net_cashflow_avg_6m=9_000),
    merchant("kyc_fail", ubo_director_match=False, revenue_volatility_90d=0.38, platform_concentration=0.58,
             chargeback_rate_ltm=0.010, refund_rate_ltm=0.06, gross_margin_avg_6m=0.28, settlement_delay_p95=9,
             marketplace_account_health_avg=6.0, return_rate_90d=0.08, cancellation_rate_90d=0.05,
             days_cash_on_hand=60, monthly_gmv_avg_6m=50_000),
]


def run(spark, rows):
    df = spark.createDataFrame(rows)
    return {r["application_id"]: r for r in P.apply_policy(df).collect()}


def test_walkthrough_cases(spark):
    out = run(spark, CASES)
    c = out["clean"]
    assert (c.decision, c.max_amount, c.pricing_band, c.tenor_max_months) == ("APPROVE", 15000.0, "A", 6)
    assert c.signal_pass_rate == 1.0 and c.manual_review_flags == ["YEAR1_ALL_MANUAL_REVIEW"]
    f = out["flagged"]
    assert (f.decision, f.max_amount, f.pricing_band, f.red_flags, f.amber_flags) == ("APPROVE", 15000.0, "B", 0, 4)
    assert f.signal_pass_rate == 0.7333
    t = out["two_reds"]
    assert (t.decision, t.max_amount, t.pricing_band, t.red_flags, t.amber_flags) == \
        ("MANUAL_REVIEW", 15000.0, "C", 2, 13)
    assert t.reason_codes == ["HIGH_REV_VOLATILITY", "HIGH_CHARGEBACKS"] and t.signal_pass_rate == 0.0
    assert t.manual_review_flags == ["2 red flags, 13 amber flags"]
    k = out["kyc_fail"]
    assert (k.decision, k.max_amount, k.pricing_band, k.tenor_max_months) == ("DECLINE", 0.0, None, 0)
    assert k.reason_codes == ["UBO_MISMATCH"] and k.signal_pass_rate == 0.0 and k.manual_review_flags == []
    assert k.explanations[0].startswith("UBO / director identity mismatch")


@pytest.mark.parametrize("feature,green,red,kind,code", P.GATES)
def test_gate_boundaries(spark, feature, green, red, kind, code):
    eps = 1e-9
    worse = 1 if kind == "standard" else -1
    probes = {"at_green": float(green), "at_red": float(red), "past_red": red + worse * eps,
              "inside_green": green - worse * eps, "null": None, "nan": float("nan")}
    rows = [merchant(n, **{feature: v}) for n, v in probes.items()]
    df = spark.createDataFrame(rows, schema=spark.createDataFrame([merchant("x")]).schema)
    got = {r["application_id"]: {g["feature"]: (g["status"], g["code"]) for g in r["gates"]}[feature]
           for r in P.with_gates(df).collect()}
    assert {c for _, c in got.values()} == {code}
    got = {k: s for k, (s, _) in got.items()}
    assert got["at_green"] == "green"          # boundary is not worse than green
    assert got["at_red"] == "amber"            # red boundary itself is amber
    assert got["past_red"] == "red"
    assert got["inside_green"] == "green"
    assert got["null"] == "amber" and got["nan"] == "amber"   # missing = red boundary = amber


def test_sizing_edges(spark):
    rows = [merchant("negative_cf", monthly_net_cashflow_avg_6m=-5000),
            merchant("below_min", requested_amount=9999),
            merchant("cap", requested_amount=25000, monthly_net_cashflow_avg_6m=100_000),
            merchant("half_even_down", requested_amount=10050),
            merchant("half_even_up", requested_amount=10150)]
    out = run(spark, rows)
    assert out["negative_cf"].max_amount == 0.0 and "BELOW_MIN_LOAN_SIZE" not in out["negative_cf"].reason_codes
    assert out["below_min"].max_amount == 0.0 and "BELOW_MIN_LOAN_SIZE" in out["below_min"].reason_codes
    assert out["cap"].max_amount == 25000.0 and "YEAR1_CAP" in out["cap"].reason_codes
    assert out["half_even_down"].max_amount == 10000.0
    assert out["half_even_up"].max_amount == 10200.0


def test_knockout_order(spark):
    r = run(spark, [merchant("all", sanctions_hit=True, kvk_active=False, ubo_director_match=False,
                             bank_psp_recon_delta=0.5, trading_months=1.0, monthly_gmv_avg_6m=10.0,
                             negative_balance_pct_90d=0.9)])["all"]
    assert r.reason_codes == ["SANCTIONS_HIT", "KVK_INVALID", "UBO_MISMATCH", "RECON_FAIL", "INSUFFICIENT_HISTORY",
                              "REVENUE_TOO_LOW", "PERSISTENT_NEGATIVE_BALANCE"]
    assert r.red_flags is None and r.signal_pass_rate == 0.0


def test_case_records_carry_tenor_and_top_features(spark):
    from quire.operators.scorecard import case_records
    from quire.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    top = spark.createDataFrame([("a", "A", 1.5), ("b", "B", 7.0)], "name string, label string, importance double")
    rows = case_records(Q.decided(spark, sf), Q.card(spark, sf), Q.fx(spark, sf).merchants, top).collect()
    assert rows and all(r["requested_tenor_months"] is not None for r in rows)
    assert all([x["name"] for x in r["ml_top_features"]] == ["b", "a"] for r in rows)
    assert all(len(r["scorecard"]) == 18 for r in rows)
