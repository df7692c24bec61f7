"""Audit batches, nested NaN, consent inputs, value sets, validation on load, the month grid, ranks, gate versions."""

import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import audit, monitor, policy, quality, reconcile, shadow
from quire.sources.adapters import FIXTURE_AS_OF, fixture
from quire.sources.registry import load_and_validate, store_and_validate

SF = "/root/testdata/sf0.001"


def test_a_batch_is_there_once(spark, tmp_path):
    row = "m string, timestamp string, decision_date date"
    a = spark.createDataFrame([("x", "t", dt.date(2001, 8, 1)), ("y", "t", dt.date(2001, 8, 2))], row)
    b = spark.createDataFrame([("z", "t", dt.date(2001, 8, 1))], row)
    path = str(tmp_path / "log")
    for rows, batch in ((a, "1"), (b, "2"), (a, "1")):
        audit.append_decision_log(rows, path, batch)
    assert sorted(r["m"] for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]
    broken = a.withColumn("m", F.when(F.col("m") == "y", F.raise_error(F.lit("stop"))).otherwise("new"))
    with pytest.raises(Exception, match="stop"):
        audit.append_decision_log(broken, path, "3")
    with pytest.raises(Exception, match="stop"):
        audit.append_decision_log(broken, path, "1")
    assert sorted(r["m"] for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]


def test_nan_inside_arrays_and_structs(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    kind = "id int, tops array<struct<name:string,v:double>>, s struct<a:double,b:struct<c:float>>, m map<string,double>, none struct<a:double>"
    df = spark.createDataFrame([(1, [("x", nan), ("y", 2.0), None], (inf, (nan,)), {"k": -inf, "l": 1.0}, None)], kind)
    audit.export_cases_json(df, str(tmp_path / "cases"))
    line, = [x for f in (tmp_path / "cases").glob("part*") for x in f.read_text().splitlines()]
    got = json.loads(line)
    assert got["tops"] == [{"name": "x", "v": None}, {"name": "y", "v": 2.0}, None]
    assert got["s"] == {"a": None, "b": {"c": None}} and got["m"] == {"k": None, "l": 1.0} and got["none"] is None


def test_consent_scope_and_validity(spark):
    kind = ("merchant_id string, consent_type string, action string, event_ts timestamp, event_id long, "
            "scope array<string>, expires_days int")
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", "psd2_aisp", "GRANTED", at, 1, ["balances"], 30),
                                ("m", "psd2_aisp", "GRANTED", at, 2, None, None),
                                ("m", "psd2_aisp", "REVOKED", at, 3, ["balances"], 30)], kind)
    got = {r["event_id"]: (json.loads(r["scope"]), r["expires_at"]) for r in audit.consent_records(df).collect()}
    assert got == {1: (["balances"], dt.date(2024, 1, 31)), 2: (["transactions", "balances"], dt.date(2024, 3, 31)),
                   3: (["balances"], None)}


def test_invalid_values_are_named(spark):
    psp = spark.createDataFrame([("paid",)] * 3 + [("lost",)] * 2 + [(None,)], "status string")
    kyc = spark.createDataFrame([("full",), ("none",)], "verification_level string")
    got = {tuple(r) for r in quality.invalid_values({"psp": psp, "kyc": kyc}).collect()}
    assert got == {("psp", "status", "lost", 2), ("psp", "status", None, 1), ("kyc", "verification_level", "none", 1)}


def test_checks_on_load_equal_a_second_scan(spark, tmp_path):
    paths = {}
    for name, df in fixture(spark, SF).sources().items():
        paths[name] = str(tmp_path / name)
        (df.drop("status") if name == "webshop" else df).write.parquet(paths[name])
    sources, scanned = load_and_validate(spark, paths)
    stored, on_load = store_and_validate(spark, paths)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(scanned) == rows(on_load) and ("webshop", "required_column", "status", 0.0, 1.0, False) in rows(on_load)
    assert all(stored[n].count() == sources[n].count() for n in paths)


def test_month_grid(spark):
    """Months without postings or records appear with nothing in them; VAT falls due across them."""
    d = dt.date
    acc = spark.createDataFrame(
        [("m", d(2001, 2, 1), Decimal("100.00"), Decimal("40.00"), Decimal("10.00"), 30.0, 15.0),
         ("m", d(2001, 3, 1), Decimal("200.00"), Decimal("80.00"), Decimal("20.00"), 30.0, 15.0),
         ("m", d(2001, 6, 1), Decimal("50.00"), Decimal("5.00"), Decimal("1.00"), 30.0, 15.0)],
        "merchant_id string, month date, gross_revenue decimal(18,2), cogs decimal(18,2), ebitda decimal(18,2), "
        "ar_days double, ap_days double")
    bank = spark.createDataFrame([("m", d(2001, 1, 15), Decimal("7.00"), "CREDIT", Decimal("7.00"), 1),
                                  ("n", d(2001, 7, 2), Decimal("-3.00"), "DEBIT", Decimal("4.00"), 1)],
                                 "merchant_id string, date date, amount decimal(18,2), direction string, "
                                 "balance_after decimal(18,2), posting_seq long")
    got = {(r["merchant_id"], r["month"].month): r for r in reconcile.accounting_derived(acc, bank, d(2001, 8, 1)).collect()}
    assert sorted(got) == [("m", i) for i in range(1, 9)] + [("n", 7), ("n", 8)]
    assert (float(got["m", 4]["bank_revenue"]), got["m", 4]["cash_balance"]) == (0.0, 0.0)
    assert float(got["m", 4]["btw_due_derived"]) == 63.0 and float(got["m", 7]["btw_due_derived"]) == 10.5
    assert float(got["m", 1]["bank_revenue"]) == 7.0 and got["n", 7]["cash_balance"] == 4.0
    twice = spark.createDataFrame([("m", d(2001, 7, 1), 1), ("m", d(2001, 7, 1), 2)], "merchant_id string, month date, v int")
    assert sorted((r["month"].month, r["v"] or 0) for r in reconcile.every_month(twice, d(2001, 8, 1)).collect()) == [
        (7, 1), (7, 2), (8, 0)]


def test_scores_close_together_rank_exactly(spark):
    """A million scores inside one thousandth: every range holds its share, and ranks are exact."""
    n = 1_000_000
    scored = spark.range(n, numPartitions=8).select(
        (F.lit(0.5) + F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(1e9)).alias("p"),
        (F.pmod(F.col("id") * 7919, F.lit(n)) >= n // 4).cast("int").alias("label"))
    ranked = monitor._ranked(scored, "p", "label", [])
    share = [r["n"] for r in ranked.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert max(share) < 2 * n / len(share) and len(share) > 4
    wrong = ranked.where(F.col("below") != F.round((F.col("s") - 0.5) * 1e9)).count()
    assert wrong == 0
    r = monitor.auc_brier(scored, "p", "label").first()
    assert r["auc"] == 1.0 and (r["P"], r["N"]) == (n - n // 4, n // 4)
    some = scored.limit(0).unionByName(spark.createDataFrame([(3.5, 1), (-2.0, 0), (3.5, 0)], "p double, label int"))
    assert monitor.auc_brier(some, "p", "label").first()["auc"] == 0.75  # scores outside [0, 1] rank too


def test_ranks_by_group(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), (None, 0.3), (None, 0.4), (None, 0.5)], "tier string, p double")
    got = {r["tier"]: (r["n"], r["q50"]) for r in monitor.score_quartiles(df, "tier", "p").collect()}
    assert got == {"a": (2, 0.15), None: (3, 0.4)}


def test_platt_targets_are_smoothed(spark):
    """Slope and intercept equal a Newton fit of the smoothed targets in numpy; a single class is no special case."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(5)
    m = rng.normal(size=60)
    for y in ((rng.random(60) < 1 / (1 + np.exp(-2 * m - 0.5))).astype(int), np.r_[np.ones(59, int), 0]):
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        w = np.zeros(2)
        x = np.c_[m, np.ones(60)]
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (t - p))
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "m double, label int")
        got = shadow._sigmoid(VectorAssembler(inputCols=["m"], outputCol="_m").transform(df))
        assert np.allclose(got, w, atol=1e-4), (got, w)


def test_second_policy_version(spark):
    """A version with fewer and other gates; each row is judged by its own."""
    sets = {"v1": policy.GATES, "v2": [("refund_rate_ltm", 0.5, 0.9, "standard", "REFUNDS"),
                                       ("gross_margin_avg_6m", 0.9, 0.8, "inverted", "MARGIN")]}
    gates = policy.gate_table(spark, sets)
    row = {"application_id": "a", "merchant_id": "a", "refund_rate_ltm": 0.2, "gross_margin_avg_6m": 0.7, "sanctions_hit": False,
           "kvk_active": True, "ubo_director_match": True, "bank_psp_recon_delta": 0.0, "trading_months": 40.0,
           "monthly_gmv_avg_6m": 90000.0, "negative_balance_pct_90d": 0.0, "requested_amount": 15000.0,
           "requested_tenor_months": 6.0, "monthly_net_cashflow_avg_6m": 90000.0}
    df = spark.createDataFrame([row | {"policy_version": v, "application_id": v} for v in ("v1", "v2")])
    got = {r["application_id"]: r for r in policy.apply_policy(df, gates).collect()}
    assert got["v2"]["reason_codes"] == ["MARGIN"] and (got["v2"]["red_flags"], got["v2"]["amber_flags"]) == (1, 0)
    assert got["v2"]["signal_pass_rate"] == 0.5 and got["v1"]["reason_codes"] == ["HIGH_REFUND_RATE"]
    assert got["v1"]["amber_flags"] == 13
    one = policy.apply_policy(df.drop("policy_version"), gates, "v2").collect()
    assert [r["reason_codes"] for r in one] == [["MARGIN"]] * 2
    with pytest.raises(Exception, match="no gates of policy version v3"):
        policy.apply_policy(df.drop("policy_version"), gates, "v3").collect()
    assert FIXTURE_AS_OF
