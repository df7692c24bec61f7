"""Canonical folders as they really come: required columns only, optional ones gone, postings in file order."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions.expr import cents
from quire.operators.features.assemble import FAMILY_FEATURES, family_features
from quire.operators.reconcile import daily_closing_balance, running_balance
from quire.plans.queries import plain_files
from quire.sources.adapters import FIXTURE_AS_OF, fixture
from quire.sources.registry import in_file_order, load_and_validate, load_source, ready
from quire.sources.schemas import is_absent

SF = "/root/testdata/sf0.001"
DAY = dt.date(2001, 7, 31)


def posting(i, merchant, day, amount, balance):
    money = lambda v: None if v is None else Decimal(v)
    return (f"t{i}", merchant, day, money(amount), "CREDIT" if float(amount) > 0 else "DEBIT", "x", "psp_settlement",
            money(balance))


BANK = ("transaction_id string, merchant_id string, date date, amount decimal(18,2), direction string, "
        "counterparty_name string, category string, balance_after decimal(18,2)")


def test_last_row_of_a_day_closes_it(spark, tmp_path):
    """The closing balance is the last row's that has one, neither the greatest nor the last by id; over two files whose
    path needs quoting."""
    one = [posting(9, "m", DAY, "10", "110"), posting(5, "m", DAY, "900", "1010"), posting(7, "m", DAY, "-995", "15")]
    two = [posting(1, "m", DAY, "-20", "-5"), posting(0, "m", DAY, "5", None),
           posting(3, "n", DAY, "1", "7"), posting(2, "n", DAY, "1", "6")]
    folder = tmp_path / "bank of the year 50%"
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, BANK).coalesce(1).write.parquet(str(folder / f"part={i}"))
    bank = load_source(spark, "bank", str(folder))
    closing = {r["merchant_id"]: float(r["closing_balance"]) for r in daily_closing_balance(bank, DAY).collect()}
    assert closing == {"m": -5.0, "n": 6.0}
    again = {r["transaction_id"]: float(r["balance_after"]) for r in
             running_balance(bank.drop("balance_after"), 0).collect()}
    assert (again["t9"], again["t5"], again["t7"], again["t1"], again["t0"]) == (10, 910, -85, -105, -100)


def test_rows_without_files_have_no_order(spark):
    with pytest.raises(ValueError, match="posting_seq"):
        in_file_order(spark.createDataFrame([posting(1, "m", DAY, "1", "1")], BANK).groupBy("merchant_id").count())
    with pytest.raises(ValueError, match="posting_seq"):
        ready(spark.createDataFrame([posting(1, "m", DAY, "1", "1")], BANK).groupBy(*[c.split()[0] for c in BANK.split(", ")
                                                                                      ]).count(), "bank")


def test_required_columns_are_enough(spark):
    sources, report = load_and_validate(spark, plain_files(spark, SF))
    assert is_absent(sources["psp"], "buyer_id") and sources["psp"].schema["buyer_id"].dataType.simpleString() == "string"
    missing = {(r["source"], r["subject"]) for r in report.where("check = 'required_column' and not passed").collect()}
    assert missing == {("kyc", "last_kyc_date")}
    stored = fixture(spark, SF).sources()
    for family in ("bank", "webshop", "marketplace", "accounting"):
        same = [family_features(s, FIXTURE_AS_OF, family).orderBy("application_id").collect() for s in (sources, stored)]
        assert same[0] == same[1], family
    psp = family_features(sources, FIXTURE_AS_OF, "psp").collect()
    assert {(r["payment_method_card_pct"], r["dispute_win_rate"], r["buyer_concentration_hhi"]) for r in psp} == {
        (0.25, 0.50, 1.0)}
    assert len(FAMILY_FEATURES["bank"]) == 16
    kyc = family_features(sources, FIXTURE_AS_OF, "kyc").where("kyc_days_since_last is not null").collect()
    assert kyc and all(r["kyc_days_since_last"] == 730.0 for r in kyc)


def test_absent_columns_of_frames(spark):
    """A frame that lacks the columns, not read from files, gives the same fallbacks; a column of NULLs does not."""
    psp = fixture(spark, SF).sources()["psp"]
    base = dict(fixture(spark, SF).sources())
    lacking = family_features(base | {"psp": psp.drop("payment_method", "dispute_outcome", "buyer_id")}, FIXTURE_AS_OF, "psp")
    assert {(r["payment_method_card_pct"], r["dispute_win_rate"], r["buyer_concentration_hhi"]) for r in lacking.collect()
            } == {(0.25, 0.50, 1.0)}
    last = psp.agg(F.max("order_date")).first()[0]
    null = family_features(base | {"psp": psp.withColumn("payment_method", F.lit(None).cast("string"))}, last, "psp")
    assert 0.0 in {r["payment_method_card_pct"] for r in null.collect()}


def test_cents_are_exact(spark):
    values = ["90071992547409.93", "9007199254740993.01", "-9007199254740993.01", "0.01", "-0.05", "12345678901234.57",
              "9999999999999.99", "10000000000000.01"]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "c decimal(18,2)")
    assert [r[0] for r in df.select(cents(F.col("c"))).collect()] == [int(Decimal(v) * 100) for v in values]
