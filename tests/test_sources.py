"""Optional sources, the ghost merchant, and partitioning invariance."""

import pytest
from pyspark.sql import functions as F

from quire.operators.features.assemble import compute_features
from quire.operators.features.registry import DEFAULTS
from quire.sources.adapters import FIXTURE_AS_OF, fixture

SF = "/root/testdata/sf0.001"


def test_missing_optional_sources_take_registry_defaults(spark):
    src = dict(fixture(spark, SF).sources())
    for opt in ("webshop", "marketplace", "accounting", "kyc"):
        src[opt] = None
    rows = compute_features(src, FIXTURE_AS_OF).collect()
    for r in rows:
        assert r.cancellation_rate_90d == DEFAULTS["cancellation_rate_90d"]
        assert r.marketplace_payout_hold_flag is True
        assert r.vat_punctuality == DEFAULTS["vat_punctuality"]
        assert r.ubo_director_match is False


def test_ghost_merchant_gets_operator_fallbacks(spark):
    f = compute_features(fixture(spark, SF).sources(), FIXTURE_AS_OF)
    ghost = [r for r in f.collect() if r.bank_psp_recon_delta == 1.0 and r.data_coverage_score == 0.0]
    assert len(ghost) == 1
    g = ghost[0]
    assert g.dispute_win_rate == 0.50           # the operator's own value beats the registry's 0.0
    assert g.cashflow_trend_delta == 0.0        # likewise (registry -0.20)
    assert g.revenue_volatility_90d == 0.50 and g.settlement_delay_p95 == 12.0


def test_partitioning_does_not_change_features(spark):
    fx = fixture(spark, SF)
    src = fx.sources()
    a = compute_features(src, FIXTURE_AS_OF)
    shuffled = {k: (v.repartition(7, F.rand(5)) if v is not None else None) for k, v in src.items()}
    b = compute_features(shuffled, FIXTURE_AS_OF)
    rnd = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())  # noqa
    assert rnd(a) == rnd(b)


def test_long_keys_stay_apart(spark):
    from pyspark.sql import functions as F

    from quire.sources.adapters import merchant_id_of
    keys = spark.createDataFrame([(7,), (1000,), (10000,), (10009,), (123456,)], "k long")
    got = [r[0] for r in keys.select(merchant_id_of(F.col("k"))).collect()]
    assert got == ["m_0007", "m_1000", "m_10000", "m_10009", "m_123456"]


def test_closing_balance_is_the_last_posting(spark):
    import datetime as dt

    from quire.operators.reconcile import daily_closing_balance, running_balance
    day = [dt.date(2001, 7, d) for d in (1, 2, 3)]
    rows = [("m", d, t, a) for d, entries in zip(day, [[("a", 500), ("b", -11000)], [("a", 800), ("b", -900)], [("a", 100),
            ("b", -200), ("c", None)]]) for t, a in entries]
    plain = spark.createDataFrame(rows, "merchant_id string, date date, transaction_id string, amount int")
    posted = running_balance(plain.withColumn("amount", plain["amount"].cast("decimal(18,2)")))
    balances = {(r["date"].day, r["transaction_id"]): float(r["balance_after"]) for r in posted.collect()}
    assert balances[1, "a"] == 10500 and balances[1, "b"] == -500 and balances[2, "a"] == 300 and balances[2, "b"] == -600
    closing = {r["date"].day: float(r["closing_balance"]) for r in daily_closing_balance(posted, day[2]).collect()}
    assert closing == {1: -500, 2: -600, 3: -700}


def test_auc_and_quartiles_of_close_scores(spark):
    from quire.operators import monitor as M
    scored = spark.createDataFrame([(0.12341, 0), (0.12342, 0), (0.12343, 1), (0.12344, 1), (None, 1), (0.5, None)],
                                   "score double, label int")
    r = M.auc_brier(scored, "score", "label").first()
    assert r["auc"] == 1.0 and (r["P"], r["N"]) == (2, 2)
    q = M.score_quartiles(scored.where("label is not null").selectExpr("'x' as decision", "score as shadow_ml_score")).first()
    assert q["n"] == 4 and abs(q["q50"] - 0.123425) < 1e-6
    assert scored.where("score is null").select(M.risk_tier(scored["score"])).first()[0] is None


def test_canonical_folder_round_trip(spark, tmp_path):
    import datetime as dt

    from quire.operators.features.assemble import family_features
    from quire.sources.adapters import FIXTURE_AS_OF, fixture
    from quire.sources.registry import load_and_validate, load_source
    fx = fixture(spark, "/root/testdata/sf0.001")
    paths = {}
    for name, df in fx.sources().items():
        paths[name] = str(tmp_path / name)
        (df.withColumn("unknown", df["merchant_id"])).write.parquet(paths[name])
    sources, report = load_and_validate(spark, paths)
    failed = [(r["source"], r["subject"]) for r in report.where("check = 'required_column' and not passed").collect()]
    assert failed == [] and "unknown" not in sources["bank"].columns
    assert report.where("check <> 'required_column'").count() > 20
    same = [family_features(s, FIXTURE_AS_OF, "accounting").orderBy("application_id").collect()
            for s in (sources, fx.sources())]
    assert same[0] == same[1]
    assert load_source(spark, "webshop", str(tmp_path / "absent")).count() == 0
    try:
        load_source(spark, "bank", str(tmp_path / "absent"))
        raise AssertionError("a mandatory source must exist")
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)
    assert dt.date(2001, 8, 1) == FIXTURE_AS_OF


def test_nan_is_missing(spark):
    import datetime as dt

    from quire.operators.features.assemble import family_stats
    from quire.operators.quality import data_quality_report
    from quire.sources.schemas import SCHEMAS
    as_of = dt.date(2001, 8, 1)
    months = [dt.date(2001, 5, 1), dt.date(2001, 6, 1), dt.date(2001, 7, 1)]
    nan = float("nan")

    def monthly(name, **values):
        rows = [tuple("m" if f.name == "merchant_id" else d if f.name == "month" else values.get(f.name, [None] * 3)[i]
                      for f in SCHEMAS[name].fields) for i, d in enumerate(months)]
        return spark.createDataFrame(rows, SCHEMAS[name])

    sources = {"merchants": spark.createDataFrame([], SCHEMAS["merchants"]),
               "marketplace": monthly("marketplace", account_health_score=[8.0, nan, 9.0],
                                      marketplace_gmv_share=[0.2, nan, 0.4], payout_lag_days=[nan, 3.0, 5.0]),
               "accounting": monthly("accounting", ap_days=[nan, 10.0, 20.0], ar_days=[1.0, 3.0, nan],
                                     revenue_bank_delta=[nan, 0.1, 0.3], gross_margin=[0.1, nan, 0.3])}
    stats = family_stats(sources, as_of)
    m, a = stats["marketplace"].first(), stats["accounting"].first()
    assert (m["mp_health_avg"], m["mp_lag"]) == (8.5, 4.0) and abs(m["mp_share"] - 0.3) < 1e-12
    assert m["mp_health_n"] < m["mp_n180"] and a["acc_gm_n"] < a["acc_n180"]  # trends fall to their default
    assert (a["acc_ap"], a["acc_ar"], a["acc_rbd"]) == (15.0, 2.0, 0.2)
    report = data_quality_report({"marketplace": sources["marketplace"]})
    assert abs(report.where("check = 'null_rate' and subject = 'account_health_score'").first()["value"] - 1 / 3) < 1e-9


def test_sinks(spark, tmp_path):
    import datetime as dt
    import json

    from quire.operators import audit
    consents = spark.createDataFrame([("m", "psd2_aisp", "GRANTED", dt.datetime(2024, 1, 1), 1, dt.date(2024, 3, 1))],
                                     "merchant_id string, consent_type string, action string, event_ts timestamp, "
                                     "event_id long, expires_at date")
    for batch in ("a", "a", "b"):  # a batch that is written again is there once
        audit.append_consent_log(audit.consent_records(consents), str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    monthly = spark.createDataFrame([(dt.date(2001, 7, 1), 1.0), (dt.date(2001, 8, 1), float("nan"))],
                                    "month date, v double")
    audit.write_monthly_table(monthly, str(tmp_path / "monthly"))
    assert spark.read.parquet(str(tmp_path / "monthly")).where("month = '2001-07-01'").count() == 1
    audit.export_cases_json(monthly.where("isnan(v)"), str(tmp_path / "cases"))
    line, = [x for f in (tmp_path / "cases").glob("part*") for x in f.read_text().splitlines()]
    assert json.loads(line)["v"] is None
    assert audit.load_decision_log(spark, str(tmp_path / "absent")).count() == 0


def test_old_days_are_not_shuffled(spark):
    """Feature statistics hold a day's key only inside the windows that read days: history comes as one total."""
    import datetime as dt

    from quire.functions.grains import tag_grains
    from quire.operators.features import bank as B
    from quire.operators.features import psp as PS
    as_of, seen = dt.date(2001, 8, 1), {}

    def watch(module):
        def tagged(df, *grains):
            seen[module] = tag_grains(df, *grains)
            return seen[module]
        return tagged

    days = "SELECT explode(sequence(DATE'1995-01-01', DATE'1998-01-01', interval 1 day)) AS day"
    bank = spark.sql(f"""SELECT 'm' AS merchant_id, day AS date, CAST(5 AS DECIMAL(18,2)) AS amount, 'CREDIT' AS direction,
        'psp_settlement' AS category, CAST(1 AS DECIMAL(18,2)) AS balance_after, 1L AS posting_seq, 'c' AS counterparty_name
        FROM ({days})""")
    psp = spark.sql(f"""SELECT 'm' AS merchant_id, day AS order_date, date_add(day, 2) AS settlement_date, 'paid' AS status,
        'p' AS psp_name, 'b' AS buyer_id, 'ideal' AS payment_method, CAST(NULL AS STRING) AS dispute_outcome,
        CAST(5 AS DECIMAL(18,2)) AS gross_amount, CAST(4 AS DECIMAL(18,2)) AS net_amount,
        CAST(0 AS DECIMAL(18,2)) AS refund_amount FROM ({days})""")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(B, "tag_grains", watch("bank"))
        m.setattr(PS, "tag_grains", watch("psp"))
        b, p = B.bank_stats(bank, as_of).first(), PS.psp_stats(psp, as_of).first()
    n = 3 * 365 + 2  # 1996 is a leap year
    assert (b.bk_rows_all, float(b.bk_psp_settle_all)) == (n, 5.0 * n)
    assert (p.ps_rows_all, p.ps_paid_all, p.ps_delay_s1, p.ps_paid_net_c, p.ps_delay_p50) == (n, n, 2 * n, 400 * n, 2.0)
    for tagged in seen.values():
        assert tagged.select("merchant_id", "g", "k_date", "k_str", "k_int").distinct().count() <= 4


def test_balances_of_postings_without_their_texts(spark):
    """The order inside a day may be derived from other columns, after the exchange; the balances are the same."""
    from pyspark.sql import functions as F

    from quire.operators.reconcile import running_balance
    rows = [(1, "2001-01-01", 10, 5), (1, "2001-01-01", 9, 7), (1, "2001-01-02", 1, -3), (2, "2001-01-01", 1, 4)]
    df = spark.createDataFrame(rows, "k long, d string, line long, v int").select(
        "k", F.to_date("d").alias("date"), "line", F.col("v").cast("decimal(18,2)").alias("amount"))
    text = F.concat(F.lit("D_"), F.col("line").cast("string"))
    plain = running_balance(df.select(F.col("k").cast("string").alias("merchant_id"), "date", "amount",
                                      text.alias("transaction_id")))
    derived = running_balance(df, merchant="k", identity=text)
    pick = lambda t, key: sorted((str(r[key]), r.date, r.amount, r.balance_after, r.posting_seq) for r in t.collect())
    assert pick(plain, "merchant_id") == pick(derived, "k")
    assert [r.balance_after for r in derived.orderBy("k", "date", "posting_seq").collect()] == [10005, 10012, 10009, 10004]


def test_balances_sort_postings_once_in_parts_of_bounded_size(spark):
    """A task holds its postings in one sort, not in those of a join and of a window, and takes no more when they grow."""
    from pyspark.sql import functions as F

    from quire.operators.reconcile import running_balance
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.expr("date_add(DATE '2001-01-01', cast(id % 40 as int))")
                                  .alias("date"), F.when(F.col("id") % 7 > 0, F.lit("1.50")).cast("decimal(18,2)").alias("amount"),
                                  F.col("id").cast("string").alias("text"))
    odd = df.unionByName(df.limit(9).withColumn("date", F.lit(None).cast("date")).withColumn("amount", F.lit(0).cast("decimal(18,2)")))
    out = running_balance(odd, merchant="k", identity=F.col("text"), parts=17)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and out.rdd.getNumPartitions() == 17 and len(rows) == 3000
    at = {}
    for r in sorted(rows, key=lambda r: (r.k, r.date, r.posting_seq)):
        at.setdefault(r.k, []).append(r)
    for mine in at.values():
        balance, day, n = 10_000, None, 0
        for r in mine:
            n = n + 1 if r.date == day else 1
            day, balance = r.date, balance + (r.amount or 0)
            assert r.posting_seq == n and r.balance_after in (None, balance)


def test_balances_add_a_row_per_span_and_not_per_day(spark):
    """What goes before the postings grows with a merchant's spans of days, not with its days; sorted once."""
    from pyspark.sql import functions as F

    from quire.operators.reconcile import BALANCE_SPAN_DAYS, running_balance
    days = 10 * BALANCE_SPAN_DAYS
    df = spark.range(2 * days).select(F.lit(1).alias("k"), F.expr(f"date_add(DATE '2001-01-04', cast(id % {days} as int))").alias("date"),
                                      F.lit("-2.25").cast("decimal(18,2)").alias("amount"), F.col("id").cast("string").alias("text"))
    out = running_balance(df, merchant="k", identity=F.col("text"), parts=3)
    rows = sorted(out.collect(), key=lambda r: (r.date, r.posting_seq))
    plan = out._jdf.queryExecution().executedPlan()
    assert [float(r.balance_after) for r in rows] == [10000 - 2.25 * (i + 1) for i in range(2 * days)]
    assert [r.posting_seq for r in rows] == [1, 2] * days
    text = plan.toString().split("== Initial Plan ==")[0]
    assert sum("Sort [" in line for line in text.splitlines()) == 2  # the postings, and the spans' nets


def test_psp_percentiles_take_a_row_per_delay(spark):
    """The aggregate that takes objects gets a merchant's delays, not its buyers; figures as of all rows."""
    import datetime as dt

    from pyspark.sql import functions as F

    from quire.operators.features.psp import psp_stats
    n = 400
    psp = spark.range(n).select(
        F.lit("m").alias("merchant_id"), F.lit(dt.date(2001, 7, 1)).alias("order_date"),
        F.expr("date_add(DATE '2001-07-01', cast(id % 4 as int))").alias("settlement_date"), F.lit("paid").alias("status"),
        F.lit("p").alias("psp_name"), F.concat(F.lit("b"), F.col("id")).alias("buyer_id"), F.lit("ideal").alias("payment_method"),
        F.lit(None).cast("string").alias("dispute_outcome"),
        *[F.lit(v).cast("decimal(18,2)").alias(c) for c, v in (("gross_amount", 2), ("net_amount", 1), ("refund_amount", 0))])
    out = psp_stats(psp, dt.date(2001, 8, 1))
    r = out.collect()[0]
    assert (r.ps_rows_all, r.ps_delay_p50, r.ps_delay_p95, r.ps_delay_s1) == (n, 1.5, 3.0, 600)
    assert (r.ps_buyer_total, r.ps_buyer_sq, r.ps_plat_total) == (200.0 * n, 40000.0 * n, 200.0 * n)
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    plan = text.splitlines()
    objects = [i for i, line in enumerate(plan) if "ObjectHashAggregate" in line or "SortAggregate" in line]
    assert objects and any("_delay" in line and " HashAggregate" in line for line in plan[max(objects):])
