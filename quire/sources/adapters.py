"""Adapters: canonical underwriting sources derived from the star-schema test tables.

The driver's tables (supplier, lineitem, orders, events) are mapped onto the
canonical merchant / payment / bank / webshop / marketplace / accounting / KYC /
consent layouts. Five consecutive suppliers form one merchant; one extra
"ghost" merchant has no source rows at all, so every fallback is exercised.

Everything here is a lazy DataFrame plan; Catalyst prunes the columns each
operator needs and pushes the ``<= as_of`` bound into the parquet scan.
The derived money columns are decimal(18,2), matching the DuckDB oracle views
(``quire.plans.fixture_sql``) value for value.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.reconcile import running_balance
from quire.session import remove_folder, shared_folder, write_table

# The fixture's as-of dates.
FIXTURE_AS_OF = dt.date(2001, 8, 1)
CONSENT_AS_OF = dt.date(2024, 2, 1)
#: Postings that one task orders, on average, however many there are.
TASK_POSTINGS = 250_000

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def dec(literal: str) -> Column:
    """Exact decimal literal with the precision/scale written (0.015 -> decimal(3,3))."""
    digits = literal.lstrip("-").replace(".", "")
    scale = len(literal.split(".")[1]) if "." in literal else 0
    return F.expr(f"CAST({literal} AS DECIMAL({max(len(digits), scale + 1)},{scale}))")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def merchant_key(suppkey: Column) -> Column:
    return F.floor(suppkey / 5).cast("long")


def padded(k: Column) -> Column:
    """At least four digits; longer numbers stay whole."""
    digits = k.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def merchant_id_of(k: Column) -> Column:
    return F.concat(F.lit("m_"), padded(k))


def line_id(kind: str) -> Column:
    """A line's identity; its four keys are unique together."""
    return F.concat_ws("_", F.lit(kind), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def steady(k: Column) -> Column:
    """Merchants with even settlements, so that approvals occur in the fixture."""
    return (k % 10).isin(1, 2, 3)


class FixtureSources:
    """Lazy canonical views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date = FIXTURE_AS_OF,
                 materialized: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of
        self.materialized = materialized
        self._tables: dict[str, DataFrame] = {}
        self._scratch: list[str] = []

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table that stays until ``clear_scratch``."""
        self._scratch.append(shared_folder(self.spark, name))
        return write_table(df, name, self._scratch[-1])

    def clear_scratch(self, but: int = 0) -> None:
        """Remove the scratch tables, which nothing reads any more, but the last ``but``."""
        for path in self._scratch[:len(self._scratch) - but]:
            remove_folder(self.spark, path)
        self._scratch = self._scratch[len(self._scratch) - but:]

    def _store(self, name: str, build, folder: str | None = None) -> DataFrame:
        """Each canonical view is derived once and written as a reliable
        checkpoint (the shared checkpoint folder), like a stored source table:
        every operator and every later query reads it instead of re-deriving
        joins, windows and aggregates from the raw star schema."""
        if name not in self._tables:
            df = build()
            self._tables[name] = write_table(df, folder or name) if self.materialized else df
        return self._tables[name]

    def _view(self, name: str, build) -> DataFrame:
        """A view whose rows are stored as numbers; its projection is not written again."""
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def keep(self, name: str, written: DataFrame) -> DataFrame:
        """A view that has been written elsewhere: views derived from it read that table."""
        self._tables[name] = written
        return written

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ masters
    @property
    def merchants(self) -> DataFrame:
        return self._store("merchants", self._build_merchants)

    def _build_merchants(self) -> DataFrame:
        ks = self.table("supplier").select(merchant_key(F.col("s_suppkey")).alias("k")).distinct()
        ghost = ks.agg((F.max("k") + 1).alias("k")).withColumn("ghost", F.lit(True))
        a = ks.withColumn("ghost", F.lit(False)).unionByName(ghost)
        k = F.col("k")
        as_of = F.lit(self.as_of)
        return a.select(
            "k", "ghost",
            merchant_id_of(k).alias("merchant_id"),
            F.concat(F.lit("Shop"), padded(k), F.lit(" B.V.")).alias("company_name"),
            (F.lit(10000000) + k * 7919).cast("string").alias("kvk_number"),
            F.date_sub(as_of, (F.lit(650) + (k * 397) % 2200).cast("int")).alias("incorporation_date"),
            (F.lit(300000) + (k * 104729) % 4700000).cast("double").alias("annual_gmv"),
            (F.lit(1) + k % 3).cast("int").alias("n_psps"),
            F.when(k % 5 == 0, "fashion").when(k % 5 == 1, "electronics").when(k % 5 == 2, "home")
             .when(k % 5 == 3, "food").otherwise("beauty").alias("sector"),
            (k % 17 == 16).alias("sanctions_hit"),
            (k % 13 != 12).alias("kvk_active"),
            (k % 5 == 0).alias("is_bad_synthetic"),
            (k % 5 != 4).alias("has_webshop"),
            F.when(k % 20 < 10, "bol.com").when(k % 20 < 16, "amazon").alias("primary_marketplace"),
        )

    @property
    def applications(self) -> DataFrame:
        return self._store("applications", self._build_applications)

    def _build_applications(self) -> DataFrame:
        k = F.col("k")
        amount = F.when(k % 50 == 13, 2000).when(k % 7 == 0, 10000).when(k % 7 == 1, 15000).when(k % 7 == 2, 20000) \
            .when(k % 7 == 3, 25000).when(k % 7 == 4, 40000).when(k % 7 == 5, 50000).otherwise(75000)
        tenor = F.when(k % 5 == 0, 3).when(k % 5 == 1, 6).when(k % 5 == 2, 9).when(k % 5 == 3, 12).otherwise(18)
        return self.merchants.select(
            F.concat(F.lit("app_"), F.col("merchant_id")).alias("application_id"),
            "merchant_id",
            amount.cast("int").alias("requested_amount"),
            tenor.cast("int").alias("requested_tenor_months"),
            F.lit("inventory").alias("purpose"),
            F.lit(self.as_of).alias("application_date"),
        )

    # ------------------------------------------------------------------ facts
    def _shipped(self) -> DataFrame:
        li = self.table("lineitem")
        upper = F.lit((self.as_of + dt.timedelta(days=1)).isoformat()).cast("timestamp_ntz")
        return li.filter(F.col("l_shipdate") < upper)

    @property
    def psp(self) -> DataFrame:
        return self._store("psp", self._build_psp)

    def _build_psp(self) -> DataFrame:
        li = self._shipped()
        o = self.table("orders").select("o_orderkey", "o_custkey")
        j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        k = merchant_key(F.col("l_suppkey"))
        gross = money(F.col("l_extendedprice"))
        pk = F.col("l_partkey")
        ln = F.col("l_linenumber")
        is_cb = pk % 150 == 0
        base = j.select(
            line_id("P").alias("psp_transaction_id"),
            merchant_id_of(k).alias("merchant_id"),
            k.alias("k"),
            F.when(steady(k), F.when(ln % 3 == 0, "mollie").when(ln % 3 == 1, "adyen").otherwise("stripe"))
             .when(ln % 2 == 0, "mollie").otherwise("adyen").alias("psp_name"),
            F.col("l_shipdate").cast("date").alias("order_date"),
            F.date_add(F.col("l_shipdate").cast("date"), (F.lit(1) + pk % F.when(steady(k), 4).otherwise(9)).cast("int"))
             .alias("settlement_date"),
            gross.alias("gross_amount"),
            money(F.round(gross * dec("0.015"), 2)).alias("fee_amount"),
            F.when(is_cb, "chargeback")
             .when((pk % 100 >= 1) & (pk % 100 <= F.when(steady(k), 1).otherwise(2 + 2 * (k % 5))), "refunded")
             .otherwise("paid").alias("status"),
            F.when(ln % 4 == 0, "ideal").when(ln % 4 == 1, "creditcard").when(ln % 4 == 2, "bancontact")
             .otherwise("klarna").alias("payment_method"),
            F.concat(F.lit("buyer_"), F.col("o_custkey").cast("string")).alias("buyer_id"),
            F.when(is_cb, F.when(F.col("l_orderkey") % 2 == 0, "won").otherwise("lost")).alias("dispute_outcome"),
        )
        return base.withColumn("net_amount", money(F.col("gross_amount") - F.col("fee_amount"))) \
                   .withColumn("refund_amount",
                               F.when(F.col("status") == "paid", F.lit(0).cast("decimal(18,2)"))
                                .otherwise(F.col("gross_amount")))

    @property
    def bank(self) -> DataFrame:
        return self._view("bank", self._build_bank)

    def _build_bank(self) -> DataFrame:
        """Texts are made when they are read, from stored numbers."""
        k, ln, credit = F.col("k"), F.col("l_linenumber"), F.col("_credit")
        balances = self._store("balances", self._build_balances, "bank")
        if self.materialized:
            self.clear_scratch()
        return balances.select(
            self._posting_id().alias("transaction_id"), merchant_id_of(k).alias("merchant_id"), "k", "date", "amount",
            F.when(credit, "CREDIT").otherwise("DEBIT").alias("direction"),
            F.when(~credit, F.concat(F.lit("Supplier_"), (F.col("l_partkey") % 19).cast("string")))
             .when(F.col("psp_name") == "mollie", "Mollie B.V.").when(F.col("psp_name") == "adyen", "Adyen N.V.")
             .otherwise("Stripe Ltd.").alias("counterparty_name"),
            F.when(credit, "psp_settlement").when(~F.col("_final"), "bank_fee").when(ln <= 4, "supplier_payment")
             .when(ln == 5, "advertising").when(ln == 6, "tax_payment").otherwise("nsf_fee").alias("category"),
            "balance_after", "posting_seq")

    def scratch_balances(self) -> None:
        """Write the balances as a scratch table, which the bank then reads."""
        self.keep("balances", self.scratch(self._build_balances(), "balances"))
        self.clear_scratch(but=1)

    @staticmethod
    def _posting_id() -> Column:
        return F.when(F.col("_credit"), F.concat_ws("_", F.lit("C"), "date", "psp_name")).otherwise(line_id("D"))

    def _build_balances(self) -> DataFrame:
        k = F.col("k")
        same_month = Window.partitionBy("k", "_in")
        even = F.expr("CAST(_month * 100 AS BIGINT) * 98 div (100 * _n)").cast("decimal(18,0)") / dec("100.0")
        credits = (
            self.psp.filter((F.col("status") == "paid") & (F.col("settlement_date") <= F.lit(self.as_of)))
            .select("k", "settlement_date", "psp_name", "net_amount", F.trunc("settlement_date", "month").alias("_in"))
            .repartition("k", "_in")  # one exchange for the days' sums and the months'
            .groupBy("k", "_in", "settlement_date", "psp_name").agg(F.sum("net_amount").alias("net"))
            .withColumn("_month", F.sum("net").over(same_month)).withColumn("_n", F.count(F.lit(1)).over(same_month))
            .select(
                "k", F.col("settlement_date").alias("date"),
                F.when(steady(k), money(even))
                 .otherwise(money(F.round(F.col("net") * F.when(k % 10 == 9, dec("0.70")).otherwise(dec("0.98")), 2)))
                 .alias("amount"),
                F.lit(True).alias("_credit"), "psp_name",
            )
        )
        li = self._shipped()
        lk = merchant_key(F.col("l_suppkey"))
        ln = F.col("l_linenumber")
        final = F.col("l_linestatus") == "F"

        def share(times: int) -> Column:
            part = lambda literal: dec(str(Decimal(literal) * times))
            return (F.when(~final, part("0.01")).when(ln <= 4, part("0.80"))
                    .when(ln == 5, F.when(lk % 5 == 0, part("3.00")).otherwise(part("0.60")))
                    .when(ln == 6, part("0.50")).otherwise(part("0.01")))

        factor = F.when(lk % 10 == 5, share(4)).otherwise(share(1))
        debits = li.select(
            lk.alias("k"), F.col("l_shipdate").cast("date").alias("date"),
            money(-F.round(money(F.col("l_extendedprice")) * factor, 2)).alias("amount"),
            F.lit(False).alias("_credit"), final.alias("_final"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
        # the postings are read twice: for the sums of spans of days and for the balances; numbers only
        postings = self.scratch(credits.unionByName(debits, allowMissingColumns=True), "postings")
        parts = math.ceil(postings.count() / TASK_POSTINGS) or None
        return running_balance(postings, merchant="k", identity=self._posting_id(), parts=parts)

    @property
    def webshop(self) -> DataFrame:
        return self._store("webshop", self._build_webshop)

    def _build_webshop(self) -> DataFrame:
        li = self._shipped()
        o = self.table("orders").select("o_orderkey", "o_custkey")
        k = merchant_key(F.col("l_suppkey"))
        j = li.filter(k % 5 != 4).join(o, li.l_orderkey == o.o_orderkey, "inner")
        ln = F.col("l_linenumber")
        pk50 = F.col("l_partkey") % 50
        gross = money(F.col("l_extendedprice"))
        return j.select(
            line_id("O").alias("order_id"),
            merchant_id_of(k).alias("merchant_id"),
            F.col("l_shipdate").cast("date").alias("order_date"),
            F.when(ln % 3 == 0, "website").when(ln % 3 == 1, "mobile_app").otherwise("api").alias("channel"),
            gross.alias("gross_amount"),
            money(F.round(gross * F.col("l_discount").cast("decimal(4,2)"), 2)).alias("discount_amount"),
            F.col("l_quantity").cast("int").alias("item_count"),
            F.concat(F.lit("sku_"), (F.col("l_partkey") % 40).cast("string")).alias("sku_id"),
            F.when(pk50 < F.lit(1) + k % 5, "cancelled").when((pk50 >= 10) & (pk50 <= 12), "returned")
             .otherwise("completed").alias("status"),
            (F.col("l_quantity").cast("int") % 6).alias("fulfillment_days"),
            (F.col("o_custkey") % 3 == 0).alias("is_repeat_customer"),
            F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("customer_id"),
        )

    @property
    def marketplace(self) -> DataFrame:
        return self._store("marketplace", self._build_marketplace)

    def _build_marketplace(self) -> DataFrame:
        m = self.merchants.filter(F.col("primary_marketplace").isNotNull()) \
            .select("merchant_id", "primary_marketplace")
        p = self.psp.select("merchant_id", "k", "order_date", "gross_amount", "status", "psp_name")
        month = F.trunc(F.col("order_date"), "month")
        g = p.join(m, "merchant_id", "inner").groupBy(
            "merchant_id", F.col("primary_marketplace").alias("marketplace"), "k", month.alias("month")
        ).agg(
            F.sum("gross_amount").alias("gmv"),
            (F.count(F.lit(1)) * 10).alias("order_count"),
            F.sum(F.when(F.col("status") == "refunded", 1).otherwise(0)).alias("cancelled_count"),
            F.sum(F.when((F.col("psp_name") == "mollie") & (F.col("k") % 4 == 0), 1).otherwise(0))
             .alias("late_shipment_count"),
            F.sum(F.when(F.col("status") == "refunded", 1).otherwise(0)).alias("return_count"),
            F.sum(F.when(F.col("status") == "chargeback", 1).otherwise(0)).alias("negative_feedback_count"),
        )
        k = F.col("k")
        mon = F.month("month")
        return g.select(
            "merchant_id", "marketplace", "month", "gmv", "order_count", "cancelled_count",
            "late_shipment_count", "return_count", "negative_feedback_count",
            (F.lit(4) + k % 6 + mon % 2).cast("double").alias("account_health_score"),
            ((k % 8 == 3) & (mon % 3 == 0)).alias("payout_hold_active"),
            (F.lit(2) + k % 9).cast("double").alias("payout_lag_days"),
            (k % 2).cast("long").alias("policy_violation_count"),
            ((F.lit(20) + k % 50).cast("double") / 100).alias("marketplace_gmv_share"),
        )

    @property
    def accounting(self) -> DataFrame:
        return self._store("accounting", self._build_accounting)

    def _build_accounting(self) -> DataFrame:
        k = F.col("k")
        t = (self.bank.filter((F.col("direction") == "CREDIT") & (k % 9 != 8))
             .groupBy("merchant_id", "k", F.trunc("date", "month").alias("month"))
             .agg(F.sum("amount").alias("bank_revenue"),
                  F.max_by("balance_after", F.unix_date("date").cast("long") * 4294967296 + F.col("posting_seq"))
                   .alias("cash_balance"))
             .select("merchant_id", "k", "month", "bank_revenue", "cash_balance",
                     money(F.round(F.col("bank_revenue") * F.when(k % 10 == 0, dec("1.20")).otherwise(dec("1.01")), 2))
                     .alias("gross_revenue"),
                     (dec("0.10") + dec("0.05") * (k % 10) + F.when(steady(k), dec("0.25")).otherwise(dec("0.00")))
                     .cast("decimal(6,2)").alias("gross_margin")))
        rev = F.col("gross_revenue")
        gm = F.col("gross_margin")
        mon = F.month("month")
        cogs = money(F.round(rev * (F.lit(1) - gm), 2))
        ebitda = money(F.round(rev * (gm - dec("0.12")), 2))
        nothing = F.lit(0).cast("decimal(18,2)")
        due = F.when(mon.isin(1, 4, 7, 10), money(F.round(rev * dec("0.21"), 2))).otherwise(nothing)
        on_time = ~((k % 6 == 0) & (mon == 7))
        days = lambda a, b: (F.lit(a) + k % b).cast("decimal(10,0)")
        return t.select(
            "merchant_id", "month", "gross_revenue", "gross_margin",
            cogs.alias("cogs"), money(rev - cogs).alias("gross_profit"), money(rev - cogs - ebitda).alias("total_opex"),
            ebitda.alias("ebitda"),
            money(F.round(rev * days(5, 20) / 30, 2)).alias("accounts_receivable"),
            money(F.round(cogs * days(15, 40) / 30, 2)).alias("accounts_payable"),
            "cash_balance", money(F.round(rev * dec("0.21"), 2)).alias("btw_accrued"),
            due.alias("btw_due"), F.when(on_time, due).otherwise(nothing).alias("btw_paid"),
            on_time.alias("btw_paid_on_time"),
            money(F.round(rev * dec("0.03"), 2)).alias("owner_draws"),
            (F.lit(15) + k % 40).cast("double").alias("ap_days"),
            (F.lit(5) + k % 20).cast("double").alias("ar_days"),
            F.when(F.col("bank_revenue") > 0,
                   F.round((rev - F.col("bank_revenue")).cast("double") / F.col("bank_revenue").cast("double"), 4))
             .otherwise(F.lit(0.0)).alias("revenue_bank_delta"),
        )

    @property
    def kyc(self) -> DataFrame:
        return self._store("kyc", self._build_kyc)

    def _build_kyc(self) -> DataFrame:
        k = F.col("k")
        return self.merchants.filter(~F.col("ghost")).select(
            "merchant_id", "kvk_number", F.concat(F.lit("Owner of "), "company_name").alias("ubo_name"),
            F.col("kvk_active").alias("kvk_verified"),
            (k % 11 != 10).alias("ubo_director_match"),
            (k % 4 != 3).alias("ubo_verified"),
            F.lit(False).alias("pep_match"),
            F.col("sanctions_hit").alias("sanctions_match"),
            (k % 4).cast("int").alias("identity_changes_12m"),
            F.date_sub(F.lit(self.as_of), (F.lit(30) + (k * 53) % 700).cast("int")).alias("last_kyc_date"),
            F.when(k % 3 == 0, "basic").when(k % 3 == 1, "enhanced").otherwise("full").alias("verification_level"),
        )

    @property
    def consents(self) -> DataFrame:
        return self._store("consents", self._build_consents)

    def _build_consents(self) -> DataFrame:
        ev = self.table("events")
        is_err = F.col("event_type") == "error"
        return ev.select(
            merchant_id_of(merchant_key(F.col("user_id"))).alias("merchant_id"),
            F.when(F.col("event_id") % 3 == 0, "psd2_aisp").when(F.col("event_id") % 3 == 1, "psp_mollie")
             .otherwise("psp_adyen").alias("consent_type"),
            F.when(is_err, "REVOKED").otherwise("GRANTED").alias("action"),
            F.col("ts").alias("event_ts"), "event_id",
            F.when(is_err, F.lit(None).cast("date")).otherwise(F.date_add(F.col("ts").cast("date"), 90))
             .alias("expires_at"),
        )

    def sources(self) -> Mapping[str, DataFrame]:
        return _ByNeed(self)


class _ByNeed(Mapping):
    """Sources by name; each is derived when it is first asked for."""

    NAMES = ("merchants", "applications", "bank", "psp", "webshop", "marketplace", "accounting", "kyc")

    def __init__(self, of: FixtureSources):
        self._of = of

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self._of, name)

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)


_CACHE: dict[tuple, FixtureSources] = {}


def fixture(spark: SparkSession, sf_dir: str, as_of: dt.date = FIXTURE_AS_OF,
            materialized: bool = True) -> FixtureSources:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), as_of, materialized)
    if key not in _CACHE:
        _CACHE[key] = FixtureSources(spark, sf_dir, as_of, materialized)
    return _CACHE[key]
