"""Reconciliation and time-indexed derivations.

The month grid for accounting rows is an equi-join on
``(merchant_id, trunc(date, 'MM'))`` after aggregating postings per month:
the range join [month_start, month_start + 1 month) never materializes pairs.
Running sums run over per-day or per-month pre-aggregates, so one window
partition holds at most a merchant's days or months, never its raw rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import cents, dbl, eur, week_start_day
from quire.sources.schemas import POSTING_ORDER

RECON_MAX_DELTA = 0.20
OPENING_BALANCE = 10_000
#: Days of one merchant whose postings a task orders together.
BALANCE_SPAN_DAYS = 14
# VAT rate and the months in which accumulated VAT falls due.
VAT_RATE = "0.21"
VAT_PAYMENT_MONTHS = (1, 4, 7, 10)


def settled_totals(bank: DataFrame, psp: DataFrame, as_of: dt.date,
                   history: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per merchant the cents of settlement credits in the bank, and of paid net amounts at the PSPs, of all history
    up to ``as_of``. With ``history`` (see ``quire.sources.store``) only the month of ``as_of`` is read from the rows."""
    month = F.lit(as_of.replace(day=1))
    b = bank.filter((F.col("date") <= F.lit(as_of)) & (F.col("category") == "psp_settlement"))
    p = psp.filter((F.col("order_date") <= F.lit(as_of)) & (F.col("status") == "paid"))
    if history is not None:
        b, p = b.filter(F.col("date") >= month), p.filter(F.col("order_date") >= month)
    b = b.select("merchant_id", cents(F.col("amount")).alias("c"))
    p = p.select("merchant_id", cents(F.col("net_amount")).alias("c"))
    if history is not None:
        b = b.unionByName(history["bank"].filter(F.col("month") < month).select("merchant_id", F.col("psp_settle").alias("c")))
        paid = (F.col("month") < month) & (F.col("g") == "t") & (F.col("k_str") == "paid")
        p = p.unionByName(history["psp"].filter(paid).select("merchant_id", F.col("net_c").alias("c")))
    return (b.groupBy("merchant_id").agg(F.sum("c").alias("bank_c")), p.groupBy("merchant_id").agg(F.sum("c").alias("psp_c")))


def reconcile_bank_psp(merchants: DataFrame, bank: DataFrame, psp: DataFrame, as_of: dt.date,
                       history: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Bank psp_settlement credits vs PSP paid net per merchant, all history."""
    b, p = settled_totals(bank, psp, as_of, history)
    m = merchants.select("merchant_id").distinct()
    j = m.join(b, "merchant_id", "left").join(p, "merchant_id", "left")
    bank_c, psp_c = (F.coalesce(F.col(c), F.lit(0)) for c in ("bank_c", "psp_c"))
    # signed denominator, as specified: a negative PSP total gives a negative delta
    delta = F.when(psp_c == 0, F.lit(1.0)).otherwise(F.try_divide(dbl(F.abs(bank_c - psp_c)), dbl(psp_c)))
    return j.select(
        "merchant_id",
        F.round(eur(bank_c), 2).alias("bank_psp_credits"),
        F.round(eur(psp_c), 2).alias("psp_net_settled"),
        F.round(delta, 4).alias("recon_delta"),
        (delta <= RECON_MAX_DELTA).alias("recon_pass"),
        F.when(delta > RECON_MAX_DELTA, F.lit("RECON_FAIL")).alias("flag"),
    )


def daily_closing_balance(bank: DataFrame, as_of: dt.date) -> DataFrame:
    """One closing balance per (merchant, day) with postings: that of the day's last posting
    (by posting_seq) with a balance; feeds A8-A10 and R5."""
    known = F.when(F.col("balance_after").isNotNull(), F.col("posting_seq"))
    return (bank.filter(F.col("date") <= F.lit(as_of))
            .groupBy("merchant_id", "date")
            .agg(F.max_by("balance_after", known).alias("closing_balance"), F.count(F.lit(1)).alias("postings"),
                 F.sum("amount").alias("net_amount")))


def running_balance(postings: DataFrame, opening: int = OPENING_BALANCE, merchant: str = "merchant_id",
                    identity: Column | None = None, parts: int | None = None) -> DataFrame:
    """The balance after each posting, and its place in the day (posting_seq).

    Postings are ordered by date and, inside a day, by the place they came with
    (posting_seq), or else by transaction_id (``identity``, where that is derived from other columns: it is then
    made after the exchange, and not sent). ``merchant`` names the merchant's key. The
    balance before a span of days is a running sum over the spans' nets, which goes before
    the span's postings as one more row; inside a span, a window adds them up. So a merchant
    with very many rows is split by span, few rows are added, and a task sorts its rows once,
    after one exchange on (merchant, span), into ``parts`` if given. A posting has no balance
    while no posting of its day has had an amount. Postings without a merchant or a date are left out."""
    keyed = postings.where(F.col(merchant).isNotNull() & F.col("date").isNotNull()).withColumn(
        "_span", F.floor(F.unix_date("date") / BALANCE_SPAN_DAYS))
    net = keyed.groupBy(merchant, "_span").agg(F.sum("amount").alias("_net"))
    spans = Window.partitionBy(merchant).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    opened = net.select(merchant, "_span", F.coalesce(F.sum("_net").over(spans), F.lit(0)).alias("_before"))
    placed = POSTING_ORDER in postings.columns
    order = F.col(POSTING_ORDER) if placed else F.col("transaction_id") if identity is None else identity
    rows = keyed.unionByName(opened, allowMissingColumns=True)
    keys = [F.col(merchant), F.col("_span")]
    dealt = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    posting = F.col("_before").isNull()
    span = Window.partitionBy(merchant, "_span")
    by_day, by_posting = span.orderBy("_posting", "date"), span.orderBy("_posting", "date", "_order")
    until = by_posting.rowsBetween(Window.unboundedPreceding, 0)
    known = F.max(F.when(F.col("amount").isNotNull(), F.col("date"))).over(until) == F.col("date")
    balance = F.lit(opening) + F.max("_before").over(until) + F.coalesce(F.sum("amount").over(until), F.lit(0))
    others = [c for c in postings.columns if c not in (merchant, "date", POSTING_ORDER)]
    return (dealt.withColumn("_posting", posting).withColumn("_order", order)
            .withColumn("balance_after", F.when(known, balance).cast("decimal(18,2)"))
            .withColumn("_nth", F.row_number().over(by_posting))
            # the rank comes last, as the rows are in its order by then
            .withColumn(POSTING_ORDER, F.col("_order") if placed else (F.col("_nth") - F.rank().over(by_day) + 1).cast("long"))
            .where(posting).select(merchant, "date", *others, *(c for c in ("balance_after",) if c not in others), POSTING_ORDER))


def monthly_bank_facts(bank: DataFrame, as_of: dt.date) -> DataFrame:
    """R4 + R5 inputs per (merchant, month): credits and the month-end closing balance."""
    daily = daily_closing_balance(bank, as_of)
    credits = (bank.filter((F.col("date") <= F.lit(as_of)) & (F.col("direction") == "CREDIT"))
               .groupBy("merchant_id", F.trunc("date", "MM").alias("month"))
               .agg(F.sum("amount").alias("bank_revenue")))
    month_end = (daily.groupBy("merchant_id", F.trunc("date", "MM").alias("month"))
                 .agg(F.max_by("closing_balance", "date").alias("cash_balance")))
    return credits.join(month_end, ["merchant_id", "month"], "full_outer")


def every_month(known: DataFrame, as_of: dt.date) -> DataFrame:
    """The month grid. ``known`` has rows per (merchant, month); months that a merchant lacks, from its first one to
    that of ``as_of``, come in between with NULLs. Each row makes the months up to the next one, so nothing is joined."""
    following = F.lead("month").over(Window.partitionBy("merchant_id").orderBy("month"))
    until = F.coalesce(F.add_months(following, -1), F.lit(as_of.replace(day=1)))
    months = F.when(until > F.col("month"), F.sequence(F.col("month"), until, F.expr("interval 1 month"))).otherwise(
        F.array("month"))
    grid = known.withColumn("_until", months).select("*", F.explode("_until").alias("_month"))
    return grid.select(*[F.col("_month").alias(c) if c == "month" else F.col(c) if c == "merchant_id"
                         else F.when(F.col("_month") == F.col("month"), F.col(c)).alias(c) for c in known.columns])


def accounting_derived(accounting: DataFrame, bank: DataFrame, as_of: dt.date) -> DataFrame:
    """R4-R7 over every month of a merchant from its first record or posting to ``as_of``: bank revenue (0 without
    credits), month-end cash (0.0 without postings), quarterly VAT due, P&L derivations. A month without an accounting
    record has no revenue of its own, and accrues no VAT; VAT of earlier months still falls due after it."""
    money = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)")).alias(c)
    acc = (accounting.filter(F.col("month") <= F.lit(as_of))
           .select("merchant_id", "month", "gross_revenue", "cogs", "ebitda", "ar_days", "ap_days"))
    known = acc.join(monthly_bank_facts(bank, as_of), ["merchant_id", "month"], "full_outer")
    j = every_month(known, as_of).select(
        "merchant_id", "month", money("gross_revenue"), money("cogs"), money("ebitda"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("ar_days", "ap_days")], "bank_revenue", "cash_balance")
    rev = F.col("gross_revenue")
    accrued = F.round(rev * F.expr(f"CAST({VAT_RATE} AS DECIMAL(3,2))"), 2).cast("decimal(18,2)")
    is_pay = F.month("month").isin(*VAT_PAYMENT_MONTHS)
    # segment = number of payment months strictly before this month
    w_order = Window.partitionBy("merchant_id").orderBy("month")
    seg = F.coalesce(F.sum(is_pay.cast("int")).over(w_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = j.withColumn("btw_accrued", accrued).withColumn("_seg", seg)
    w_seg = Window.partitionBy("merchant_id", "_seg").orderBy("month") \
        .rowsBetween(Window.unboundedPreceding, 0)
    accumulated = F.sum("btw_accrued").over(w_seg)
    bank_rev = F.coalesce(F.col("bank_revenue"), F.lit(0).cast("decimal(18,2)"))
    gross_profit = (rev - F.col("cogs")).cast("decimal(18,2)")
    out = j.select(
        "merchant_id", "month", "gross_revenue", "cogs",
        gross_profit.alias("gross_profit"),
        (gross_profit - F.col("ebitda")).cast("decimal(18,2)").alias("total_opex"),
        # exact decimal arithmetic, HALF_UP at the cent
        F.round(rev * F.col("ar_days").cast("decimal(10,1)") / 30, 2).cast("decimal(18,2)").alias("accounts_receivable"),
        F.round(F.col("cogs") * F.col("ap_days").cast("decimal(10,1)") / 30, 2).cast("decimal(18,2)")
         .alias("accounts_payable"),
        "btw_accrued",
        F.when(is_pay, accumulated).otherwise(F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")
         .alias("btw_due_derived"),
        bank_rev.alias("bank_revenue"),
        F.round(F.coalesce(dbl(F.col("cash_balance")), F.lit(0.0)), 2).alias("cash_balance"),
        F.when(bank_rev > 0, F.round(dbl(rev - bank_rev) / dbl(bank_rev), 4)).otherwise(F.lit(0.0))
         .alias("revenue_bank_delta_derived"),
    )
    return out


def weekly_series(df: DataFrame, date_col: str, value: Column, cond: Column, label: str = "value") -> DataFrame:
    """R9 materialized: zero-filled Mon-Sun weekly series per merchant from the
    first to the last week with rows (only the weekly sums are shuffled; the
    spine is generated per merchant with sequence + explode)."""
    wk = week_start_day(F.col(date_col))
    weekly = (df.filter(cond).groupBy("merchant_id", wk.alias("wk")).agg(F.sum(value).alias(label)))
    bounds = weekly.groupBy("merchant_id").agg(F.min("wk").alias("w0"), F.max("wk").alias("w1"))
    spine = bounds.select("merchant_id", "w0",
                          F.explode(F.sequence(F.col("w0"), F.col("w1"), F.lit(7))).alias("wk"))
    epoch = F.lit(dt.date(1970, 1, 1))
    return (spine.join(weekly, ["merchant_id", "wk"], "left")
            .select("merchant_id", F.date_add(epoch, F.col("wk").cast("int")).alias("week_start"),
                    ((F.col("wk") - F.col("w0")) / 7).cast("int").alias("week_index"),
                    F.coalesce(F.col(label), F.lit(0)).alias(label)))
