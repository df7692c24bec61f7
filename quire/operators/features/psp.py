"""PSP features: settlement delays, refund / chargeback rates, concentration, GPV trend.

Plan (one linear pipeline, one scan of the payments): a multi-grain
aggregate on (merchant, grain, key) with

* the merchant grain: conditional window sums (J7) in one pass,
* (merchant, delay-days) counts -> exact linear-interpolated p95 and median
  from that histogram, whose counts weigh ``percentile`` (bounded by distinct
  delay values, so a hot merchant never ships its raw delays to one task),
* (merchant, psp_name) and (merchant, buyer) paid gross -> HHI (H1),

then one conditional fold per merchant and delay, whose rows are few, and the
percentiles and totals per merchant from those.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expr import (cents, cutoff, cv, dbl, eur, hhi, in_window, sample_std_from_moments,
                                  weekly_slope, weekly_slope_stats)
from quire.functions.grains import GRAIN_KEYS, at, grain, tag_grains
from quire.sources.schemas import is_absent

RATE_WINDOWS = {"30d": 30, "90d": 90, "ltm": 365}
PREFIX = "ps_"


PSP_COLUMNS = ("merchant_id", "order_date", "settlement_date", "status", "psp_name", "buyer_id", "payment_method",
               "dispute_outcome", "gross_amount", "net_amount", "refund_amount")


def _outcome() -> Column:
    return F.when(F.col("dispute_outcome") == "won", 1).when(F.col("dispute_outcome") == "lost", 2).otherwise(0)


def _delay() -> Column:
    return F.datediff(F.col("settlement_date"), F.col("order_date"))


def _history_grains(when: Column | None = None) -> list[Column]:
    """The grains that features over all history fold: h (delay of paid payments), p and b (paid gross by PSP, buyer)."""
    paid = F.col("status") == "paid"
    paid = paid if when is None else paid & when
    return [grain("h", k_int=_delay(), when=paid & _delay().isNotNull()),
            grain("p", k_str=F.col("psp_name"), when=paid & F.col("psp_name").isNotNull()),
            grain("b", k_str=F.col("buyer_id"), when=paid & F.col("buyer_id").isNotNull())]


def _sums() -> list[Column]:
    """A grain has the sums that its fold reads; the others are NULL, which a shuffle packs to almost nothing."""
    of = lambda tags, v: F.sum(F.when(F.col("g").isin(*tags), v))
    return [F.count(F.lit(1)).alias("n"),
            of("tdpb", cents(F.col("gross_amount"))).alias("gross_c"),
            of("t", cents(F.col("net_amount"))).alias("net_c"),
            of("td", cents(F.col("refund_amount"))).alias("refund_c"),
            of("t", _delay()).alias("d1"),
            of("t", _delay() * _delay()).alias("d2")]


def psp_history(psp: DataFrame) -> DataFrame:
    """Partial aggregates of each merchant and month, from which ``psp_stats`` folds what covers all history: t (rows by
    status and dispute outcome), and the grains h, p and b. Months are independent, so they can be kept and merged."""
    x = tag_grains(psp.select(*PSP_COLUMNS, F.trunc("order_date", "MM").alias("month")),
                   grain("t", k_str=F.col("status"), k_int=_outcome()), *_history_grains())
    return x.groupBy("merchant_id", "month", "g", "k_str", "k_int").agg(*_sums())


def psp_stats(psp: DataFrame, as_of: dt.date, history: DataFrame | None = None) -> DataFrame:
    """Per-merchant sufficient statistics for every PSP feature, from ONE scan.

    Grains (narrow: six count/sum slots each):
      t  (status, dispute outcome) -> counts and sums of all history,
      d  (order day, status, card flag, dispute outcome), 365 days -> every windowed rate,
      h  delay-days histogram of paid payments -> exact p95 / median by
         ``percentile`` with the counts as frequencies,
      p / b  paid gross per PSP / per buyer -> HHI.
    Then one conditional fold per merchant and delay, and one per merchant; no window.

    With ``history`` (as ``psp_history`` gives it) the payments are read for the last 365 days only: months before that
    of ``as_of`` come from the history wherever a feature covers all of it."""
    no_method = is_absent(psp, "payment_method")  # then the card share is not produced, rather than zero
    p = psp.filter(F.col("order_date") <= F.lit(as_of))
    od = F.col("order_date")
    since = None if history is None else od >= F.lit(as_of.replace(day=1))
    if history is not None:
        p = p.filter(od >= F.lit(cutoff(as_of, max(RATE_WINDOWS.values()))))
    flags = F.when(F.col("payment_method") == "creditcard", 10).otherwise(0) + _outcome()
    x = tag_grains(p.select(*PSP_COLUMNS), grain("t", k_str=F.col("status"), k_int=_outcome(), when=since),
                   grain("d", k_date=od, k_str=F.col("status"), k_int=flags,
                         when=in_window(od, as_of, max(RATE_WINDOWS.values()))), *_history_grains(since))
    g = x.groupBy("merchant_id", *GRAIN_KEYS).agg(*_sums())
    if history is not None:
        before = history.filter(F.col("month") < F.lit(as_of.replace(day=1)))
        g = g.unionByName(before.withColumn("k_date", F.lit(None).cast("date")).drop("month"))
    kd, st, fl = F.col("k_date"), F.col("k_str"), F.col("k_int")
    is_paid = st == "paid"
    wk = {days: in_window(kd, as_of, days) for days in (30, 90, 180, 365)}
    prior90 = (kd >= F.lit(cutoff(as_of, 180))) & (kd < F.lit(cutoff(as_of, 90)))
    n, gross, refund = F.col("n"), F.col("gross_c"), F.col("refund_c")
    D = lambda v, cond=None: at("d", v, cond)
    T = lambda v, cond=None: F.sum(at("t", v, cond))
    fold: list[Column] = [
        T(n).alias("rows_all"),
        T(n, is_paid).alias("paid_all"),
        T(F.col("d1"), is_paid).alias("delay_s1"),
        T(F.col("d2"), is_paid).alias("delay_s2"),
        T(F.col("net_c"), is_paid).alias("paid_net_c"),
        T(n, (st == "chargeback") & (fl % 10 > 0)).alias("disputes_resolved"),
        T(n, (st == "chargeback") & (fl % 10 == 1)).alias("disputes_won"),
        F.sum(D(n, is_paid & wk[90])).alias("paid_90"),
        F.sum(D(n, wk[90])).alias("rows_90"),
        F.sum(D(n, wk[90] & (fl >= 10))).alias("card_90"),
        F.sum(D(gross, prior90)).alias("gross_prior90"),
        F.sum(D(refund, prior90 & (st == "refunded"))).alias("refund_prior90"),
    ]
    for label, days in RATE_WINDOWS.items():
        fold += [F.sum(D(gross, wk[days])).alias(f"gross_{label}"),
                 F.sum(D(refund, wk[days] & (st == "refunded"))).alias(f"refund_{label}"),
                 F.sum(D(n, wk[days])).alias(f"n_{label}"),
                 F.sum(D(n, wk[days] & (st == "chargeback"))).alias(f"cb_{label}")]
    for k, v in weekly_slope_stats(kd, gross, (F.col("g") == "d") & is_paid & wk[90],
                                   anchor=cutoff(as_of, 90)).items():
        fold.append(v.alias(f"gpv_{k}"))
    for tag, alias in (("p", "plat"), ("b", "buyer")):
        v = dbl(gross)
        fold += [F.sum(at(tag, v * v)).alias(f"{alias}_sq"), F.sum(at(tag, v)).alias(f"{alias}_total")]
    if history is not None:  # a PSP or buyer has a row per month: their shares are of all months together
        keys = ["merchant_id", *GRAIN_KEYS]
        g = g.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in g.columns if c not in keys])
    # sums first, with a row per delay: the percentiles' aggregate takes objects, row by row, and sorts beyond 128 merchants
    folded = g.groupBy("merchant_id", at("h", fl).alias("_delay")).agg(*fold, F.sum(at("h", n)).alias("_delay_n"))
    merged = {"gpv_wmin": F.min, "gpv_wmax": F.max}
    names = [c for c in folded.columns if c not in ("merchant_id", "_delay", "_delay_n")]
    # the delay histogram weighs its own values: exact percentiles without a window over the other grains
    out = folded.groupBy("merchant_id").agg(
        *[merged.get(c, F.sum)(c).alias(c) for c in names],
        *[F.percentile("_delay", prob, F.col("_delay_n")).alias(name) for name, prob in (("delay_p95", 0.95), ("delay_p50", 0.5))])
    out = out.withColumn("paid_net_all", eur(F.col("paid_net_c"))) \
             .withColumn("card_pct_90", F.when((F.col("rows_90") > 0) & F.lit(not no_method),
                                               dbl(F.coalesce(F.col("card_90"), F.lit(0))) / dbl(F.col("rows_90"))))
    return out.select("merchant_id", *[F.col(n).alias(PREFIX + n) for n in out.columns if n != "merchant_id"])


def _refund_rate(gross: Column, refund: Column) -> Column:
    """H4: refunded amount / gross of all statuses; gross 0 gives 0.10."""
    g = dbl(F.coalesce(gross, F.lit(0)))
    return F.when(g == 0, F.lit(0.10)).otherwise(dbl(F.coalesce(refund, F.lit(0))) / g)


def _chargeback_rate(n: Column, cb: Column) -> Column:
    """H5: chargebacks / payments; no payments gives 0.02."""
    nn = F.coalesce(n, F.lit(0))
    return F.when(nn == 0, F.lit(0.02)).otherwise(dbl(F.coalesce(cb, F.lit(0))) / dbl(nn))


def psp_feature_columns(as_of: dt.date) -> dict[str, Column]:
    c = lambda n: F.col(PREFIX + n)
    z = lambda x: F.coalesce(x, F.lit(0))
    f: dict[str, Column] = {}
    has_paid = z(c("paid_all")) > 0
    mean_delay = F.try_divide(dbl(c("delay_s1")), dbl(c("paid_all")))
    std_delay = sample_std_from_moments(c("paid_all"), c("delay_s1"), c("delay_s2"))
    f["settlement_delay_p95"] = F.when(has_paid, c("delay_p95")).otherwise(F.lit(12.0))
    f["settlement_delay_median"] = F.when(has_paid, c("delay_p50")).otherwise(F.lit(5.0))
    f["settlement_delay_std"] = F.when(has_paid, F.coalesce(std_delay, F.lit(0.0))).otherwise(F.lit(5.0))
    f["settlement_timing_variability"] = F.when(
        has_paid, cv(c("paid_all"), mean_delay, std_delay)).otherwise(F.lit(1.0))
    for label in RATE_WINDOWS:
        f[f"refund_rate_{label}"] = _refund_rate(c(f"gross_{label}"), c(f"refund_{label}"))
        f[f"chargeback_rate_{label}"] = _chargeback_rate(c(f"n_{label}"), c(f"cb_{label}"))
    f["refund_trend_3m"] = f["refund_rate_90d"] - _refund_rate(c("gross_prior90"), c("refund_prior90"))
    f["platform_concentration"] = F.when(has_paid, hhi(c("plat_sq"), c("plat_total"))).otherwise(F.lit(1.0))
    f["gpv_trend_90d"] = F.when(z(c("paid_90")) >= 10, weekly_slope(PREFIX + "gpv")).otherwise(F.lit(0.0))
    f["payment_method_card_pct"] = F.coalesce(c("card_pct_90"), F.lit(0.25))
    f["dispute_win_rate"] = F.when(z(c("disputes_resolved")) > 0,
                                   dbl(c("disputes_won")) / dbl(c("disputes_resolved"))).otherwise(F.lit(0.50))
    f["buyer_concentration_hhi"] = F.when(has_paid, hhi(c("buyer_sq"), c("buyer_total"))).otherwise(F.lit(1.0))
    return f
