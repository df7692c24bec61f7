"""DuckDB oracle for the feature table.

Written independently of the Spark plan: raw-row aggregates with FILTER,
``quantile_cont`` for percentiles, ``stddev_samp`` on values, and explicit
zero-filled week spines with ``regr_slope`` for the weekly trends.
"""

from __future__ import annotations

import datetime as dt

from quire.operators.features.assemble import FAMILY_FEATURES
from quire.operators.features.registry import BOOL_FEATURES, DEFAULTS, FEATURE_COLUMNS, INT_FEATURES

AS_OF = dt.date(2001, 8, 1)


def _d(as_of: dt.date, days: int = 0) -> str:
    return f"DATE '{(as_of - dt.timedelta(days=days)).isoformat()}'"


def _month_ends(start: dt.date, end: dt.date) -> int:
    # same rule as the Spark side, restated: month-end dates inside [start, end]
    n = 0
    d = start
    while d <= end:
        nxt = d + dt.timedelta(days=1)
        if nxt.month != d.month:
            n += 1
        d = nxt
    return max(n, 1)


def _weekly_spine(name: str, src: str, y: str) -> dict[str, str]:
    """Zero-filled weekly series (Mon-Sun) from the first to the last week with rows,
    slope over x = 0..n-1 via regr_slope."""
    return {
        f"{name}_w": f"SELECT merchant_id, CAST(date_trunc('week', order_date) AS DATE) AS wk, "
                     f"CAST(sum({y}) AS DOUBLE) AS y FROM {src} GROUP BY 1, 2",
        f"{name}_b": f"SELECT merchant_id, min(wk) AS w0, max(wk) AS w1 FROM {name}_w GROUP BY 1",
        f"{name}_s": f"SELECT merchant_id, w0, unnest(generate_series(0, CAST(datediff('day', w0, w1) / 7 AS BIGINT))) AS x "
                     f"FROM {name}_b",
        f"{name}": f"SELECT s.merchant_id, count(*) AS n, regr_slope(coalesce(w.y, 0.0), CAST(s.x AS DOUBLE)) AS slope, "
                   f"avg(coalesce(w.y, 0.0)) AS mean FROM {name}_s s LEFT JOIN {name}_w w "
                   f"ON w.merchant_id = s.merchant_id AND w.wk = s.w0 + CAST(s.x * 7 AS INTEGER) GROUP BY 1",
    }


def _slope_norm(n: str, slope: str, mean: str) -> str:
    return (f"CASE WHEN coalesce({n}, 0) < 3 THEN 0.0 WHEN {mean} = 0 THEN 0.0 "
            f"ELSE coalesce({slope} / abs({mean}), 0.0) END")


def _cv(n: str, mean: str, std: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) < 2 THEN 1.0 WHEN {mean} = 0 THEN 1.0 ELSE {std} / abs({mean}) END"


def _hhi(sq: str, tot: str) -> str:
    return f"CASE WHEN coalesce({tot}, 0) = 0 THEN 1.0 ELSE {sq} / ({tot} * {tot}) END"


def feature_ctes_prefixed(as_of: dt.date, prefix: str) -> dict[str, str]:
    """The feature CTEs for another as-of date, every CTE name prefixed."""
    import re
    base = feature_ctes(as_of)
    names = sorted(base, key=len, reverse=True)
    pat = re.compile(r"\b(" + "|".join(re.escape(n) for n in names) + r")\b")
    return {prefix + n: pat.sub(lambda m: prefix + m.group(1), body) for n, body in base.items()}


def feature_ctes(as_of: dt.date = AS_OF) -> dict[str, str]:
    A, D30, D90, D180, D365 = _d(as_of), _d(as_of, 30), _d(as_of, 90), _d(as_of, 180), _d(as_of, 365)
    n_me = _month_ends(as_of - dt.timedelta(days=180), as_of)
    c: dict[str, str] = {}
    c["sp"] = ("SELECT a.application_id, a.merchant_id, a.requested_amount, a.requested_tenor_months, "
               "m.incorporation_date, m.kvk_active, m.sanctions_hit FROM v_applications a JOIN "
               "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY company_name, kvk_number) "
               "AS rn FROM v_merchants) WHERE rn = 1) m ON a.merchant_id = m.merchant_id")
    # ------------------------------------------------------------- bank
    c["bk"] = f"SELECT * FROM v_bank WHERE date <= {A}"
    c["bk_row"] = f"""SELECT merchant_id, count(*) AS rows_all,
  sum(amount) FILTER (WHERE category = 'psp_settlement') AS psp_settle,
  count(*) FILTER (WHERE date >= {D90}) AS rows90, CAST(sum(amount) FILTER (WHERE date >= {D90}) AS DOUBLE) AS net90,
  datediff('month', min(date) FILTER (WHERE date >= {D90}), max(date) FILTER (WHERE date >= {D90})) + 1 AS m90,
  count(*) FILTER (WHERE date >= {D180}) AS rows180, CAST(sum(amount) FILTER (WHERE date >= {D180}) AS DOUBLE) AS net180,
  datediff('month', min(date) FILTER (WHERE date >= {D180}), max(date) FILTER (WHERE date >= {D180})) + 1 AS m180,
  CAST(coalesce(sum(abs(amount)) FILTER (WHERE direction = 'DEBIT' AND date >= {D90}), 0) AS DOUBLE) AS debit90,
  CAST(coalesce(sum(abs(amount)) FILTER (WHERE category = 'advertising' AND date >= {D90}), 0) AS DOUBLE) AS ad90,
  CAST(coalesce(sum(amount) FILTER (WHERE direction = 'CREDIT' AND date >= {D90}), 0) AS DOUBLE) AS credit90,
  count(*) FILTER (WHERE category = 'supplier_payment' AND date >= {D180}) AS sup_n,
  count(DISTINCT date_trunc('month', date)) FILTER (WHERE category = 'supplier_payment' AND date >= {D180}) AS sup_months,
  stddev_samp(abs(CAST(amount AS DOUBLE))) FILTER (WHERE category = 'supplier_payment' AND date >= {D180}) AS sup_std,
  avg(abs(CAST(amount AS DOUBLE))) FILTER (WHERE category = 'supplier_payment' AND date >= {D180}) AS sup_mean
FROM bk GROUP BY merchant_id"""
    c["bk_day"] = """SELECT merchant_id, date, sum(amount) FILTER (WHERE direction = 'CREDIT') AS credit,
  count(*) FILTER (WHERE direction = 'CREDIT') AS n_credit, arg_max(balance_after, posting_seq) AS bal FROM bk GROUP BY merchant_id, date"""
    vol = []
    for lab, dd in (("30", D30), ("90", D90), ("180", D180)):
        vol.append(f"count(*) FILTER (WHERE date >= {dd}) AS n{lab}, "
                   f"avg(CAST(credit AS DOUBLE)) FILTER (WHERE date >= {dd}) AS m{lab}, "
                   f"stddev_samp(CAST(credit AS DOUBLE)) FILTER (WHERE date >= {dd}) AS s{lab}")
    c["bk_vol"] = f"SELECT merchant_id, {', '.join(vol)} FROM bk_day WHERE n_credit > 0 GROUP BY merchant_id"
    c["bk_bal"] = f"""SELECT merchant_id,
  avg(CASE WHEN bal < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE date >= {D90}) AS neg90,
  avg(CAST(bal AS DOUBLE)) FILTER (WHERE date >= {D90}) AS avgbal90,
  avg(CASE WHEN bal < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE date >= {D180}) AS neg180
FROM bk_day GROUP BY merchant_id"""
    c["bk_mon"] = (f"SELECT merchant_id, date_trunc('month', date) AS mon, CAST(sum(amount) AS DOUBLE) AS rev FROM bk "
                   f"WHERE direction = 'CREDIT' AND date >= {D365} GROUP BY 1, 2")
    c["bk_seas"] = ("SELECT merchant_id, count(*) AS nm, max(rev) AS mx, avg(rev) AS mean, "
                    "avg(rev) FILTER (WHERE rn <= 6) AS last6 FROM (SELECT *, row_number() OVER "
                    "(PARTITION BY merchant_id ORDER BY mon DESC) AS rn FROM bk_mon) GROUP BY merchant_id")
    c["bk_cp"] = (f"SELECT merchant_id, sum(v * v) AS sq, sum(v) AS tot FROM (SELECT merchant_id, counterparty_name, "
                  f"CAST(sum(amount) AS DOUBLE) AS v FROM bk WHERE direction = 'CREDIT' AND date >= {D90} "
                  f"AND counterparty_name IS NOT NULL GROUP BY 1, 2) GROUP BY merchant_id")
    c["bank_f0"] = f"""SELECT m.merchant_id,
  CASE WHEN coalesce(r.rows90, 0) > 0 THEN r.net90 / r.m90 END AS monthly_net_cashflow_avg_3m,
  CASE WHEN coalesce(r.rows180, 0) > 0 THEN r.net180 / r.m180 END AS monthly_net_cashflow_avg_6m,
  CASE WHEN coalesce(v.n30, 0) >= 10 THEN {_cv('v.n30', 'v.m30', 'v.s30')} ELSE 0.50 END AS revenue_volatility_30d,
  CASE WHEN coalesce(v.n90, 0) >= 30 THEN {_cv('v.n90', 'v.m90', 'v.s90')} ELSE 0.50 END AS revenue_volatility_90d,
  CASE WHEN coalesce(v.n180, 0) >= 60 THEN {_cv('v.n180', 'v.m180', 'v.s180')} ELSE 0.50 END AS revenue_volatility_180d,
  CASE WHEN coalesce(r.rows90, 0) > 0 THEN b.neg90 ELSE 1.0 END AS negative_balance_pct_90d,
  CASE WHEN coalesce(r.rows90, 0) > 0 AND r.debit90 / 90 > 0 THEN b.avgbal90 / (r.debit90 / 90) ELSE 0.0 END AS days_cash_on_hand,
  CASE WHEN coalesce(r.rows180, 0) > 0 THEN b.neg180 ELSE 1.0 END AS overdraft_dependency,
  {_hhi('cp.sq', 'cp.tot')} AS inflow_concentration_hhi,
  CASE WHEN coalesce(r.sup_n, 0) >= 3 THEN CAST(r.sup_months AS DOUBLE) / {n_me} ELSE 0.50 END AS supplier_pay_punctuality,
  CASE WHEN coalesce(r.sup_n, 0) >= 3 THEN {_cv('r.sup_n', 'r.sup_mean', 'r.sup_std')} ELSE 1.0 END AS supplier_payout_lumpiness,
  CASE WHEN coalesce(s.nm, 0) >= 6 AND s.mean <> 0 THEN s.mx / s.mean WHEN coalesce(s.nm, 0) >= 6 THEN NULL ELSE 2.0 END AS seasonality_index,
  CASE WHEN coalesce(r.credit90, 0) > 0 THEN r.ad90 / r.credit90 ELSE 0.35 END AS ad_spend_ratio_3m,
  CASE WHEN coalesce(s.nm, 0) >= 1 THEN s.last6 ELSE 0.0 END AS monthly_gmv_avg_6m,
  r.rows_all AS bank_rows, r.psp_settle AS bank_psp_settle
FROM (SELECT DISTINCT merchant_id FROM sp) m LEFT JOIN bk_row r ON r.merchant_id = m.merchant_id
  LEFT JOIN bk_vol v ON v.merchant_id = m.merchant_id LEFT JOIN bk_bal b ON b.merchant_id = m.merchant_id
  LEFT JOIN bk_seas s ON s.merchant_id = m.merchant_id LEFT JOIN bk_cp cp ON cp.merchant_id = m.merchant_id"""
    c["bank_f"] = """SELECT *,
  CASE WHEN monthly_net_cashflow_avg_3m IS NOT NULL AND monthly_net_cashflow_avg_6m IS NOT NULL
       AND monthly_net_cashflow_avg_6m <> 0
       THEN (monthly_net_cashflow_avg_3m - monthly_net_cashflow_avg_6m) / abs(monthly_net_cashflow_avg_6m)
       ELSE 0.0 END AS cashflow_trend_delta,
  revenue_volatility_30d - revenue_volatility_90d AS revenue_volatility_delta
FROM bank_f0"""
    # ------------------------------------------------------------- psp
    c["ps"] = f"SELECT *, datediff('day', order_date, settlement_date) AS delay FROM v_psp WHERE order_date <= {A}"
    win = []
    for lab, dd in (("30d", D30), ("90d", D90), ("ltm", D365)):
        win.append(f"CAST(coalesce(sum(gross_amount) FILTER (WHERE order_date >= {dd}), 0) AS DOUBLE) AS g_{lab}, "
                   f"CAST(coalesce(sum(refund_amount) FILTER (WHERE order_date >= {dd} AND status = 'refunded'), 0) AS DOUBLE) AS r_{lab}, "
                   f"count(*) FILTER (WHERE order_date >= {dd}) AS n_{lab}, "
                   f"count(*) FILTER (WHERE order_date >= {dd} AND status = 'chargeback') AS cb_{lab}")
    c["ps_row"] = f"""SELECT merchant_id, count(*) AS rows_all, count(*) FILTER (WHERE status = 'paid') AS paid_all,
  sum(net_amount) FILTER (WHERE status = 'paid') AS paid_net,
  quantile_cont(delay, 0.95) FILTER (WHERE status = 'paid') AS p95,
  quantile_cont(delay, 0.5) FILTER (WHERE status = 'paid') AS p50,
  stddev_samp(CAST(delay AS DOUBLE)) FILTER (WHERE status = 'paid') AS dstd,
  avg(CAST(delay AS DOUBLE)) FILTER (WHERE status = 'paid') AS dmean,
  {', '.join(win)},
  CAST(coalesce(sum(gross_amount) FILTER (WHERE order_date >= {D180} AND order_date < {D90}), 0) AS DOUBLE) AS g_prior,
  CAST(coalesce(sum(refund_amount) FILTER (WHERE order_date >= {D180} AND order_date < {D90} AND status = 'refunded'), 0) AS DOUBLE) AS r_prior,
  count(*) FILTER (WHERE status = 'paid' AND order_date >= {D90}) AS paid90,
  avg(CASE WHEN payment_method = 'creditcard' THEN 1.0 ELSE 0.0 END) FILTER (WHERE order_date >= {D90}) AS card,
  count(*) FILTER (WHERE status = 'chargeback' AND dispute_outcome IN ('won', 'lost')) AS dres,
  count(*) FILTER (WHERE status = 'chargeback' AND dispute_outcome = 'won') AS dwon
FROM ps GROUP BY merchant_id"""
    for key, name in (("psp_name", "ps_plat"), ("buyer_id", "ps_buyer")):
        c[name] = (f"SELECT merchant_id, sum(v * v) AS sq, sum(v) AS tot FROM (SELECT merchant_id, {key}, "
                   f"CAST(sum(gross_amount) AS DOUBLE) AS v FROM ps WHERE status = 'paid' AND {key} IS NOT NULL "
                   f"GROUP BY 1, 2) GROUP BY merchant_id")
    c["ps90paid"] = f"SELECT * FROM ps WHERE status = 'paid' AND order_date >= {D90}"
    c.update(_weekly_spine("ps_gpv", "ps90paid", "gross_amount"))

    def rr(g: str, r: str) -> str:
        return f"CASE WHEN {g} = 0 THEN 0.10 ELSE {r} / {g} END"

    def cbr(n: str, cb: str) -> str:
        return f"CASE WHEN coalesce({n}, 0) = 0 THEN 0.02 ELSE CAST({cb} AS DOUBLE) / {n} END"

    c["psp_f"] = f"""SELECT m.merchant_id,
  CASE WHEN coalesce(r.paid_all, 0) > 0 THEN r.p95 ELSE 12.0 END AS settlement_delay_p95,
  CASE WHEN coalesce(r.paid_all, 0) > 0 THEN r.p50 ELSE 5.0 END AS settlement_delay_median,
  CASE WHEN coalesce(r.paid_all, 0) > 1 THEN r.dstd WHEN coalesce(r.paid_all, 0) = 1 THEN 0.0 ELSE 5.0 END AS settlement_delay_std,
  CASE WHEN coalesce(r.paid_all, 0) > 0 THEN {_cv('r.paid_all', 'r.dmean', 'r.dstd')} ELSE 1.0 END AS settlement_timing_variability,
  {rr('coalesce(r.g_30d, 0)', 'r.r_30d')} AS refund_rate_30d,
  {rr('coalesce(r.g_90d, 0)', 'r.r_90d')} AS refund_rate_90d,
  {rr('coalesce(r.g_ltm, 0)', 'r.r_ltm')} AS refund_rate_ltm,
  {cbr('r.n_30d', 'r.cb_30d')} AS chargeback_rate_30d,
  {cbr('r.n_90d', 'r.cb_90d')} AS chargeback_rate_90d,
  {cbr('r.n_ltm', 'r.cb_ltm')} AS chargeback_rate_ltm,
  {rr('coalesce(r.g_90d, 0)', 'r.r_90d')} - {rr('coalesce(r.g_prior, 0)', 'r.r_prior')} AS refund_trend_3m,
  CASE WHEN coalesce(r.paid_all, 0) > 0 THEN {_hhi('pl.sq', 'pl.tot')} ELSE 1.0 END AS platform_concentration,
  CASE WHEN coalesce(r.paid90, 0) >= 10 THEN {_slope_norm('g.n', 'g.slope', 'g.mean')} ELSE 0.0 END AS gpv_trend_90d,
  CASE WHEN coalesce(r.n_90d, 0) > 0 THEN r.card ELSE 0.25 END AS payment_method_card_pct,
  CASE WHEN coalesce(r.dres, 0) > 0 THEN CAST(r.dwon AS DOUBLE) / r.dres ELSE 0.50 END AS dispute_win_rate,
  CASE WHEN coalesce(r.paid_all, 0) > 0 THEN {_hhi('bu.sq', 'bu.tot')} ELSE 1.0 END AS buyer_concentration_hhi,
  r.rows_all AS psp_rows, r.paid_all AS psp_paid, r.paid_net AS psp_paid_net
FROM (SELECT DISTINCT merchant_id FROM sp) m LEFT JOIN ps_row r ON r.merchant_id = m.merchant_id
  LEFT JOIN ps_plat pl ON pl.merchant_id = m.merchant_id LEFT JOIN ps_buyer bu ON bu.merchant_id = m.merchant_id
  LEFT JOIN ps_gpv g ON g.merchant_id = m.merchant_id"""
    # ------------------------------------------------------------- webshop
    c["ws"] = f"SELECT * FROM v_webshop WHERE order_date <= {A}"
    c["ws90"] = f"SELECT * FROM ws WHERE order_date >= {D90}"
    c["ws_row"] = "SELECT merchant_id, count(*) AS rows_all FROM ws GROUP BY merchant_id"
    c["ws_a"] = """SELECT merchant_id, count(*) AS n,
  avg(CASE WHEN status = 'cancelled' THEN 1.0 ELSE 0.0 END) AS canc,
  avg(CASE WHEN status = 'returned' THEN 1.0 ELSE 0.0 END) AS ret,
  count(*) FILTER (WHERE status = 'completed') AS cn,
  avg(CASE WHEN fulfillment_days <= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE status = 'completed') AS fast,
  avg(CAST(is_repeat_customer AS DOUBLE)) AS rep,
  stddev_samp(CAST(gross_amount AS DOUBLE)) FILTER (WHERE status = 'completed') AS gstd,
  avg(CAST(gross_amount AS DOUBLE)) FILTER (WHERE status = 'completed') AS gmean,
  CAST(sum(gross_amount) FILTER (WHERE status = 'completed') AS DOUBLE) AS rev,
  CAST(sum(discount_amount) FILTER (WHERE status = 'completed') AS DOUBLE) AS disc
FROM ws90 GROUP BY merchant_id"""
    c["ws_sku"] = ("SELECT merchant_id, sum(v * v) AS sq, sum(v) AS tot FROM (SELECT merchant_id, sku_id, "
                   "CAST(sum(gross_amount) AS DOUBLE) AS v FROM ws90 WHERE status = 'completed' AND sku_id IS NOT NULL "
                   "GROUP BY 1, 2) GROUP BY merchant_id")
    c.update(_weekly_spine("ws_vol", "ws90", "1"))
    c["webshop_f"] = f"""SELECT a.merchant_id,
  a.canc AS cancellation_rate_90d, a.ret AS return_rate_90d,
  {_slope_norm('v.n', 'v.slope', 'v.mean')} AS order_volume_trend_90d,
  CASE WHEN a.cn > 0 THEN a.fast ELSE 0.0 END AS fulfillment_timeliness_pct,
  a.rep AS repeat_customer_rate_90d,
  CASE WHEN a.cn > 1 THEN {_cv('a.cn', 'a.gmean', 'a.gstd')} ELSE 0.50 END AS aov_stability_cv,
  CASE WHEN a.cn > 0 THEN {_hhi('k.sq', 'k.tot')} ELSE 1.0 END AS sku_concentration_hhi,
  CASE WHEN coalesce(a.rev, 0) > 0 THEN a.disc / a.rev ELSE 0.20 END AS discount_intensity_90d
FROM ws_a a LEFT JOIN ws_sku k ON k.merchant_id = a.merchant_id LEFT JOIN ws_vol v ON v.merchant_id = a.merchant_id
WHERE a.n >= 10"""
    # ------------------------------------------------------------- marketplace
    c["mp"] = f"SELECT * FROM v_marketplace WHERE month <= {A}"
    c["mp6"] = (f"SELECT *, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY month, marketplace) - 1 AS DOUBLE) AS idx "
                f"FROM mp WHERE month >= {D180}")
    c["mp_a"] = """SELECT merchant_id, count(*) AS n, avg(account_health_score) AS h,
  regr_slope(account_health_score, idx) AS hs, count(account_health_score) AS hn,
  sum(order_count) AS ord, sum(late_shipment_count) AS late, sum(negative_feedback_count) AS neg,
  sum(policy_violation_count) AS viol, avg(marketplace_gmv_share) AS share, avg(payout_lag_days) AS lag
FROM mp6 GROUP BY merchant_id"""
    c["mp_h"] = f"SELECT merchant_id, bool_or(payout_hold_active) AS hold FROM mp WHERE month >= {D90} GROUP BY merchant_id"
    c["mp_row"] = "SELECT merchant_id, count(*) AS rows_all FROM mp GROUP BY merchant_id"
    c["marketplace_f"] = f"""SELECT a.merchant_id,
  a.h AS marketplace_account_health_avg,
  {_slope_norm('a.hn', 'a.hs', 'a.h')} AS marketplace_account_health_trend,
  CASE WHEN hh.merchant_id IS NULL THEN true ELSE coalesce(hh.hold, false) END AS marketplace_payout_hold_flag,
  CASE WHEN a.ord > 0 THEN CAST(a.late AS DOUBLE) / a.ord ELSE 0.20 END AS marketplace_late_shipment_rate,
  CASE WHEN a.ord > 0 THEN CAST(a.neg AS DOUBLE) / a.ord ELSE 0.10 END AS marketplace_negative_feedback_rate,
  CAST(a.viol AS INTEGER) AS marketplace_policy_violations_6m,
  a.share AS marketplace_gmv_share, a.lag AS marketplace_payout_lag_avg
FROM mp_a a LEFT JOIN mp_h hh ON hh.merchant_id = a.merchant_id"""
    # ------------------------------------------------------------- accounting
    c["ac"] = f"SELECT * FROM v_accounting WHERE month <= {A}"
    c["ac6"] = (f"SELECT *, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY month) - 1 AS DOUBLE) AS idx "
                f"FROM ac WHERE month >= {D180}")
    c["ac_a"] = """SELECT merchant_id, count(*) AS n, CAST(sum(gross_margin) AS DOUBLE) / count(gross_margin) AS gm,
  regr_slope(CAST(gross_margin AS DOUBLE), idx) AS gs, count(gross_margin) AS gn,
  CAST(sum(gross_revenue) AS DOUBLE) AS rev, CAST(sum(ebitda) AS DOUBLE) AS ebitda, CAST(sum(owner_draws) AS DOUBLE) AS draws,
  count(*) FILTER (WHERE btw_due > 0) AS due_n, avg(CAST(btw_paid_on_time AS DOUBLE)) FILTER (WHERE btw_due > 0) AS vat,
  avg(ap_days) AS ap, avg(ar_days) AS ar, avg(revenue_bank_delta) AS rbd
FROM ac6 GROUP BY merchant_id"""
    c["ac_row"] = "SELECT merchant_id, count(*) AS rows_all FROM ac GROUP BY merchant_id"
    c["accounting_f"] = f"""SELECT merchant_id,
  gm AS gross_margin_avg_6m, {_slope_norm('gn', 'gs', 'gm')} AS gross_margin_trend,
  CASE WHEN rev > 0 THEN ebitda / rev ELSE 0.0 END AS ebitda_margin_avg,
  CASE WHEN due_n > 0 THEN vat ELSE 1.0 END AS vat_punctuality,
  ap AS ap_days_avg, ar AS ar_days_avg, rbd AS revenue_bank_delta_avg,
  CASE WHEN rev > 0 THEN draws / rev ELSE 0.0 END AS owner_draw_ratio_6m
FROM ac_a"""
    # ------------------------------------------------------------- kyc
    c["kyc_f"] = f"""SELECT merchant_id, ubo_director_match, ubo_verified, identity_changes_12m,
  CAST(datediff('day', last_kyc_date, {A}) AS DOUBLE) AS kyc_days_since_last,
  CASE verification_level WHEN 'basic' THEN 0.33 WHEN 'enhanced' THEN 0.67 WHEN 'full' THEN 1.0 ELSE 0.33 END
    AS kyc_verification_level_score
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY last_kyc_date DESC NULLS LAST, kvk_number ASC NULLS LAST) AS rn
      FROM v_kyc) WHERE rn = 1"""
    # ------------------------------------------------------------- assembly
    c["feat_raw"] = f"""SELECT sp.application_id, sp.merchant_id, sp.kvk_active, sp.sanctions_hit,
  CAST(sp.requested_amount AS DOUBLE) AS requested_amount, CAST(sp.requested_tenor_months AS DOUBLE) AS requested_tenor_months,
  {', '.join('b.' + n for n in FAMILY_FEATURES['bank'])},
  {', '.join('p.' + n for n in FAMILY_FEATURES['psp'])},
  {', '.join('w.' + n for n in FAMILY_FEATURES['webshop'])},
  {', '.join('mk.' + n for n in FAMILY_FEATURES['marketplace'])},
  {', '.join('ac.' + n for n in FAMILY_FEATURES['accounting'])},
  {', '.join('ky.' + n for n in FAMILY_FEATURES['kyc'])},
  CASE WHEN sp.requested_tenor_months <> 0 AND CAST(sp.requested_amount AS DOUBLE) / sp.requested_tenor_months > 0
       THEN b.monthly_net_cashflow_avg_6m / (CAST(sp.requested_amount AS DOUBLE) / sp.requested_tenor_months)
       ELSE 0.0 END AS net_cashflow_coverage,
  CASE WHEN coalesce(p.psp_paid_net, 0) > 0
       THEN abs(CAST(coalesce(b.bank_psp_settle, 0) AS DOUBLE) - CAST(p.psp_paid_net AS DOUBLE)) / CAST(p.psp_paid_net AS DOUBLE)
       ELSE 1.0 END AS bank_psp_recon_delta,
  ((CASE WHEN coalesce(b.bank_rows, 0) >= 30 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(p.psp_rows, 0) >= 30 THEN 1 ELSE 0 END)
   + (CASE WHEN coalesce(b.bank_rows, 0) >= 180 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(p.psp_paid, 0) >= 10 THEN 1 ELSE 0 END)
   + (CASE WHEN coalesce(wr.rows_all, 0) >= 10 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(mr.rows_all, 0) > 0 THEN 1 ELSE 0 END)
   + (CASE WHEN coalesce(ar.rows_all, 0) > 0 THEN 1 ELSE 0 END) + (CASE WHEN ky.merchant_id IS NOT NULL THEN 1 ELSE 0 END)) / 8.0
    AS data_coverage_score,
  CAST(datediff('day', sp.incorporation_date, {A}) AS DOUBLE) / 30.44 AS trading_months
FROM sp LEFT JOIN bank_f b ON b.merchant_id = sp.merchant_id LEFT JOIN psp_f p ON p.merchant_id = sp.merchant_id
  LEFT JOIN webshop_f w ON w.merchant_id = sp.merchant_id LEFT JOIN marketplace_f mk ON mk.merchant_id = sp.merchant_id
  LEFT JOIN accounting_f ac ON ac.merchant_id = sp.merchant_id LEFT JOIN kyc_f ky ON ky.merchant_id = sp.merchant_id
  LEFT JOIN ws_row wr ON wr.merchant_id = sp.merchant_id LEFT JOIN mp_row mr ON mr.merchant_id = sp.merchant_id
  LEFT JOIN ac_row ar ON ar.merchant_id = sp.merchant_id"""
    c["feat"] = "SELECT application_id, merchant_id, " + ", ".join(
        f"{_default_expr(n)} AS {n}" for n in FEATURE_COLUMNS) + \
        ", coalesce(kvk_active, false) AS kvk_active, coalesce(sanctions_hit, false) AS sanctions_hit, " \
        "requested_amount, requested_tenor_months FROM feat_raw"
    return c


def _default_expr(n: str) -> str:
    d = DEFAULTS[n]
    if n in BOOL_FEATURES:
        return f"coalesce({n}, {'true' if d else 'false'})"
    if n in INT_FEATURES:
        return f"CAST(coalesce({n}, {d}) AS INTEGER)"
    return f"coalesce(CAST({n} AS DOUBLE), {float(d)!r})"


def rounded_select(table: str, columns: list[str], double_cols: set[str], digits: int = 6) -> str:
    parts = [f"round({c}, {digits}) AS {c}" if c in double_cols else c for c in columns]
    return f"SELECT {', '.join(parts)} FROM {table}"
