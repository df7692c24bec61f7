"""DuckDB oracles for validation, reconciliation and time-indexed derivations."""

from __future__ import annotations

import datetime as dt

from quire.sources.schemas import (ACCOUNTING_MIN_MONTHS, ENUM_DOMAINS, MARGIN_OUT_OF_RANGE_MAX, MIN_HISTORY_DAYS,
                                   NULL_CHECK_COLUMNS, NULL_RATE_MAX)

VIEW_OF = {"bank": "v_bank", "psp": "v_psp", "webshop": "v_webshop", "marketplace": "v_marketplace",
           "accounting": "v_accounting", "kyc": "v_kyc"}


def quality_sql(view_columns: dict[str, list[str]]) -> str:
    parts = []

    def row(src, check, subject, value, thr, cmp):
        op = {"le": "<=", "eq": "=", "ge": ">="}[cmp]
        parts.append(f"SELECT '{src}' AS source, '{check}' AS \"check\", '{subject}' AS subject, "
                     f"CAST(v AS DOUBLE) AS value, CAST({thr} AS DOUBLE) AS threshold, "
                     f"coalesce(CAST(v AS DOUBLE) {op} {thr}, false) AS passed FROM (SELECT {value} AS v FROM {VIEW_OF[src]})")

    for src, view in VIEW_OF.items():
        cols = set(view_columns[src])
        for c in NULL_CHECK_COLUMNS.get(src, []):
            if c in cols:
                row(src, "null_rate", c, f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", NULL_RATE_MAX, "le")
        if src in ENUM_DOMAINS and ENUM_DOMAINS[src][0] in cols:
            c, allowed = ENUM_DOMAINS[src]
            lst = ", ".join(f"'{a}'" for a in allowed)
            row(src, "enum_domain", c, f"count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({lst}))", 0.0, "eq")
        if src in MIN_HISTORY_DAYS and MIN_HISTORY_DAYS[src][0] in cols:
            c, days = MIN_HISTORY_DAYS[src]
            row(src, "history_days", c, f"datediff('day', min({c}), max({c}))", float(days), "ge")
        if src == "accounting":
            row(src, "range", "gross_margin",
                "avg(CASE WHEN gross_margin < 0 OR gross_margin > 1 THEN 1.0 ELSE 0.0 END)", MARGIN_OUT_OF_RANGE_MAX, "le")
            row(src, "distinct_months", "month", "count(DISTINCT month)", float(ACCOUNTING_MIN_MONTHS), "ge")
        if src == "marketplace":
            row(src, "range", "account_health_score",
                "avg(CASE WHEN account_health_score < 1 OR account_health_score > 10 THEN 1.0 ELSE 0.0 END)", 0.0, "le")
        if src == "kyc":
            row(src, "non_empty", "rows", "count(*)", 1.0, "ge")
    return "SELECT source, \"check\", subject, round(value, 6) AS value, threshold, passed FROM (" + \
        " UNION ALL ".join(parts) + ")"


def recon_sql(as_of: dt.date) -> str:
    a = f"DATE '{as_of.isoformat()}'"
    return f"""SELECT merchant_id, round(CAST(bt AS DOUBLE), 2) AS bank_psp_credits, round(CAST(pt AS DOUBLE), 2) AS psp_net_settled,
  round(d, 4) AS recon_delta, d <= 0.2 AS recon_pass, CASE WHEN d > 0.2 THEN 'RECON_FAIL' END AS flag
FROM (SELECT m.merchant_id, coalesce(b.t, 0) AS bt, coalesce(p.t, 0) AS pt,
        CASE WHEN coalesce(p.t, 0) = 0 THEN 1.0 ELSE CAST(abs(coalesce(b.t, 0) - p.t) AS DOUBLE) / CAST(p.t AS DOUBLE) END AS d
      FROM (SELECT DISTINCT merchant_id FROM v_merchants) m
      LEFT JOIN (SELECT merchant_id, sum(amount) AS t FROM v_bank WHERE category = 'psp_settlement' AND date <= {a} GROUP BY 1) b
        ON b.merchant_id = m.merchant_id
      LEFT JOIN (SELECT merchant_id, sum(net_amount) AS t FROM v_psp WHERE status = 'paid' AND order_date <= {a} GROUP BY 1) p
        ON p.merchant_id = m.merchant_id)"""


def _half_up_cents(num: str, den: str) -> str:
    """Integer HALF_UP (away from zero) of num/den, both integers."""
    return (f"(CASE WHEN ({num}) >= 0 THEN ((2 * ({num}) + ({den})) // (2 * ({den}))) "
            f"ELSE -((2 * (-({num})) + ({den})) // (2 * ({den}))) END)")


def accounting_derived_sql(as_of: dt.date) -> str:
    a = f"DATE '{as_of.isoformat()}'"
    rev_c = "CAST(round(gross_revenue * 100) AS BIGINT)"
    cogs_c = "CAST(round(cogs * 100) AS BIGINT)"
    ar_t = "CAST(round(ar_days * 10) AS BIGINT)"
    ap_t = "CAST(round(ap_days * 10) AS BIGINT)"
    return f"""SELECT merchant_id, month, gross_revenue, cogs, gross_revenue - cogs AS gross_profit,
  gross_revenue - cogs - ebitda AS total_opex,
  CAST({_half_up_cents(f'{rev_c} * {ar_t}', '300')} AS DOUBLE) / 100 AS accounts_receivable,
  CAST({_half_up_cents(f'{cogs_c} * {ap_t}', '300')} AS DOUBLE) / 100 AS accounts_payable,
  btw_accrued,
  CASE WHEN month(month) IN (1, 4, 7, 10) THEN sum(btw_accrued) OVER (PARTITION BY merchant_id, seg ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS btw_due_derived,
  bank_revenue, round(CAST(cash_balance AS DOUBLE), 2) AS cash_balance,
  CASE WHEN bank_revenue > 0 THEN round(CAST(gross_revenue - bank_revenue AS DOUBLE) / CAST(bank_revenue AS DOUBLE), 4)
       ELSE 0.0 END AS revenue_bank_delta_derived
FROM (SELECT x.*, coalesce(sum(CASE WHEN month(month) IN (1, 4, 7, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id
        ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
      FROM (SELECT ac.merchant_id, ac.month, ac.gross_revenue, ac.cogs, ac.ebitda, ac.ar_days, ac.ap_days,
              CAST(round(ac.gross_revenue * 0.21, 2) AS DECIMAL(18,2)) AS btw_accrued,
              coalesce(cr.t, 0) AS bank_revenue, coalesce(me.cash, 0) AS cash_balance
            FROM (SELECT g.merchant_id, g.month, coalesce(v.gross_revenue, 0) AS gross_revenue, coalesce(v.cogs, 0) AS cogs,
                    coalesce(v.ebitda, 0) AS ebitda, coalesce(v.ar_days, 0) AS ar_days, coalesce(v.ap_days, 0) AS ap_days
                  FROM (SELECT merchant_id, CAST(unnest(generate_series(m0, DATE '{as_of.replace(day=1).isoformat()}', INTERVAL 1 MONTH)) AS DATE) AS month
                        FROM (SELECT merchant_id, min(month) AS m0 FROM (
                                SELECT merchant_id, month FROM v_accounting WHERE month <= {a}
                                UNION ALL SELECT merchant_id, CAST(date_trunc('month', date) AS DATE) FROM v_bank WHERE date <= {a})
                              GROUP BY 1)) g
                  LEFT JOIN v_accounting v ON v.merchant_id = g.merchant_id AND v.month = g.month) ac
            LEFT JOIN (SELECT merchant_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS t FROM v_bank
                       WHERE direction = 'CREDIT' AND date <= {a} GROUP BY 1, 2) cr
              ON cr.merchant_id = ac.merchant_id AND cr.month = ac.month
            LEFT JOIN (SELECT merchant_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(bal, date) AS cash
                       FROM (SELECT merchant_id, date, arg_max(balance_after, posting_seq) AS bal FROM v_bank WHERE date <= {a} GROUP BY 1, 2)
                       GROUP BY 1, 2) me
              ON me.merchant_id = ac.merchant_id AND me.month = ac.month) x)"""


def daily_balance_sql(as_of: dt.date) -> str:
    a = f"DATE '{as_of.isoformat()}'"
    return (f"SELECT merchant_id, date, arg_max(balance_after, posting_seq) AS closing_balance, count(*) AS postings, "
            f"sum(amount) AS net_amount FROM v_bank WHERE date <= {a} GROUP BY merchant_id, date")


def weekly_gpv_sql(as_of: dt.date) -> str:
    a = f"DATE '{as_of.isoformat()}'"
    d90 = f"DATE '{(as_of - dt.timedelta(days=90)).isoformat()}'"
    return f"""SELECT s.merchant_id, s.week_start, s.week_index, coalesce(w.gross, 0) AS gross
FROM (SELECT merchant_id, w0 + CAST(7 * i AS INTEGER) AS week_start, CAST(i AS INTEGER) AS week_index
      FROM (SELECT merchant_id, w0, unnest(generate_series(0, datediff('day', w0, w1) // 7)) AS i
            FROM (SELECT merchant_id, min(wk) AS w0, max(wk) AS w1 FROM
                    (SELECT merchant_id, CAST(date_trunc('week', order_date) AS DATE) AS wk FROM v_psp
                     WHERE status = 'paid' AND order_date >= {d90} AND order_date <= {a}) GROUP BY 1))) s
LEFT JOIN (SELECT merchant_id, CAST(date_trunc('week', order_date) AS DATE) AS wk, sum(gross_amount) AS gross FROM v_psp
           WHERE status = 'paid' AND order_date >= {d90} AND order_date <= {a} GROUP BY 1, 2) w
  ON w.merchant_id = s.merchant_id AND w.wk = s.week_start"""
