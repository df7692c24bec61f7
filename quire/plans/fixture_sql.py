"""Canonical views as DuckDB SQL, for the oracle side of the correctness check.

These are the FIXTURES view definitions written as CTE bodies. ``with_views``
prepends exactly the CTEs a query mentions (transitively), so every oracle
string is one self-contained SELECT over the driver's raw tables.
"""

from __future__ import annotations

import re

def _padded(number: str) -> str:
    """At least four digits; longer numbers stay whole."""
    text = f"CAST({number} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(4, length({text})) AS INTEGER), '0')"


_K = "CAST(floor(l_suppkey/5) AS BIGINT)"

VIEWS: dict[str, str] = {
    "v_merchants": f"""
WITH k AS (SELECT DISTINCT CAST(floor(s_suppkey/5) AS BIGINT) AS k FROM supplier),
     a AS (SELECT k, false AS ghost FROM k UNION ALL SELECT max(k)+1, true FROM k)
SELECT k, ghost, concat('m_', {_padded('k')}) AS merchant_id,
  concat('Shop', {_padded('k')}, ' B.V.') AS company_name,
  CAST(10000000 + k*7919 AS VARCHAR) AS kvk_number,
  DATE '2001-08-01' - CAST(650 + (k*397)%2200 AS INT) AS incorporation_date,
  CAST(300000 + (k*104729)%4700000 AS DOUBLE) AS annual_gmv, CAST(1 + k%3 AS INT) AS n_psps,
  CASE k%5 WHEN 0 THEN 'fashion' WHEN 1 THEN 'electronics' WHEN 2 THEN 'home' WHEN 3 THEN 'food' ELSE 'beauty' END AS sector,
  k%17=16 AS sanctions_hit, k%13<>12 AS kvk_active, k%5=0 AS is_bad_synthetic, k%5<>4 AS has_webshop,
  CASE WHEN k%20<10 THEN 'bol.com' WHEN k%20<16 THEN 'amazon' END AS primary_marketplace
FROM a""",
    "v_applications": """
SELECT concat('app_', merchant_id) AS application_id, merchant_id,
  CAST(CASE WHEN k%50=13 THEN 2000 ELSE CASE k%7 WHEN 0 THEN 10000 WHEN 1 THEN 15000 WHEN 2 THEN 20000 WHEN 3 THEN 25000 WHEN 4 THEN 40000 WHEN 5 THEN 50000 ELSE 75000 END END AS INT) AS requested_amount,
  CAST(CASE k%5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 12 ELSE 18 END AS INT) AS requested_tenor_months,
  'inventory' AS purpose, DATE '2001-08-01' AS application_date
FROM v_merchants""",
    "v_psp": f"""
SELECT b.*, CAST(gross_amount - fee_amount AS DECIMAL(18,2)) AS net_amount,
  CASE WHEN status='paid' THEN CAST(0 AS DECIMAL(18,2)) ELSE gross_amount END AS refund_amount
FROM (SELECT concat_ws('_', 'P', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS psp_transaction_id, concat('m_', {_padded(_K)}) AS merchant_id,
  {_K} AS k,
  CASE WHEN {_K}%10 IN (1,2,3) THEN CASE l_linenumber%3 WHEN 0 THEN 'mollie' WHEN 1 THEN 'adyen' ELSE 'stripe' END WHEN l_linenumber%2=0 THEN 'mollie' ELSE 'adyen' END AS psp_name,
  CAST(l_shipdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) + CAST(1 + l_partkey%(CASE WHEN {_K}%10 IN (1,2,3) THEN 4 ELSE 9 END) AS INT) AS settlement_date,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_amount,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2))*0.015,2) AS DECIMAL(18,2)) AS fee_amount,
  CASE WHEN l_partkey%150=0 THEN 'chargeback' WHEN l_partkey%100 BETWEEN 1 AND (CASE WHEN {_K}%10 IN (1,2,3) THEN 1 ELSE 2 + 2*({_K}%5) END) THEN 'refunded' ELSE 'paid' END AS status,
  CASE l_linenumber%4 WHEN 0 THEN 'ideal' WHEN 1 THEN 'creditcard' WHEN 2 THEN 'bancontact' ELSE 'klarna' END AS payment_method,
  concat('buyer_', CAST(o_custkey AS VARCHAR)) AS buyer_id,
  CASE WHEN l_partkey%150=0 THEN CASE WHEN l_orderkey%2=0 THEN 'won' ELSE 'lost' END END AS dispute_outcome
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE CAST(l_shipdate AS DATE) <= DATE '2001-08-01') b""",
    "v_bank": f"""
SELECT p.*, CAST(10000 + sum(amount) OVER (PARTITION BY merchant_id ORDER BY date, transaction_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance_after,
  row_number() OVER (PARTITION BY merchant_id, date ORDER BY transaction_id) AS posting_seq
FROM (
  SELECT merchant_id, k, settlement_date AS date,
    CASE WHEN k%10 IN (1,2,3) THEN CAST((CAST(sum(sum(net_amount)) OVER same_month * 100 AS BIGINT) * 98)
        // (100 * count(*) OVER same_month) / 100.0 AS DECIMAL(18,2))
      ELSE CAST(round(sum(net_amount)*CASE WHEN k%10=9 THEN 0.70 ELSE 0.98 END,2) AS DECIMAL(18,2)) END AS amount, 'CREDIT' AS direction,
    CASE psp_name WHEN 'mollie' THEN 'Mollie B.V.' WHEN 'adyen' THEN 'Adyen N.V.' ELSE 'Stripe Ltd.' END AS counterparty_name, 'psp_settlement' AS category,
    concat_ws('_', 'C', CAST(settlement_date AS VARCHAR), psp_name) AS transaction_id
  FROM v_psp WHERE status='paid' AND settlement_date <= DATE '2001-08-01' GROUP BY merchant_id, k, settlement_date, psp_name
  WINDOW same_month AS (PARTITION BY merchant_id, date_trunc('month', settlement_date))
  UNION ALL
  SELECT concat('m_', {_padded(_K)}), {_K}, CAST(l_shipdate AS DATE),
    CAST(-round(CAST(l_extendedprice AS DECIMAL(18,2))*CASE WHEN l_linestatus<>'F' THEN 0.01 WHEN l_linenumber<=4 THEN 0.80 WHEN l_linenumber=5 THEN CASE WHEN {_K}%5=0 THEN 3.00 ELSE 0.60 END WHEN l_linenumber=6 THEN 0.50 ELSE 0.01 END
      * CASE WHEN {_K}%10=5 THEN 4.00 ELSE 1.00 END,2) AS DECIMAL(18,2)),
    'DEBIT', concat('Supplier_', CAST(l_partkey%19 AS VARCHAR)),
    CASE WHEN l_linestatus<>'F' THEN 'bank_fee' WHEN l_linenumber<=4 THEN 'supplier_payment' WHEN l_linenumber=5 THEN 'advertising' WHEN l_linenumber=6 THEN 'tax_payment' ELSE 'nsf_fee' END,
    concat_ws('_', 'D', l_orderkey, l_linenumber, l_partkey, l_suppkey)
  FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '2001-08-01') p""",
    "v_webshop": f"""
SELECT concat_ws('_', 'O', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_id, concat('m_', {_padded(_K)}) AS merchant_id, CAST(l_shipdate AS DATE) AS order_date,
  CASE l_linenumber%3 WHEN 0 THEN 'website' WHEN 1 THEN 'mobile_app' ELSE 'api' END AS channel,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_amount, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2))*CAST(l_discount AS DECIMAL(4,2)),2) AS DECIMAL(18,2)) AS discount_amount,
  CAST(l_quantity AS INT) AS item_count, concat('sku_', CAST(l_partkey%40 AS VARCHAR)) AS sku_id,
  CASE WHEN l_partkey%50 < 1 + {_K}%5 THEN 'cancelled' WHEN l_partkey%50 BETWEEN 10 AND 12 THEN 'returned' ELSE 'completed' END AS status,
  CAST(l_quantity AS INT)%6 AS fulfillment_days, o_custkey%3=0 AS is_repeat_customer, concat('cust_', CAST(o_custkey AS VARCHAR)) AS customer_id
FROM lineitem JOIN orders ON l_orderkey=o_orderkey
WHERE {_K}%5<>4 AND CAST(l_shipdate AS DATE) <= DATE '2001-08-01'""",
    "v_marketplace": """
SELECT m.merchant_id, m.primary_marketplace AS marketplace, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(gross_amount) AS gmv,
  count(*)*10 AS order_count, sum(CASE WHEN p.status='refunded' THEN 1 ELSE 0 END) AS cancelled_count,
  sum(CASE WHEN psp_name='mollie' AND p.k%4=0 THEN 1 ELSE 0 END) AS late_shipment_count,
  sum(CASE WHEN p.status='refunded' THEN 1 ELSE 0 END) AS return_count, sum(CASE WHEN p.status='chargeback' THEN 1 ELSE 0 END) AS negative_feedback_count,
  CAST(4 + p.k%6 + month(CAST(date_trunc('month', order_date) AS DATE))%2 AS DOUBLE) AS account_health_score,
  (p.k%8=3 AND month(CAST(date_trunc('month', order_date) AS DATE))%3=0) AS payout_hold_active,
  CAST(2 + p.k%9 AS DOUBLE) AS payout_lag_days, CAST(p.k%2 AS BIGINT) AS policy_violation_count, CAST(20 + p.k%50 AS DOUBLE)/100 AS marketplace_gmv_share
FROM v_psp p JOIN v_merchants m ON p.merchant_id=m.merchant_id WHERE m.primary_marketplace IS NOT NULL
GROUP BY m.merchant_id, m.primary_marketplace, p.k, CAST(date_trunc('month', order_date) AS DATE)""",
    "v_accounting": """
SELECT *, CAST(gross_revenue - cogs AS DECIMAL(18,2)) AS gross_profit, CAST(gross_revenue - cogs - ebitda AS DECIMAL(18,2)) AS total_opex,
  CAST((CAST(round(gross_revenue*100) AS BIGINT)*CAST(ar_days AS BIGINT)*2 + 30)//60/100.0 AS DECIMAL(18,2)) AS accounts_receivable,
  CAST((CAST(round(cogs*100) AS BIGINT)*CAST(ap_days AS BIGINT)*2 + 30)//60/100.0 AS DECIMAL(18,2)) AS accounts_payable,
  CAST(round(gross_revenue*0.21,2) AS DECIMAL(18,2)) AS btw_accrued,
  CASE WHEN btw_paid_on_time THEN btw_due ELSE CAST(0 AS DECIMAL(18,2)) END AS btw_paid
FROM (SELECT merchant_id, month, gross_revenue, gross_margin, CAST(round(gross_revenue*(1-gross_margin),2) AS DECIMAL(18,2)) AS cogs,
  CAST(round(gross_revenue*(gross_margin-0.12),2) AS DECIMAL(18,2)) AS ebitda, cash_balance,
  CASE WHEN month(month) IN (1,4,7,10) THEN CAST(round(gross_revenue*0.21,2) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS btw_due,
  NOT (k%6=0 AND month(month)=7) AS btw_paid_on_time, CAST(round(gross_revenue*0.03,2) AS DECIMAL(18,2)) AS owner_draws,
  CAST(15 + k%40 AS DOUBLE) AS ap_days, CAST(5 + k%20 AS DOUBLE) AS ar_days,
  CASE WHEN bank_revenue > 0 THEN round(CAST(gross_revenue-bank_revenue AS DOUBLE)/CAST(bank_revenue AS DOUBLE),4) ELSE 0.0 END AS revenue_bank_delta
FROM (SELECT merchant_id, k, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS bank_revenue,
    arg_max(balance_after, (date - DATE '1970-01-01') * 4294967296 + posting_seq) AS cash_balance,
    CAST(round(sum(amount)*CASE WHEN k%10=0 THEN 1.20 ELSE 1.01 END,2) AS DECIMAL(18,2)) AS gross_revenue,
    CAST(0.10 + 0.05*(k%10) + CASE WHEN k%10 IN (1,2,3) THEN 0.25 ELSE 0.00 END AS DECIMAL(6,2)) AS gross_margin
  FROM v_bank WHERE direction='CREDIT' AND k%9<>8 GROUP BY merchant_id, k, CAST(date_trunc('month', date) AS DATE)) t) u""",
    "v_kyc": """
SELECT merchant_id, kvk_number, concat('Owner of ', company_name) AS ubo_name, kvk_active AS kvk_verified, k%11<>10 AS ubo_director_match, k%4<>3 AS ubo_verified, false AS pep_match,
  sanctions_hit AS sanctions_match, CAST(k%4 AS INT) AS identity_changes_12m, DATE '2001-08-01' - CAST(30 + (k*53)%700 AS INT) AS last_kyc_date,
  CASE k%3 WHEN 0 THEN 'basic' WHEN 1 THEN 'enhanced' ELSE 'full' END AS verification_level
FROM v_merchants WHERE NOT ghost""",
    "v_consents": f"""
SELECT concat('m_', {_padded('CAST(floor(user_id/5) AS BIGINT)')}) AS merchant_id,
  CASE event_id%3 WHEN 0 THEN 'psd2_aisp' WHEN 1 THEN 'psp_mollie' ELSE 'psp_adyen' END AS consent_type,
  CASE WHEN event_type='error' THEN 'REVOKED' ELSE 'GRANTED' END AS action, ts AS event_ts, event_id,
  CASE WHEN event_type='error' THEN NULL ELSE CAST(ts AS DATE) + 90 END AS expires_at
FROM events""",
}

_ORDER = list(VIEWS)


def _deps(text: str, known: dict[str, str]) -> set[str]:
    return {n for n in known if re.search(rf"\b{n}\b", text)}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it needs. ``extra`` adds query-specific
    CTEs (name -> body) that may themselves use the views; they come after the
    views in insertion order."""
    known = dict(VIEWS)
    order = list(_ORDER)
    if extra:
        for n, b in extra.items():
            known[n] = b
            order.append(n)
    need: set[str] = set()
    frontier = _deps(sql, known)
    while frontier:
        n = frontier.pop()
        if n in need:
            continue
        need.add(n)
        frontier |= _deps(known[n], known) - need - {n}
    parts = [f"{n} AS ({known[n].strip()})" for n in order if n in need]
    body = sql.strip()
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
