"""DuckDB oracle for the policy layer, generated from the same rule tables."""

from __future__ import annotations

from quire.operators import policy as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _v(feature: str, default: float) -> str:
    return f"coalesce(CAST({feature} AS DOUBLE), {float(default)!r})"


def policy_ctes(src: str = "feat") -> dict[str, str]:
    ko = [f"CASE WHEN coalesce(sanctions_hit, false) THEN 'SANCTIONS_HIT' END",
          f"CASE WHEN NOT coalesce(kvk_active, false) THEN 'KVK_INVALID' END",
          f"CASE WHEN NOT coalesce(ubo_director_match, false) THEN 'UBO_MISMATCH' END",
          f"CASE WHEN {_v('bank_psp_recon_delta', 1.0)} > {P.MAX_RECON_DELTA} THEN 'RECON_FAIL' END",
          f"CASE WHEN {_v('trading_months', 0)} < {P.MIN_TRADING_MONTHS} THEN 'INSUFFICIENT_HISTORY' END",
          f"CASE WHEN {_v('monthly_gmv_avg_6m', 0)} < {P.MIN_MONTHLY_GMV} THEN 'REVENUE_TOO_LOW' END",
          f"CASE WHEN {_v('negative_balance_pct_90d', 1.0)} > {P.MAX_NEGATIVE_BALANCE_PCT} "
          f"THEN 'PERSISTENT_NEGATIVE_BALANCE' END"]
    reds, ambers, codes = [], [], []
    for feat, green, red, kind, code in P.GATES:
        v = _v(feat, red)
        if kind == "standard":
            r, a = f"{v} > {red}", f"{v} > {green}"
        else:
            r, a = f"{v} < {red}", f"{v} < {green}"
        reds.append(f"(CASE WHEN {r} THEN 1 ELSE 0 END)")
        ambers.append(f"(CASE WHEN NOT ({r}) AND {a} THEN 1 ELSE 0 END)")
        codes.append(f"CASE WHEN {r} THEN {_q(code)} END")
    others = (f"least(CAST(requested_amount AS DOUBLE), {_v('monthly_net_cashflow_avg_6m', 0)} * "
              f"coalesce(CAST(requested_tenor_months AS DOUBLE), 6.0) * {P.CASHFLOW_DEBT_SERVICE_RATIO}, "
              f"{_v('monthly_gmv_avg_6m', 0)} * {P.REVENUE_ANCHOR_MULTIPLIER})")
    expl = "CASE x " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in P.REASON_EXPLANATIONS.items()) + " ELSE x END"
    n = len(P.GATES)
    return {
        "pol0": f"""SELECT *,
  list_filter([{', '.join(ko)}], lambda x: x IS NOT NULL) AS ko,
  {' + '.join(reds)} AS red,
  {' + '.join(ambers)} + (CASE WHEN coalesce(marketplace_payout_hold_flag, false) THEN 1 ELSE 0 END) AS amber,
  list_filter([{', '.join(codes)}], lambda x: x IS NOT NULL) AS gate_codes,
  {others} AS others
FROM {src}""",
        "pol1": f"""SELECT *,
  CASE WHEN len(ko) > 0 THEN 'DECLINE' WHEN red >= {P.RED_DECLINE_THRESHOLD} THEN 'DECLINE'
       WHEN red >= {P.RED_MANUAL_THRESHOLD} OR red + amber >= {P.TOTAL_FLAGS_MANUAL_THRESHOLD} THEN 'MANUAL_REVIEW'
       ELSE 'APPROVE' END AS decision,
  greatest(least(others, {float(P.HARD_CAP_EUR)}), 0.0) AS capped
FROM pol0""",
        "pol": f"""SELECT *,
  CASE WHEN decision = 'DECLINE' THEN 0.0
       ELSE round_even(CASE WHEN capped > 0 AND capped < {P.LOAN_MIN_EUR} THEN 0.0 ELSE capped END, -2) END AS max_amount,
  CASE WHEN decision = 'DECLINE' THEN NULL
       WHEN red = 0 AND amber <= {P.PRICING_A_MAX_AMBER} AND {_v('net_cashflow_coverage', 0)} > {P.PRICING_A_MIN_COVERAGE} THEN 'A'
       WHEN red >= 1 OR {_v('net_cashflow_coverage', 0)} < {P.PRICING_C_MAX_COVERAGE} THEN 'C' ELSE 'B' END AS pricing_band,
  CASE WHEN decision = 'DECLINE' THEN 0
       ELSE CAST(greatest({float(P.TENOR_MIN_MONTHS)}, least(coalesce(CAST(requested_tenor_months AS DOUBLE), 6.0), {float(P.TENOR_MAX_MONTHS)})) AS INTEGER) END
    AS tenor_max_months,
  CASE WHEN len(ko) > 0 THEN ko WHEN decision = 'DECLINE' THEN gate_codes
       ELSE list_concat(gate_codes, list_filter([CASE WHEN {float(P.HARD_CAP_EUR)} <= others THEN 'YEAR1_CAP' END,
                                                 CASE WHEN capped > 0 AND capped < {P.LOAN_MIN_EUR} THEN 'BELOW_MIN_LOAN_SIZE' END],
                                                lambda x: x IS NOT NULL)) END AS reason_codes,
  CASE WHEN decision = 'DECLINE' THEN []::VARCHAR[]
       WHEN decision = 'MANUAL_REVIEW' THEN [CAST(red AS VARCHAR) || ' red flags, ' || CAST(amber AS VARCHAR) || ' amber flags']
       ELSE ['YEAR1_ALL_MANUAL_REVIEW'] END AS manual_review_flags,
  CASE WHEN len(ko) > 0 THEN NULL ELSE red END AS red_flags,
  CASE WHEN len(ko) > 0 THEN NULL ELSE amber END AS amber_flags,
  CASE WHEN len(ko) > 0 THEN 0.0 ELSE round(CAST(greatest({n} - red - amber, 0) AS DOUBLE) / {n}, 4) END AS signal_pass_rate
FROM pol1""",
        "pol_out": f"""SELECT application_id, merchant_id, decision, max_amount, pricing_band,
  CASE pricing_band {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.PRICING_BANDS.items())} END AS apr,
  tenor_max_months, array_to_string(reason_codes, '|') AS reason_codes,
  array_to_string(list_transform(reason_codes, lambda x: {expl}), '|') AS explanations,
  array_to_string(manual_review_flags, '|') AS manual_review_flags,
  red_flags, amber_flags, signal_pass_rate
FROM pol""",
    }
