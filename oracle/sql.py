"""One SQL text per query name."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from forewarn.sources.adapters import SNAPSHOT
from oracle.base import (
    BANDS, COMP, COMP_IMPUTED, CROSS_FULL, CROSS_SNAP, EMI, EXPENSES, FEATURES, GIVEN, MODEL_WEIGHTS, MONEY, NUM, WEIGHTS,
    case, classify, clip, cols, cut, div, max0, message, rnd, row_std, scenario_cols, sql,
)

ORACLE: dict[str, str] = {}


def add(name: str, body: str, extra: dict | None = None) -> None:
    ORACLE[name] = sql(body, extra)


def snap(name: str, exprs: dict, src: str = "snap", where: str = "", key: str = "LoanID") -> None:
    add(name, f"SELECT {key}, {cols(exprs)} FROM {src}{' WHERE ' + where if where else ''}")


def names(*n):
    return {c: f'"{c}"' for c in n}


Z = lambda x, d=2: rnd(x, d) + " + 0.0"  # noqa: E731  (no negative zero)

# --- sources and sinks
add("s1_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
add("s2_csv_scan", "SELECT CAST(LoanID AS VARCHAR) AS LoanID, CAST(Age AS INTEGER) AS Age, Income, LoanAmount, CAST(CreditScore AS"
    " INTEGER) AS CreditScore, CAST(MonthsEmployed AS INTEGER) AS MonthsEmployed, CAST(NumCreditLines AS INTEGER) AS NumCreditLines,"
    " InterestRate, CAST(LoanTerm AS INTEGER) AS LoanTerm, DTIRatio, EmploymentType FROM enr")
add("s3_path_fallback", "SELECT c_custkey, c_acctbal FROM customer")
add("s4_parquet_sink", "SELECT LoanID, risk_score_v2, risk_band FROM scored")
add("s5_csv_sink", "SELECT LoanID, risk_band, risk_score, channel, timing, message, scenario FROM outreach")
add("s6_sample_sink", "SELECT LoanID, Income, LoanAmount, segment_category FROM snap ORDER BY LoanID LIMIT 1000")
_FLAT = ("SELECT customer_id, fip_id, account_type, balance, CASE WHEN account_type = 'SAVINGS' THEN row_number() OVER (PARTITION BY"
         " customer_id, account_type ORDER BY account_key) = 1 END AS is_primary, emi, outstanding FROM acct")
add("s7_json_lines", _FLAT)
add("s8_json_events", "SELECT event_id, customer_id, type, amount, category, ts, monthly_income FROM txn")
add("s9_bounded_consume", "SELECT event_id, customer_id, type, amount, category, ts, monthly_income FROM txn")
_ALERTS = ("SELECT event_id, customer_id, ts AS trigger_time, concat_ws('|', r1, r2, r3) AS reasons, 'RESCORE' AS action, CASE WHEN"
           " (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority"
           " FROM ale WHERE r1 IS NOT NULL OR r2 IS NOT NULL OR r3 IS NOT NULL")
for _n in ("s10_alert_sink", "t6_alerts", "t6_stream_alerts"):
    add(_n, _ALERTS)

# --- projections and predicates
snap("p1_optional_filled", {"stress": "coalesce(industry_stress_index, 30.0)", "absent": "7.0"})
snap("p2_optional_absent", {"stress": "industry_stress_index", "dining": "0.0"})
snap("p3_right_closed_bands", {
    "dti_band": cut("DTIRatio", [-1, 30, 40, 50, 200], ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"]),
    "age_band": cut("Age", [18, 25, 40, 60], ["young", "mid", "senior"])})
_SD = "CASE WHEN segment_category = 'EMPLOYED' AND LoanID % 3 > 0 THEN " + rnd(clip("salary_delay_days", 0, 30), 1) + " END"
snap("p4_nested_bands", {"sdt": _SD, "sdt_band": FEATURES["sdt_band"]})
snap("p5_clip", {"both": clip("peer_default_rate", 0.1, 0.2), "low": clip("income_cv_daily", lo=0.5), "high": clip("CreditScore", hi=700)})
snap("p6_half_even_round", {f"r{d}": rnd("LoanID / 8", d) for d in (0, 1, 2)})
snap("p7_null_fill", {c: f"coalesce({c}, -999.0)" for c in ("industry_stress_index", "peer_default_rate", "income_cv_daily")})
snap("p8_value_map", {"cv": case(*[(f"segment_category = '{s}'", v) for s, v in (
    ("BUSINESS_OWNER", "0.35"), ("SELF_EMPLOYED", "0.40"), ("RETIRED", "0.02"), ("STUDENT", "0.50"))], other="0.20")})
snap("p9_select_by_prefix", names(*EXPENSES, "p2p_borrow_requests_30d"))
snap("p10_drop_present", names("Income"))
snap("p11_align_features", {"Income": "Income", "unknown_feature": "0.0", "Age": "Age", "CreditScore": "CreditScore"})
snap("p12_feature_mismatch", {"Income": "Income", "ensemble_probability": "0.5"})
snap("p13_membership", names("segment_category"), where="segment_category IN ('RETIRED', 'STUDENT')")
snap("p14_range_filter", names("DTIRatio"), where="segment_category = 'EMPLOYED' AND DTIRatio BETWEEN 30 AND 45")
snap("p15_key_lookup", names("LoanAmount"),
     where="CAST(LoanID AS VARCHAR) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')")
_DISPLAY = rnd(clip("(900 - CreditScore) / 6", 0, 100), 1)
snap("p16_column_alias", {"employment_type": "EmploymentType", "monthly_income": "Income", "risk_score": _DISPLAY}, src="enr")
add("p17_request_defaults", "SELECT CAST(LoanID AS VARCHAR) AS LoanID, CAST(Age AS INTEGER) AS Age, Income, 500000.0 AS LoanAmount,"
    " CAST(CASE WHEN LoanID % 2 = 0 THEN CreditScore ELSE 700 END AS INTEGER) AS CreditScore, 36 AS MonthsEmployed, 3 AS NumCreditLines,"
    " 12.0 AS InterestRate, 36 AS LoanTerm, 30.0 AS DTIRatio, 0 AS HasCoSigner, segment_category, 0.95 AS ontime_payment_rate_12m,"
    " 0.0 AS avg_delay_days, 30000.0 AS avg_monthly_balance_6m, 300000.0 AS total_outstanding_debt, 40.0 AS"
    " credit_utilization_ratio, 0 AS num_dpd_30_plus FROM snap")
_LAST = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_timestamp DESC, LoanID DESC) AS rn FROM snap)"
         " WHERE rn = 1")
add("p18_keep_last", f"SELECT customer_id, LoanID, event_timestamp, LoanAmount FROM ({_LAST})")
snap("p19_safe_divide", {"ratio": rnd(div("LoanAmount", "industry_stress_index"), 4)})
add("p20_label_encode", "SELECT LoanID, s AS detailed_segment, CAST(coalesce(code, -1) AS INTEGER) AS detailed_segment_code FROM"
    " (SELECT LoanID, CASE WHEN LoanID % 7 > 0 THEN detailed_segment END AS s FROM snap) a LEFT JOIN"
    " (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT detailed_segment AS v FROM snap WHERE LoanID % 7 > 0)) b"
    " ON a.s = b.v")

# --- joins and lookups
_COMP4 = {f"comp_{c}": rnd(f"comp_{c}", 4) for c in WEIGHTS}
snap("j1_attach_components", _COMP4, src="scored")
_SEG = [("SALARIED_PRIVATE", "EMPLOYED", "Private Sector", "Monthly Salary"), ("BUSINESS_CASH", "BUSINESS_OWNER", "Cash-Only Business", "Cash Revenue"),
        ("SELF_GIG", "SELF_EMPLOYED", "Gig Worker", "Daily/Weekly"), ("RETIRED_GOVT", "RETIRED", "Pension (Govt)", "Monthly Pension"),
        ("STUDENT_UG", "STUDENT", "Undergraduate", "Family/Scholarship")]
add("j2_segment_lookup", "SELECT LoanID, detailed_segment, category, sub_category, income_source FROM snap LEFT JOIN (VALUES "
    + ", ".join(str(r) for r in _SEG) + ") AS d(k, category, sub_category, income_source) ON detailed_segment = k")
_PROB = {"SAFE": "< 5%", "LOW RISK": "5-15%", "MODERATE": "15-35%", "HIGH RISK": "35-60%", "CRITICAL": "> 60%"}
_ACT = {"SAFE": "Monitor only", "LOW RISK": "Gentle nudge, wellness tips", "MODERATE": "Proactive outreach, options",
        "HIGH RISK": "Urgent call, restructuring", "CRITICAL": "Immediate intervention"}
_by_band = lambda b, m: case(*[(f"{b} = '{k}'", f"'{v}'") for k, v in m.items()])
add("j3_band_lookup", f"SELECT LoanID, risk_score_v2, risk_band AS band, {_by_band('risk_band', _PROB)} AS probability,"
    f" {_by_band('risk_band', _ACT)} AS action FROM imputed")
add("j4_point_in_time", "SELECT customer_id, event_timestamp, LoanID, feature_ts, LoanAmount, DTIRatio, CreditScore FROM (SELECT s.customer_id,"
    " s.event_timestamp, s.LoanID, v.event_timestamp AS feature_ts, v.LoanAmount, v.DTIRatio, v.CreditScore, row_number() OVER (PARTITION BY"
    " s.LoanID ORDER BY v.event_timestamp DESC NULLS LAST, v.LoanID DESC) AS rn FROM (SELECT * FROM snap WHERE LoanID % 2 = 0) s"
    " LEFT JOIN (SELECT * FROM snap WHERE LoanID % 2 = 1) v ON s.customer_id = v.customer_id AND v.event_timestamp <= s.event_timestamp AND"
    " v.event_timestamp > s.event_timestamp - INTERVAL 90 DAY) WHERE rn = 1")
_CORE = ["Income", "LoanAmount", "CreditScore", "DTIRatio", "LoanTerm", "avg_monthly_balance_6m", "total_monthly_expense"]
for _n in ("j5_online_latest", "j5_online_store"):
    add(_n, "SELECT customer_id, event_timestamp AS feature_ts, " + ", ".join(
        f"CASE WHEN event_timestamp > TIMESTAMP '2001-01-01' - INTERVAL 365 DAY THEN {c} END AS {c}" for c in _CORE) +
        " FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_timestamp DESC, LoanID DESC) AS rn FROM snap WHERE"
        " event_timestamp <= TIMESTAMP '2001-01-01') WHERE rn = 1")
_FIN = "fip_id IN ('PaySense', 'MoneyTap', 'CASHe', 'EarlySalary')"
_ROLL = {"total_emi_other_banks": rnd("CAST(sum(CAST(coalesce(emi, 0.0) AS DECIMAL(18,4))) AS DOUBLE)", 2),
         "num_banks": "count(DISTINCT CASE WHEN account_type = 'SAVINGS' THEN fip_id END)",
         "total_balance_all_banks": rnd("CAST(sum(CAST(coalesce(balance, 0.0) AS DECIMAL(18,4))) AS DOUBLE)", 2), "has_fintech_loans": f"bool_or({_FIN})"}
_ROLLUP = f"SELECT customer_id, {cols(_ROLL)} FROM acct GROUP BY customer_id"
add("j6_profile_loan_join", f"SELECT a.*, \"Default\" AS target, Income AS monthly_income FROM ({_ROLLUP}) a JOIN ({_LAST}) l"
    " ON a.customer_id = CAST(l.customer_id AS VARCHAR)")
add("j7_weight_join", "SELECT LoanID, ensemble_probability FROM giv")

# --- feature formulas
for _name, _outs in {
    "f1_income_stability": ["isi", "isi_band"], "f2_debt_to_income": ["computed_dti", "dti_band"],
    "f3_savings_rate": ["savings_rate_pct", "savings_band"], "f4_emi_cushion": ["eci", "eci_band"],
    "f5_expenditure_volatility": ["evs", "evs_ratio"], "f6_salary_delay_trend": ["sdt", "sdt_band"],
    "f7_cash_deposit_pattern": ["cdps", "cash_sufficiency_ratio", "cdps_band"], "f8_discretionary_spending": ["dsr", "dsr_band"],
    "f9_payment_timing": ["ptc", "ptc_band"], "f10_balance_trajectory": ["abt", "abt_band"],
    "f11_subscription_cascade": ["subscription_cascade_score"], "f12_wallet_velocity": ["wallet_velocity", "wallet_velocity_band"],
    "f13_merchant_downgrade": ["merchant_downgrade_score", "merchant_downgrade_band"],
    "f14_healthcare_spike": ["healthcare_current_spend", "healthcare_spike_ratio", "healthcare_spike_band"],
    "f15_employer_contagion": ["employer_risk_multiplier"], "f16_gig_income_variance": ["gig_cv_band"],
    "f18_all_features": [*FEATURES, *CROSS_SNAP],
}.items():
    snap(_name, names(*_outs), src="feat")

_FINANCIAL = "fd_rd_total + mutual_fund_value + stock_portfolio_value + gold_value + epf_ppf_balance"
_FLAGS = rnd(" + ".join(f"{w} * CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for w, c in (
    (0.20, "p2p_borrow_requests_30d > 0"), (0.15, "instant_cashouts_month > 3"), (0.15, "subscription_cascade_phase > 1"),
    (0.20, "password_resets_30d > 1"), (0.15, "statement_open_rate < 0.3"), (0.15, "customer_service_calls_30d > 2"))), 3)
_TOTALS = (f"SELECT * REPLACE ({rnd(' + '.join(EXPENSES))} AS total_monthly_expense, "
           f"{rnd(clip('(Income - ' + rnd(' + '.join(EXPENSES)) + ') / nullif(Income, 0)', -0.5, 0.8), 3)} AS savings_rate),"
           f" {_FINANCIAL} AS total_financial_assets, {_FINANCIAL} + property_value_total AS total_assets,"
           f" {rnd('1 - auto_debit_success_rate', 3)} AS manual_payment_pct, CASE WHEN total_outstanding_debt > 0 THEN"
           f" {rnd(f'({_FINANCIAL} + property_value_total) / total_outstanding_debt', 2)} ELSE 999.0 END AS asset_to_debt_ratio FROM enr")
add("f17_cross_features", f"SELECT LoanID, {', '.join(CROSS_FULL)} FROM (SELECT *, {cols({k: v for k, v in FEATURES.items()})},"
    f" {cols(CROSS_FULL)} FROM fb)", {"fb": f"SELECT *, {_FLAGS} AS behavioral_risk_score FROM ({_TOTALS})"})
add("f19_feature_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd(f'avg({c})', 6)} AS mean, {rnd(f'stddev_samp({c})', 6)} AS std, {rnd(f'CAST(min({c}) AS DOUBLE)', 6)}"
    f" AS min, {rnd(f'CAST(max({c}) AS DOUBLE)', 6)} AS max FROM feat" for c in (
        "isi", "computed_dti", "savings_rate_pct", "eci", "evs_ratio", "dsr", "ptc", "abt", "wallet_velocity", "financial_stress_index")))

# --- history
_PER = lambda where, unit, aggs: (f"SELECT customer_id, date_trunc('{unit}', ts) AS period, {aggs} FROM txn"  # noqa: E731
                                  f"{' WHERE ' + where if where else ''} GROUP BY 1, 2")
_CRED = "type IN ('credit', 'salary')"
_WHOLE = lambda rows, days, values: (
    f"SELECT cal.customer_id, cal.period, {', '.join(f'coalesce({v}, 0.0) AS {v}' for v in values)} FROM (SELECT customer_id,"
    f" unnest(generate_series(min(period), max(period), INTERVAL {days} DAY)) AS period FROM ({rows}) GROUP BY 1) cal LEFT JOIN ({rows}) r"
    " ON r.customer_id = cal.customer_id AND r.period = cal.period")
_FLOW = lambda cond: _WHOLE(_PER("", "week", f"sum(CASE WHEN {cond} THEN amount ELSE 0.0 END) AS v"), 7, ["v"])
add("h1_income_stability", f"SELECT customer_id, count(*) AS periods, {rnd('stddev_samp(v) / nullif(avg(v), 0) * 100', 4)} AS isi FROM"
    f" ({_FLOW(_CRED)}) GROUP BY customer_id")
add("h2_expenditure_volatility", f"SELECT customer_id, count(*) AS periods, {rnd('stddev_samp(v)', 4)} AS evs FROM ("
    + _FLOW("type = 'debit'") + ") GROUP BY customer_id")
_DELAY = rnd("avg(date_diff('day', period, paid))", 4)
add("h3_salary_delay", f"SELECT customer_id, {_DELAY} AS sdt FROM (" + _PER("type = 'salary'", "month", "min(ts) AS paid") + ") GROUP BY customer_id")
add("h4_deposits_before_due", f"SELECT customer_id, count(*) AS dues, CAST(sum(hit) AS BIGINT) AS covered, {rnd('sum(hit) / count(*) * 100', 4)}"
    " AS cdps FROM (SELECT d.customer_id, d.event_id, CASE WHEN EXISTS (SELECT 1 FROM txn c WHERE c.type = 'credit' AND c.customer_id ="
    " d.customer_id AND c.ts <= d.ts AND c.ts >= d.ts - INTERVAL 3 DAY) THEN 1 ELSE 0 END AS hit FROM txn d WHERE d.type = 'payment')"
    " GROUP BY customer_id")
add("h5_payment_timing", f"SELECT customer_id, count(*) AS payments, {rnd('1 - stddev_samp(day(ts)) / 15', 4)} AS ptc FROM txn WHERE type ="
    " 'payment' GROUP BY customer_id")
_SIGNED = f"sum(CASE WHEN {_CRED} THEN amount WHEN type = 'debit' THEN -amount ELSE 0.0 END)"
add("h6_balance_trajectory", f"SELECT customer_id, period, start_balance, end_balance, {rnd('(end_balance - start_balance) / nullif(start_balance, 0)', 4)}"
    f" AS abt FROM (SELECT customer_id, period, {rnd('1000.0 + run - net', 2)} AS start_balance, {rnd('1000.0 + run', 2)} AS end_balance FROM"
    f" (SELECT *, sum(net) OVER (PARTITION BY customer_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS run FROM ({_PER('', 'week', _SIGNED + ' AS net')})))")
add("h7_healthcare_ratio", f"SELECT customer_id, period, {rnd('v', 2)} AS current_spend, {rnd('b', 2)} AS baseline,"
    f" {rnd('v / nullif(b, 0)', 4)} AS healthcare_ratio FROM (SELECT *, avg(v) OVER (PARTITION BY customer_id ORDER BY period ROWS BETWEEN 2"
    " PRECEDING AND 1 PRECEDING) AS b FROM (" + _WHOLE(_PER("category = 'healthcare'", "week", "sum(amount) AS v"), 7, ["v"]) + "))")
add("h8_gig_variance", f"SELECT customer_id, count(*) AS days, {rnd('stddev_samp(v) / nullif(avg(v), 0)', 4)} AS income_cv_daily FROM"
    f" ({_WHOLE(_PER(_CRED, 'day', 'sum(amount) AS v'), 1, ['v'])}) GROUP BY customer_id")
add("h9_discretionary_drop", f"SELECT customer_id, period, {rnd('dsr', 4)} AS dsr, {rnd('dsr - lag(dsr) OVER (PARTITION BY customer_id ORDER BY period)', 4)}"
    " AS dsr_change FROM (SELECT customer_id, period, disc / greatest(total, 1.0) * 100 AS dsr FROM ("
    + _WHOLE(_PER("type = 'debit'", "week", "sum(CASE WHEN category = 'entertainment' THEN amount ELSE 0.0 END) AS disc, sum(amount) AS total"),
             7, ["disc", "total"]) + "))")

# --- derived columns
_B = "LoanID * 7919 % 10000"


def pick(opts):
    return case(*[(f"{_B} < {edge}", f"'{s}'") for s, edge in opts], other=f"'{opts[-1][0]}'")


_DET = case(("EmploymentType = 'Unemployed' AND Age >= 55", pick([("RETIRED_GOVT", 6000), ("RETIRED_PRIVATE", 10000)])),
            ("EmploymentType = 'Unemployed' AND Age <= 25", pick([("STUDENT_UG", 6000), ("STUDENT_PG", 10000)])),
            ("EmploymentType = 'Full-time'", pick([("SALARIED_PRIVATE", 5500), ("SALARIED_GOVT", 8500), ("SALARIED_CONTRACT", 10000)])),
            ("EmploymentType = 'Part-time'", pick([("SELF_FREELANCER", 4000), ("SELF_GIG", 7500), ("SELF_PROFESSIONAL", 10000)])),
            ("EmploymentType = 'Self-employed'", pick([("BUSINESS_SMALL", 4000), ("BUSINESS_MSME", 7500), ("BUSINESS_CASH", 10000)])),
            ("EmploymentType = 'Unemployed'", pick([("STUDENT_UG", 2500), ("STUDENT_PG", 5000), ("RETIRED_GOVT", 7500), ("RETIRED_PRIVATE", 10000)])),
            other="'SALARIED_PRIVATE'")
add("e1_segment_assignment", f"SELECT LoanID, seg AS detailed_segment, CASE WHEN seg LIKE 'SALARIED%' THEN 'EMPLOYED' WHEN seg LIKE 'BUSINESS%' THEN"
    " 'BUSINESS_OWNER' WHEN seg LIKE 'SELF%' THEN 'SELF_EMPLOYED' WHEN seg LIKE 'RETIRED%' THEN 'RETIRED' ELSE 'STUDENT' END AS segment_category"
    f" FROM (SELECT LoanID, {_DET} AS seg FROM enr)")
add("e2_totals", "SELECT LoanID, total_monthly_expense, savings_rate, total_financial_assets, total_assets, asset_to_debt_ratio,"
    " manual_payment_pct FROM fb", {"fb": _TOTALS})
add("e3_enrichment_ratios",
    "SELECT LoanID, " + cols({
        "emi_to_income_ratio": rnd(clip("LoanAmount / (LoanTerm * Income + 1)", 0, 5), 4),
        "expense_to_income_ratio": rnd(clip("total_monthly_expense / (Income + 1)", 0, 3), 3),
        "liquidity_ratio": rnd(clip("avg_monthly_balance_6m / (total_monthly_expense + 1)", 0, 20), 3),
        "debt_service_coverage": rnd(clip("Income / (LoanAmount / LoanTerm + 1)", 0, 50), 3),
        "net_worth": rnd("total_assets - total_outstanding_debt"),
        "financial_cushion_months": rnd(clip("total_financial_assets / (total_monthly_expense + 1)", 0, 120), 1)}) + " FROM fb",
    {"fb": _TOTALS})
snap("e4_behavioral_flags", {"behavioral_risk_score": _FLAGS}, src="enr")
snap("e5_category_stability", {"income_stability_index": case(
    ("segment_category = 'EMPLOYED'", "0.85"), ("segment_category = 'BUSINESS_OWNER'", "0.65"),
    ("segment_category = 'SELF_EMPLOYED'", "0.55"), ("segment_category = 'RETIRED'", "0.9"), other="0.3")})
_AMORT = lambda r: f"LoanAmount * {r} * pow(1.0 + {r}, LoanTerm) / (pow(1.0 + {r}, LoanTerm) - 1)"
_EMI0 = f"CASE WHEN rate > 0 THEN {_AMORT('(rate / 12 / 100)')} ELSE LoanAmount / LoanTerm END"
add("e6_loan_instalment", f"SELECT LoanID, {rnd('e', 2)} AS emi, {rnd('e / Income * 100', 2)} AS DTIRatio FROM (SELECT *, {_EMI0} AS e FROM"
    " (SELECT *, CASE WHEN LoanID % 9 = 0 THEN 0.0 ELSE InterestRate END AS rate FROM enr))")
add("e7_ledger_ratios", "SELECT LoanID, " + cols({
    "emi_to_income_ratio": rnd(div("emi", "Income") + " * 100", 2), "emi_to_savings_ratio": rnd(div("emi", "avg_monthly_balance_6m") + " * 100", 2),
    "liquidity_ratio": rnd(div("avg_monthly_balance_6m", "emi"), 3),
    "financial_cushion_months": rnd(div("total_financial_assets", "total_monthly_expense"), 1),
    "debt_service_coverage": rnd(div("Income", "emi"), 3), "months_of_runway": rnd(div("avg_monthly_balance_6m", "total_monthly_expense"), 1),
    "bounce_per_credit_line": rnd(div("cheque_bounce_count_12m", "NumCreditLines"), 3),
    "loan_burden_score": rnd("dti * 0.4 + credit_utilization_ratio * 0.3 + (1 - ontime_payment_rate_12m) * 100 * 0.3", 1)})
    + f" FROM (SELECT *, {rnd('e', 2)} AS emi, {rnd('e / Income * 100', 2)} AS dti FROM (SELECT *,"
    f" {_AMORT('(InterestRate / 12 / 100)')} AS e FROM fb))", {"fb": _TOTALS})
_IF = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0.0 END"
_LOGIT = " + ".join([
    "-3.5", "0.025 * (DTIRatio - 35)", "-0.006 * (CreditScore - 680)", f"0.015 * {max0('credit_utilization_ratio - 50')}",
    "-0.02 * savings_rate", f"0.8 * {max0('0.5 - 0.6')}", "-2.0 * (ontime_payment_rate_12m - 0.85)", "0.03 * max_dpd_last_12m",
    "0.15 * cheque_bounce_count_12m", "0.12 * partial_payment_count_12m", _IF("statement_open_rate < 0.2", "0.5"),
    "0.25 * password_resets_30d", "0.35 * (subscription_cascade_phase - 1)", "0.15 * instant_cashouts_month",
    "0.2 * p2p_borrow_requests_30d", _IF("discretionary_spending_change_pct < -25", "0.7"), _IF("balance_trajectory_pct < -15", "0.9"),
    _IF("salary_delay_days > 5", "0.6"), "1.0 * coalesce(peer_default_rate, 0.05)", _IF("coalesce(employer_health_score, 70.0) < 50", "0.4"),
    _IF("healthcare_spending_multiplier > 2", "0.8"),
    case(("segment_category = 'SELF_EMPLOYED'", f"0.3 * {max0('income_cv_daily - 0.4')} + 0.05 * zero_income_days_month"),
         ("segment_category = 'BUSINESS_OWNER' AND revenue_variance_cv > 0.4", "0.3"),
         ("segment_category = 'STUDENT' AND parent_income_stable = 0", "0.5"), other="0.0"),
    _IF("Age < 25", "0.2"), _IF("MonthsEmployed < 12", "0.3")])
add("e8_default_logit", f"SELECT LoanID, {rnd('l', 6)} AS default_logit, {rnd('1 / (1 + exp(-l))', 4)} AS delinquency_prob FROM"
    f" (SELECT LoanID, {_LOGIT} AS l FROM enr)")
_STRESS = rnd(clip(
    f"15 * {max0('DTIRatio - 30')} / 30 + 20 * (1 - ontime_payment_rate_12m) + 15 * credit_utilization_ratio / 100 + 10 *"
    f" {clip('cheque_bounce_count_12m', hi=5)} / 5 + 10 * (subscription_cascade_phase - 1) / 3 + 10 * {clip('p2p_borrow_requests_30d', hi=4)} / 4"
    f" + 10 * {max0('-balance_trajectory_pct')} / 30 + 10 * {max0('healthcare_spending_multiplier - 1')} / 4", 0, 100), 1)
snap("e9_stress_composite", {"financial_stress_score": _STRESS}, src="enr")
_BEHAV = rnd(clip(
    f"20 * (1 - statement_open_rate) + 15 * {clip('password_resets_30d', hi=5)} / 5 + 15 * (subscription_cascade_phase - 1) / 3 + 15 *"
    f" {clip('instant_cashouts_month', hi=5)} / 5 + 10 * {clip('p2p_borrow_requests_30d', hi=4)} / 4 + 10 *"
    f" {max0('-discretionary_spending_change_pct')} / 40 + 15 * {clip('customer_service_calls_30d', hi=5)} / 5", 0, 100), 1)
snap("e10_behavioral_composite", {"behavioral_risk_score": _BEHAV}, src="enr")
_SF = max0("(700 - CreditScore) / 400")
snap("e11_engagement", {"stress_factor": _SF, "digital_engagement_score": rnd(clip(
    f"0.3 * statement_open_rate + 0.3 * (app_login_frequency_month / 20) + 0.2 * (1 - {_SF}) + 0.2 * (notification_dismiss_speed_sec / 10)",
    0, 1) + " * 100", 1)}, src="enr")
snap("e12_display_score", {"risk_score": _DISPLAY})

# --- risk score
for _i, _c in enumerate(COMP, 1):
    snap(f"r{_i}_{_c}", {"component": rnd(COMP[_c], 6), "component_imputed": rnd(COMP_IMPUTED[_c], 6)}, src="feat")
add("r16_weighted_score", "SELECT s.LoanID, s.risk_score_v2, i.risk_score_v2 AS risk_score_imputed FROM scored s JOIN imputed i ON s.LoanID = i.LoanID")
_CONT = case(("risk_score_v2 <= 25", "'SAFE'"), ("risk_score_v2 <= 45", "'LOW RISK'"), ("risk_score_v2 <= 60", "'MODERATE'"),
             ("risk_score_v2 <= 75", "'HIGH RISK'"), ("risk_score_v2 IS NOT NULL", "'CRITICAL'"))
add("r17_classify", f"SELECT LoanID, risk_band, {_by_band('risk_band', _PROB)} AS probability, {_by_band('risk_band', _ACT)} AS action,"
    f" {_CONT} AS contiguous_band FROM imputed")
snap("r18_batch_scoring", {"risk_score_v2": "risk_score_v2", "risk_band": "risk_band", **_COMP4}, src="scored")
add("r19_predict_bands", f"SELECT LoanID, {rnd('ensemble_probability', 4)} AS default_probability, s AS risk_score, "
    + classify("s", "'SAFE'") + f" AS risk_band FROM (SELECT *, {rnd('ensemble_probability * 100', 1)} AS s FROM giv)")
_DISP = lambda s: classify(s, "'SAFE'", [(f"{s} > 100", "'CRITICAL'")])
add("r20_display_bands", f"SELECT LoanID, {_DISP('s')} AS risk_category, {_DISP('w')} AS wide_category FROM (SELECT LoanID, s, s * 1.5 - 20 AS w FROM"
    f" (SELECT LoanID, {_DISPLAY} AS s FROM snap))")
add("r21_top_components", "SELECT LoanID, string_agg(name || ': ' || " + NUM("v", 1) + ", '|' ORDER BY v DESC, pos) AS top_factors FROM"
    " (SELECT *, row_number() OVER (PARTITION BY LoanID ORDER BY v DESC, pos) AS rn FROM (" + " UNION ALL ".join(
        f"SELECT LoanID, '{c}' AS name, {i} AS pos, comp_{c} AS v FROM imputed" for i, c in enumerate(WEIGHTS)) + ")) WHERE rn <= 5 GROUP BY LoanID")

# --- aggregations
_ORDER = "(VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, _, b) in enumerate(BANDS)) + ") AS o(band_order, band)"
add("a1_band_distribution", f"SELECT CAST(band_order AS INTEGER) AS band_order, o.band, coalesce(n, 0) AS n,"
    f" {rnd('coalesce(n, 0) / (SELECT count(*) FROM scored) * 100', 4)} AS pct FROM {_ORDER} LEFT JOIN (SELECT risk_band, count(*) AS n FROM scored"
    " GROUP BY 1) c ON c.risk_band = o.band")
add("a2_value_counts", "SELECT detailed_segment, count(*) AS n FROM snap GROUP BY 1")
add("a3_segment_default_rate", "SELECT EmploymentType, count(*) AS n, " + rnd('avg("Default") * 100', 4) + " AS default_pct FROM enr GROUP BY 1")
add("a4_score_stats", f"SELECT count(risk_score_v2) AS n, {rnd('avg(risk_score_v2)', 4)} AS mean, {rnd('quantile_cont(risk_score_v2, 0.5)', 4)} AS median,"
    f" {rnd('stddev_samp(risk_score_v2)', 4)} AS std FROM imputed")
add("a5_default_rate", 'SELECT count("Default") AS n, count(*) FILTER ("Default" = 1) AS positives, count(*) FILTER ("Default" = 0) AS negatives, '
    + rnd('avg("Default") * 100', 4) + " AS default_pct FROM snap")
add("a6_distinct_count", "SELECT count(DISTINCT detailed_segment) AS n_distinct FROM snap")
_EXPO = lambda x: case((f"{x} >= 1e7", f"'₹' || {NUM(x + ' / 1e7', 1)} || 'Cr'"), (f"{x} >= 1e5", f"'₹' || {NUM(x + ' / 1e5', 1)} || 'L'"),
                       other=f"'₹' || {MONEY(x)}")
add("a7_kpis", f"SELECT total, at_risk, {NUM('at_risk / greatest(total, 1) * 100', 1)} || '% of portfolio' AS at_risk_text, {rnd('e', 2)} AS exposure,"
    f" {_EXPO('e')} AS exposure_text, {rnd('m', 4)} AS mean_score FROM (SELECT count(*) AS total, count(*) FILTER (risk_band IN ('MODERATE',"
    " 'HIGH RISK', 'CRITICAL')) AS at_risk, sum(LoanAmount) FILTER (risk_band IN ('MODERATE', 'HIGH RISK', 'CRITICAL')) AS e, avg(risk_score_v2)"
    " AS m FROM scored)")
add("a8_exposure_text", f"SELECT customer_id, {_EXPO('e')} AS text, {_EXPO('(e / 100)')} AS small_text FROM (SELECT customer_id,"
    f" {rnd('sum(LoanAmount)', 2)} AS e FROM snap GROUP BY 1)")
add("a9_crosstab", "SELECT segment_category, " + ", ".join(
    f"count(*) FILTER (risk_band = '{b}') AS {b.lower().replace(' ', '_')}" for _, _, b in BANDS) + " FROM imputed GROUP BY 1")
_EDGES = [("SAFE", 0, 25), ("LOW RISK", 25, 45), ("MODERATE", 45, 60), ("HIGH RISK", 60, 75), ("CRITICAL", 75, 100)]
add("a10_score_histogram", "SELECT band, CAST(b AS INTEGER) AS bin_start, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS band, {lo} + least(floor((s - {lo}) / 5), {(hi - lo) // 5 - 1}) * 5 AS b FROM (SELECT round_even(risk_score_v2, 0) AS s FROM"
    f" imputed) WHERE s BETWEEN {lo} AND {hi}" for b, lo, hi in _EDGES) + ") GROUP BY 1, 2")
add("a11_scenario_counts", "SELECT scenario, count(*) AS n FROM res WHERE scenario IS NOT NULL GROUP BY 1")
_MON = ("SELECT total, interventions, " + rnd("interventions / total * 100", 4) + " AS rate_pct, prevented, interventions * 50 AS cost,"
        " prevented * 8000 - interventions * 50 AS savings, " + rnd("(prevented * 8000 - interventions * 50) / greatest(interventions * 50, 1) * 100", 4)
        + " AS roi_pct FROM (SELECT *, CAST(floor(interventions * 0.72) AS BIGINT) AS prevented FROM (SELECT (SELECT count(*) FROM scored) AS total,"
        " (SELECT count(*) FROM outreach) AS interventions))")
add("a12_monitoring", _MON)
add("daily_workflow", _MON)
add("a13_service_roi", "SELECT n AS interventions, CAST(floor(n * 0.7) AS BIGINT) AS projected_prevented_defaults, "
    + rnd("(n * 8000 - n * 50) / greatest(n * 50, 1) * 100", 1) + " AS projected_roi_percent FROM (SELECT count(*) AS n FROM outreach)")
add("a14_prediction_log_stats", "SELECT count(*) AS total_predictions, coalesce(" + rnd("avg(s) FILTER (s <> 0)", 2) + ", 0.0) AS avg_risk_score, "
    + ", ".join(f"count(*) FILTER (risk_band = '{b}') AS n_{b.lower().replace(' ', '_')}" for _, _, b in BANDS)
    + ", arg_max(LoanID, k) AS latest_loan, arg_max(risk_band, k) AS latest_band FROM (SELECT LoanID, risk_band, CASE WHEN LoanID % 10 > 0 THEN"
    " risk_score_v2 ELSE 0.0 END AS s, {'t': event_timestamp, 'l': LoanID} AS k FROM scored)")
add("a14_log_retention", "SELECT LoanID, event_timestamp AS ts, risk_band FROM scored WHERE event_timestamp >= TIMESTAMP '1996-01-01'")
snap("a15_row_aggregates", {"total": rnd(" + ".join(EXPENSES), 2), "std": rnd(row_std(EXPENSES), 4)})
_LIN = {"CreditScore": "-0.006", "DTIRatio": "0.025", "ontime_payment_rate_12m": "-2.0", "max_dpd_last_12m": "0.03", "avg_delay_days": "0.02"}
_MEANS = "SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _LIN) + " FROM snap"
_BASE = "3.0 + " + " + ".join(f"{b} * m_{c}" for c, b in _LIN.items())
_PROBA = "1 / (1 + exp(-(" + _BASE + " + " + " + ".join(f"{b} * ({c} - m_{c})" for c, b in _LIN.items()) + ")))"
_CONTRIB = {"mn": _MEANS, "con": " UNION ALL ".join(
    f"SELECT LoanID, {_BASE} AS base, {_PROBA} AS prob, '{c}' AS feature, {i} AS pos, {b} * ({c} - m_{c}) AS impact, CAST({c} AS DOUBLE) AS x FROM snap, mn"
    for i, (c, b) in enumerate(_LIN.items()))}
for _n in ("a16_mean_abs_contribution", "m19_global_importance"):
    add(_n, f"SELECT feature, {rnd('avg(abs(impact))', 6)} AS mean_abs_impact FROM con GROUP BY 1", _CONTRIB)
add("m17_linear_contributions", f"SELECT LoanID, {rnd('base', 6)} AS base_value, {rnd('prob', 6)} AS risk_probability, feature,"
    f" {rnd('impact', 6)} AS impact, x AS value FROM con", _CONTRIB)



def _expected(tree: list, node: int, known: tuple) -> str:
    """A given tree's value where only the features ``known`` are: both sides by their covers where one is not."""
    if len(tree[node]) == 2:
        return f"({tree[node][0]})"
    feature, cut, left, right, cover = tree[node]
    a, b = _expected(tree, left, known), _expected(tree, right, known)
    if feature in known:
        return f"(CASE WHEN x_{feature} <= {cut} THEN {a} ELSE {b} END)"
    return f"({tree[left][-1]} * {a} + {tree[right][-1]} * {b}) / {cover}"


def _given_trees() -> tuple[str, dict]:
    """Shapley values by their definition: over all sets of the other features."""
    from forewarn.catalog import GIVEN_FEATURES, GIVEN_TREES
    sets = [s for k in range(len(GIVEN_FEATURES) + 1) for s in combinations(GIVEN_FEATURES, k)]
    name = {s: "v_" + "_".join(s) for s in sets}
    values = ", ".join(f"-1.0 + {' + '.join(_expected(t, 0, s) for t in GIVEN_TREES)} AS {name[s]}" for s in sets)
    inputs = ", ".join(f"coalesce(CAST({c} AS DOUBLE), -999.0) AS x_{c}" for c in GIVEN_FEATURES)
    n = len(GIVEN_FEATURES)
    parts = []
    for f in GIVEN_FEATURES:
        terms = [f"({name[tuple(g for g in GIVEN_FEATURES if g in s or g == f)]} - {name[s]}) * {factorial(len(s)) * factorial(n - 1 - len(s))} / {factorial(n)}.0"
                 for s in sets if f not in s]
        parts.append(f"SELECT LoanID, {rnd(name[()], 6)} AS base_value, '{f}' AS feature, {rnd(' + '.join(terms), 6)} AS impact FROM gtv")
    return " UNION ALL ".join(parts), {"gti": f"SELECT LoanID, {inputs} FROM snap", "gtv": f"SELECT LoanID, {values} FROM gti"}


add("m17_given_tree_contributions", *_given_trees())

# --- windows, top-k, splits
add("w1_band_top_list", "SELECT LoanID, risk_band, risk_score_v2, CAST(rn AS INTEGER) AS rank, band_total, band_total > 40 AS has_more FROM (SELECT *,"
    " row_number() OVER (PARTITION BY risk_band ORDER BY risk_score_v2 DESC NULLS LAST, LoanID) AS rn, count(*) OVER (PARTITION BY risk_band) AS"
    " band_total FROM imputed) WHERE rn <= 40")
_SIDE = lambda sign, n: (f"(SELECT LoanID, string_agg(feature || '=' || CAST(CAST({rnd('impact', 4)} AS DECIMAL(20,4)) AS VARCHAR), '|' ORDER BY"  # noqa: E731
                         f" impact * {sign} DESC, pos) AS t FROM (SELECT *, row_number() OVER (PARTITION BY LoanID ORDER BY impact * {sign} DESC, pos)"
                         f" AS rn FROM con WHERE impact * {sign} > 0) WHERE rn <= 2 GROUP BY LoanID) {n}")
add("w2_top_contributions", "SELECT s.LoanID, coalesce(u.t, '') AS up, coalesce(d.t, '') AS down FROM snap s LEFT JOIN " + _SIDE(1, "u")
    + " ON s.LoanID = u.LoanID LEFT JOIN " + _SIDE(-1, "d") + " ON s.LoanID = d.LoanID", _CONTRIB)
add("w3_top_importance", f"SELECT feature, importance, {rnd('importance / (SELECT max(importance) FROM imp)', 6)} AS scaled FROM imp ORDER BY importance"
    " DESC, feature LIMIT 30", {"imp": f"SELECT CAST(l_partkey AS VARCHAR) AS feature, {rnd('sum(l_extendedprice)', 2)} AS importance FROM lineitem GROUP BY 1"})
_FACT = [("DTI Ratio", "DTIRatio", (30, 45, 60), "<=", NUM("DTIRatio", 1) + " || '%'"),
         ("Computed DTI", "dti2", (35, 50, 70), "<=", NUM("dti2", 1) + " || '%'"),
         ("Credit Score", "CreditScore", (750, 650, 550), ">=", NUM("CreditScore")),
         ("On-time Payments", "ontime_payment_rate_12m", (0.95, 0.85, 0.70), ">=", NUM("ontime_payment_rate_12m * 100") + " || '%'"),
         ("Savings Rate", "savings_rate", (15, 8, 3), ">=", NUM("savings_rate", 1) + " || '%'"),
         ("Credit Utilization", "credit_utilization_ratio", (30, 60, 80), "<=", NUM("credit_utilization_ratio") + " || '%'"),
         ("Total Debt / Assets", "tda", (0.4, 0.7, 0.9), "<=", NUM("tda", 2)),
         ("Behavioral Risk", "brs", (30, 50, 70), "<=", NUM("brs")),
         ("Peer Default Rate", "peer_default_rate", (0.05, 0.15, 0.30), "<=", NUM("peer_default_rate * 100", 1) + " || '%'"),
         ("Financial Stress", "fss", (30, 50, 70), "<=", NUM("fss")),
         ("Employer Risk", "erm", (1.2, 1.5, 2.0), "<=", NUM("erm", 2) + " || 'x'"),
         ("Income Stability", "isi2", (70, 50, 30), ">=", NUM("isi2"))]
_FX = {"ff": f"SELECT *, {_STRESS} AS fss, {_BEHAV} AS brs, {FEATURES['computed_dti']} AS dti2, {FEATURES['isi']} AS isi2,"
             f" {FEATURES['employer_risk_multiplier']} AS erm, total_outstanding_debt / 400000 AS tda FROM enr",
       "fl": " UNION ALL ".join(
           f"SELECT LoanID, {i} AS p, '{lab}' AS label, {txt} AS value, CASE WHEN {c} {op} {t[0]} THEN 0 WHEN {c} {op} {t[1]} THEN 1 WHEN {c} {op}"
           f" {t[2]} THEN 2 ELSE 3 END AS sev FROM ff WHERE {c} IS NOT NULL" for i, (lab, c, t, op, txt) in enumerate(_FACT)),
       "fr": "SELECT *, row_number() OVER (PARTITION BY LoanID ORDER BY sev DESC, p) - 1 AS pos, CASE sev WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2"
             " THEN 'Warning' ELSE 'Critical' END AS severity FROM fl"}
add("w4_top_factors", "SELECT LoanID, string_agg(severity || ':' || label, '|' ORDER BY pos) AS factors FROM fr WHERE pos < 8 GROUP BY LoanID", _FX)
add("c11_why_this_score", "SELECT LoanID, CAST(pos AS INTEGER) AS pos, label, value, severity, least(greatest((sev + 1) / 4 * 100, 15.0), 100.0) AS"
    " bar_pct FROM fr WHERE pos < 8", _FX)
_TOT = {"transaction_count": "transaction_count", "total_credits": Z("total_credits"), "total_debits": Z("total_debits"),
        "current_balance_estimate": Z("current_balance_estimate"), "payment_failures": "failures_all", "healthcare_spend": Z("healthcare_spend"),
        "last_salary_date": "last_salary_date", "baseline_monthly_income": "baseline_monthly_income"}
add("w5_running_totals", f"SELECT event_id, customer_id, {cols(_TOT)} FROM tot")
add("w6_consecutive_failures", "SELECT event_id, consecutive_failures FROM tot")
for _n in ("t2_stream_totals", "t2_batch_totals", "t2_ordered_totals"):
    add(_n, f"SELECT event_id, customer_id, {cols({**_TOT, 'consecutive_failures': 'consecutive_failures'})} FROM tot")
add("w7_random_subsample", "SELECT LoanID, LoanAmount FROM snap ORDER BY LoanID * 7919 % 100003, LoanID LIMIT 1000")
add("w8_stratified_split", 'SELECT LoanID, "Default", CASE WHEN row_number() OVER (PARTITION BY "Default" ORDER BY LoanID * 7919 % 100003, LoanID) <='
    ' floor(count(*) OVER (PARTITION BY "Default") * 0.8) THEN 1 ELSE 0 END AS is_train FROM snap')

# --- account profiles
add("n1_flatten_accounts", _FLAT)
add("n2_profile_rollup", _ROLLUP)
add("n2_account_rollup", _ROLLUP)
add("n3_assemble_profiles", "SELECT customer_id, CAST(0 AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_accounts, string_agg(fip_id, ',' ORDER BY"
    f" account_key) AS banks, {rnd('sum(coalesce(balance, 0.0))', 4)} AS balance FROM acct GROUP BY 1")
add("n4_tax_income", f"SELECT CAST(c_custkey AS VARCHAR) AS customer_id, {rnd('c_acctbal * 12 * 1.05', 2)} AS income_2023_24, CAST(NULL AS DOUBLE) AS"
    " income_1999_00, CAST(2 AS BIGINT) AS years FROM customer")
add("n5_primary_and_funds", "SELECT p.customer_id, fip_id, balance, fund_value FROM (SELECT customer_id, arg_min(CASE WHEN account_type = 'SAVINGS' THEN"
    " fip_id END, CASE WHEN account_type = 'SAVINGS' THEN account_key END) AS fip_id, arg_min(CASE WHEN account_type = 'SAVINGS' THEN balance END, CASE"
    " WHEN account_type = 'SAVINGS' THEN account_key END) AS balance FROM acct GROUP BY 1) p JOIN (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, "
    + rnd("0.0 + c_acctbal * 2 + CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal * 3 ELSE 0.0 END", 2) + " AS fund_value FROM customer) f ON p.customer_id ="
    " f.customer_id")

# --- scenarios and outreach
for _i, _n in enumerate(("cash_businessman", "student_family", "multiple_loans", "retired_healthcare", "gig_suspension", "employer_layoff"), 1):
    snap(f"c{_i}_{_n}", scenario_cols(_i), src="feat")
add("c7_first_match", "SELECT LoanID, risk_band, final_band, scenario, scenario_reason FROM res")
add("c8_interventions", "SELECT LoanID, risk_band, risk_score, channel, timing, scenario FROM outreach")
snap("c9_messages", {"message": message("risk_band")}, src="imputed")
_DA = {"SAFE": ("No action needed", "success"), "LOW RISK": ("Send wellness tips within 48h", "info"),
       "MODERATE": ("Proactive outreach — offer restructuring", "warning"), "HIGH RISK": ("Urgent call — restructuring + holiday", "danger"),
       "CRITICAL": ("Immediate intervention — emergency loan", "danger")}
snap("c10_display_action", {"text": _by_band("risk_band", {k: v[0] for k, v in _DA.items()}),
                            "colour": _by_band("risk_band", {k: v[1] for k, v in _DA.items()})}, src="imputed")
add("c12_customer_card", f"SELECT LoanID, concat_ws('|', 'Income: ₹' || {MONEY('Income')}, 'Loan: ₹' || {MONEY('LoanAmount')}, 'Credit Score: ' ||"
    f" {NUM('CreditScore')}, 'DTI: ' || {NUM('DTIRatio', 1)} || '%', 'On-time Rate: ' || {NUM('ontime_payment_rate_12m * 100')} || '%', CASE WHEN"
    f" LoanID % 4 > 0 THEN 'Savings: ' || {NUM('savings_rate', 1)} || '%' END) AS card FROM enr")

# --- transaction alerts
add("t1_clean_events", "SELECT event_id, customer_id, CASE WHEN event_id % 3 > 0 THEN type ELSE 'debit' END AS type, CASE WHEN event_id % 5 > 0 THEN amount"
    " ELSE 0.0 END AS amount, CASE WHEN event_id % 7 > 0 THEN category ELSE 'other' END AS category, ts, CASE WHEN event_id % 11 > 0 THEN monthly_income"
    " ELSE 50000.0 END AS monthly_income FROM txn WHERE event_id % 50 > 0")
for _n, _r in (("t3_large_expense", "r1"), ("t4_consecutive_failures", "r2"), ("t5_healthcare_spike", "r3")):
    add(_n, f"SELECT event_id, {_r} AS reason FROM ale WHERE {_r} IS NOT NULL")
for _n in ("t7_balance_drop", "t7_stream_balance_drop"):
    add(_n, "SELECT customer_id, day, previous, balance FROM (SELECT *, lag(balance) OVER (PARTITION BY customer_id ORDER BY day) AS previous"
        " FROM (SELECT customer_id, day, round(sum(net) OVER (PARTITION BY customer_id ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS balance FROM"
        f" (SELECT customer_id, date_trunc('day', ts) AS day, {_SIGNED} AS net FROM txn GROUP BY 1, 2))) WHERE previous > 0 AND (previous - balance) /"
        " previous > 0.4")
add("t7_late_salary", "SELECT * FROM (SELECT customer_id, period AS month, paid, CAST(date_diff('day', period, paid) AS INTEGER) AS delay_days FROM ("
    + _PER("type = 'salary'", "month", "min(ts) AS paid") + ")) WHERE delay_days > 5")
# months whose salary had not come by the sixth, of customers seen before that
_PAID = "SELECT customer_id, date_trunc('month', ts) AS month, min(ts) AS paid FROM txn WHERE type = 'salary' GROUP BY 1, 2"
_OVERDUE = lambda until, cols: (
    f"SELECT s.customer_id, s.month{cols} FROM (SELECT customer_id, first_seen, unnest(generate_series(date_trunc('month', first_seen),"
    f" date_trunc('month', {until}), INTERVAL 1 MONTH)) AS month FROM (SELECT customer_id, min(ts) AS first_seen FROM txn GROUP BY 1)) s"
    f" LEFT JOIN ({_PAID}) p ON p.customer_id = s.customer_id AND p.month = s.month WHERE s.month + INTERVAL 6 DAY <= {until}"
    " AND s.first_seen < s.month + INTERVAL 6 DAY AND (p.paid IS NULL OR p.paid >= s.month + INTERVAL 6 DAY)")
add("t7_overdue_salary", _OVERDUE("TIMESTAMP '2024-02-29'", ", p.paid"))
add("t7_stream_overdue_salary", _OVERDUE("(SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY FROM txn)", ""))
add("t8_rolling_healthcare", "SELECT customer_id, event_id, ts, " + Z("sum(CASE WHEN category = 'healthcare' THEN amount ELSE 0.0 END) OVER (PARTITION BY"
    " customer_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)") + " AS healthcare_spend_30d FROM txn")

_DAY = "date_trunc('day', ts)"
add("t8_stream_windows", "SELECT customer_id, w AS window_start, w + INTERVAL 2 DAY AS window_end, " + rnd("sum(amount)", 2) + " AS healthcare_spend_30d"
    f" FROM (SELECT customer_id, ts, amount, {_DAY} AS w FROM txn WHERE category = 'healthcare' UNION ALL SELECT customer_id, ts, amount, {_DAY} -"
    " INTERVAL 1 DAY AS w FROM txn WHERE category = 'healthcare') GROUP BY 1, 2")

# --- models
_NUMERIC = [c for c in SNAPSHOT if c not in ("LoanID", "customer_id", "event_timestamp", "segment_category", "Default", "detailed_segment")]
_NUMERIC += ["total_monthly_expense", *[c for c in FEATURES if not c.endswith("_band")], *CROSS_SNAP]
add("m1_feature_preparation", f"SELECT LoanID, CAST({len(_NUMERIC) + 2} AS INTEGER) AS n_features, "
    + rnd("dense_rank() OVER (ORDER BY segment_category) - 1 + dense_rank() OVER (ORDER BY detailed_segment) - 1 + "
          + " + ".join(f"coalesce(CAST({c} AS DOUBLE), -999.0)" for c in _NUMERIC), 4) + " AS total FROM feat")
add("m2_class_weights", "SELECT pos, neg, " + rnd("neg / pos", 6) + " AS scale_pos_weight, " + rnd("(pos + neg) / (2 * pos)", 6) + " AS balanced_pos, "
    + rnd("(pos + neg) / (2 * neg)", 6) + ' AS balanced_neg FROM (SELECT count(*) FILTER ("Default" = 1) AS pos, count(*) FILTER ("Default" = 0) AS neg'
    " FROM snap)")
add("m8_weighted_ensemble", "SELECT LoanID, ensemble_probability FROM giv")


def auc(score):
    cnt = f"SELECT {score} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM giv GROUP BY 1"
    return (f"SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN"
            f" UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({cnt}))")


add("m11_roc_auc", f"SELECT {rnd('(' + auc('ensemble_probability') + ')', 8)} AS auc FROM (SELECT count(*) FROM giv)")
_PR = {"cnt": "SELECT ensemble_probability AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM giv GROUP BY 1",
       "cur": "SELECT s AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM cnt WINDOW w AS (ORDER BY s ROWS BETWEEN"
              " CURRENT ROW AND UNBOUNDED FOLLOWING)",
       "prc": "SELECT threshold, tp / (tp + fp) AS precision, tp / p AS recall, 2 * (tp / (tp + fp) * (tp / p)) / (tp / (tp + fp) + tp / p + 1e-8) AS f1 FROM cur"}
add("m12_precision_recall", "SELECT threshold, " + ", ".join(f"{rnd(c, 8)} AS {c}" for c in ("precision", "recall", "f1")) + " FROM prc", _PR)
add("m12_best_f1_threshold", f"SELECT threshold, {rnd('f1', 8)} AS f1 FROM prc ORDER BY prc.f1 DESC, threshold LIMIT 1", _PR)
_CC = {"th": "SELECT 0.1 + i * (0.1 + 0.01 - 0.1) AS t FROM range(80) r(i)",
       "cc": "SELECT t, count(*) FILTER (y = 0 AND ensemble_probability >= t) AS fp, count(*) FILTER (y = 1 AND ensemble_probability < t) AS fn FROM th"
             " CROSS JOIN giv GROUP BY t"}
add("m13_cost_curve", f"SELECT {rnd('t', 6)} AS threshold, fp, fn, fp * 50 + fn * 8000 AS cost FROM cc", _CC)
add("m13_best_cost_threshold", f"SELECT {rnd('t', 6)} AS threshold, cost FROM (SELECT t, fp * 50 + fn * 8000 AS cost FROM cc) ORDER BY cost, t LIMIT 1", _CC)
_CM = "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in (
    ("tn", "y = 0 AND ensemble_probability < 0.5"), ("fp", "y = 0 AND ensemble_probability >= 0.5"), ("fn", "y = 1 AND ensemble_probability < 0.5"),
    ("tp", "y = 1 AND ensemble_probability >= 0.5"))) + " FROM giv"
add("m14_confusion", _CM)
_CR = {"cm": _CM,
       "m": "SELECT *, tn + fp AS n0, fn + tp AS n1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,"
            " coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, (tn + tp) / (tn + fp + fn + tp) AS acc FROM cm",
       "f": "SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM m"}
add("m14_classification_report", " UNION ALL ".join(
    f"SELECT '{lab}' AS label, {rnd(p, 6)} AS precision, {rnd(r, 6)} AS recall, {rnd(x, 6)} AS f1, {s} AS support FROM f" for lab, p, r, x, s in (
        ("No Default", "p0", "r0", "f0", "n0"), ("Default", "p1", "r1", "f1", "n1"), ("accuracy", "acc", "acc", "acc", "n0 + n1"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n0 + n1"),
        ("weighted avg", "(p0 * n0 + p1 * n1) / (n0 + n1)", "(r0 * n0 + r1 * n1) / (n0 + n1)", "(f0 * n0 + f1 * n1) / (n0 + n1)", "n0 + n1"))), _CR)
add("m15_model_comparison", " UNION ALL ".join(
    f"SELECT '{n}' AS model, {rnd('(' + auc(c) + ')', 8)} AS auc, {w} AS weight" for n, c, w in (
        *((n, f"p_{n}", w) for n, w in MODEL_WEIGHTS.items()), ("ENSEMBLE", "ensemble_probability", "1.0"))))
