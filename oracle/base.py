"""Common table expressions and small text helpers for the SQL twins."""

from __future__ import annotations

import re

from forewarn.sources.adapters import ACCOUNT, ENRICHED, LINE_TOTALS, SNAPSHOT, TXN

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def dbl(sql: str) -> str:
    """Decimal literals as doubles; quoted text stays untouched."""
    parts = sql.split("'")
    return "'".join(_DECIMAL.sub(r"\1e0", p) if i % 2 == 0 else p for i, p in enumerate(parts))


def cols(exprs: dict) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())


def clip(x, lo=None, hi=None):
    inner = f"({x})"
    if lo is not None:
        inner = f"greatest({inner}, CAST({lo} AS DOUBLE))"
    if hi is not None:
        inner = f"least({inner}, CAST({hi} AS DOUBLE))"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {inner} END)"


def rnd(x, digits=0):
    return f"round_even({x}, 0)" if digits == 0 else f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def div(a, b, floor=1):
    return f"(({a}) / {clip(b, lo=floor)})"


def max0(x):
    return f"greatest(0e0, {x})"


def cut(x, edges, labels):
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(edges, edges[1:], labels))
    return f"(CASE {arms} END)"


def case(*arms, other="NULL"):
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {other} END)"


LI = f"SELECT l_orderkey, {cols(LINE_TOTALS)} FROM lineitem GROUP BY l_orderkey"
SNAP = (f"SELECT *, {ENRICHED['total_monthly_expense']} AS total_monthly_expense FROM (SELECT {cols(SNAPSHOT)} FROM orders "
        "JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey)")
ENR = "SELECT *, " + cols({k: v for k, v in ENRICHED.items() if k != "total_monthly_expense"}) + " FROM snap"
TXN_CTE = f"SELECT {cols(TXN)} FROM events"
ACCT = f"SELECT {cols(ACCOUNT)} FROM orders"

EXPENSES = ["expense_housing", "expense_food_groceries", "expense_transportation", "expense_healthcare",
            "expense_lifestyle_entertainment", "expense_discretionary_vices"]
EMI = "(LoanAmount / CASE WHEN LoanTerm IS NOT NULL THEN greatest(LoanTerm, 1) END)"


def row_std(names):
    mean = f"(({' + '.join(names)}) / {len(names)}.0)"
    dev = " + ".join(f"(({n} - {mean}) * ({n} - {mean}))" for n in names)
    return f"sqrt(({dev}) / {len(names) - 1}.0)"


# each formula: alias -> text, in an order where later ones may use earlier aliases
FEATURES = {
    "isi": rnd(clip(case(*[(f"segment_category = '{s}'", v) for s, v in (
        ("SALARIED_PRIVATE", "0.05"), ("SALARIED_GOVT", "0.02"), ("BUSINESS_OWNER", "0.35"), ("SELF_EMPLOYED", "0.40"),
        ("GIG_WORKER", "0.45"), ("RETIRED", "0.02"), ("STUDENT", "0.50"))], other="0.20") + " * 100", 0.5, 100), 2),
    "isi_band": cut("isi", [-1, 10, 25, 50, 200], ["Very Stable", "Stable", "Moderate Volatility", "High Volatility"]),
    "computed_dti": rnd(clip(div(
        "LoanAmount * 0.01 * pow(1.0 + 0.01, greatest(LoanTerm, 1)) / (pow(1.0 + 0.01, greatest(LoanTerm, 1)) - 1)",
        "Income") + " * 100", 0, 200), 2),
    "dti_band": cut("computed_dti", [-1, 30, 40, 50, 200], ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"]),
    "savings_rate_pct": rnd(clip(div("avg_monthly_balance_6m", "Income") + " * 100", 0, 500), 2),
    "savings_band": cut("savings_rate_pct", [-1, 5, 10, 20, 1000], ["Poor", "Fair", "Good", "Excellent"]),
    "eci": rnd(clip(div("Income - (expense_housing + expense_food_groceries + expense_transportation"
                        f" + expense_healthcare) - {EMI}", EMI), -2, 10), 3),
    "eci_band": cut("eci", [-10, 0.5, 1, 2, 100], ["Critical", "Tight", "Moderate", "Safe"]),
    "evs": rnd(row_std(EXPENSES)),
    "evs_ratio": rnd(div("evs", "total_monthly_expense"), 3),
    "sdt": case(("segment_category = 'EMPLOYED'", rnd(clip("salary_delay_days + 0.0", 0, 30), 1))),
    "sdt_band": case(("sdt IS NULL", "'N/A'"), ("sdt <= 0", "'Perfect'"), ("sdt <= 2", "'Normal'"),
                     ("sdt <= 5", "'Warning'"), other="'Critical'"),
    "cdps": case(("segment_category = 'BUSINESS_OWNER'", rnd(clip("cash_deposit_consistency_score", 0, 100), 1))),
    "cash_sufficiency_ratio": case(("segment_category = 'BUSINESS_OWNER'",
                                    rnd(clip(div("cash_deposit_avg_amount", EMI), 0, 10), 3))),
    "cdps_band": case(("cdps IS NULL", "'N/A'"), ("cdps >= 80", "'Consistent'"), ("cdps >= 50", "'Mixed'"),
                      other="'Irregular'"),
    "dsr": rnd(clip(div("expense_lifestyle_entertainment + 0.0 + 0.0 + expense_discretionary_vices",
                        "total_monthly_expense") + " * 100", 0, 100), 2),
    "dsr_band": cut("dsr", [-1, 10, 15, 30, 100], ["Stressed", "Low", "Normal", "High"]),
    "ptc": rnd("payment_day_consistency", 3),
    "ptc_band": cut("ptc", [-1, 0.7, 0.9, 1.01], ["Inconsistent", "Moderate", "Consistent"]),
    "abt": rnd(clip("-(DTIRatio / 100 - CreditScore / 900 * 0.5) + 0.0", -0.5, 0.5), 4),
    "abt_band": case(("abt > 0.05", "'Building Reserves'"), ("abt > -0.05", "'Stable'"), ("abt > -0.15", "'Declining'"),
                     other="'Depleting'"),
    "subscription_cascade_score": case(("subscription_cascade_phase = 1", "0.25"), ("subscription_cascade_phase = 2", "0.5"),
                                       ("subscription_cascade_phase = 3", "0.75"), other="0.95"),
    "wallet_velocity": rnd("(instant_cashouts_month + p2p_borrow_requests_30d + 0.0) / 10", 3),
    "wallet_velocity_band": case(("wallet_velocity < 0.3", "'Normal'"), ("wallet_velocity < 0.6", "'Moderate Stress'"),
                                 other="'High Stress'"),
    "merchant_downgrade_score": "CAST(" + clip(rnd("(DTIRatio / 100 + (1 - CreditScore / 900)) * 3 + 0.0"), 0, 10) + " AS INTEGER)",
    "merchant_downgrade_band": case(("merchant_downgrade_score <= 2", "'Mild'"), ("merchant_downgrade_score <= 5", "'Moderate'"),
                                    other="'Severe'"),
    "healthcare_current_spend": rnd(clip("expense_healthcare", lo=1) + " * healthcare_multiplier"),
    "healthcare_spike_ratio": rnd("healthcare_current_spend / " + clip("expense_healthcare", lo=1), 2),
    "healthcare_spike_band": case(("healthcare_spike_ratio < 2", "'Normal'"), ("healthcare_spike_ratio < 3", "'Moderate'"),
                                  other="'Emergency'"),
    "employer_risk_multiplier": rnd(clip(
        "1.0 + coalesce(peer_default_rate, 0.0) * 1.5 + CASE WHEN coalesce(industry_stress_index, 30.0) / 100 > 0.5"
        " THEN 0.3 ELSE 0.0 END", 1, 2.5), 3),
    "gig_cv_band": case(("income_cv_daily IS NULL", "'N/A'"), ("income_cv_daily < 0.3", "'Stable for Gig'"),
                        ("income_cv_daily < 0.6", "'Normal Variance'"), ("income_cv_daily < 1.0", "'High Variance'"),
                        other="'Extreme'"),
}


def cross(c) -> dict:
    """``c(name, default)`` gives the column with default, or the default where it is absent."""
    stress = (f"{c('computed_dti', '30.0')} / 50 * 0.25 + (1 - {c('savings_rate_pct', '20.0')} / 50) * 0.20"
              f" + (1 - {clip(c('eci', '1.0'), -1, 3)} / 3) * 0.20 + {c('evs_ratio', '0.2')} * 0.15"
              f" + {c('behavioral_risk_score', '0.3')} * 0.20")
    return {
        "income_per_dependent": rnd(div("Income", c("num_dependents", "0.0") + " + 1")),
        "emi_to_savings_ratio": rnd(clip(div(EMI, "avg_monthly_balance_6m"), 0, 50), 3),
        "total_debt_to_assets": rnd(clip(div(c("total_outstanding_debt", "0.0"), c("total_assets", "1.0")), 0, 100), 4),
        "credit_score_x_dti": rnd("CreditScore * DTIRatio / 100", 2),
        "credit_score_x_util": rnd(f"CreditScore * {c('credit_utilization_ratio', '40.0')} / 100", 2),
        "credit_lines_per_year": rnd(div(c("NumCreditLines", "2"), c("oldest_credit_line_years", "5.0"), 0.5), 2),
        "bounce_per_credit_line": rnd(div(c("cheque_bounce_count_12m", "0.0"), c("NumCreditLines", "1")), 3),
        "auto_debit_x_ontime": rnd(f"{c('auto_debit_success_rate', '0.9')} * {c('ontime_payment_rate_12m', '0.9')}", 4),
        "income_stability_x_dti": rnd(f"{c('isi', '15.0')} * DTIRatio", 3),
        "age_x_credit_score": rnd(f"{c('Age', '30')} * CreditScore / 100", 2),
        "digital_engagement_score": rnd(
            f"{c('app_login_frequency_month', '10.0')} * 0.3 + {c('statement_open_rate', '0.5')} * 30"
            f" + (1 - {c('notification_dismiss_speed_sec', '5.0')} / 30) * 10", 2),
        "financial_stress_index": rnd(clip(stress, 0, 1), 4),
        "months_of_runway": rnd(clip(div(c("total_financial_assets", "100000.0"), "total_monthly_expense"), 0, 120), 1),
        "loan_burden_score": rnd(clip(div("LoanAmount", "Income * 12") + " * 100", 0, 500), 2),
    }


ABSENT_IN_SNAPSHOT = {"num_dependents", "total_outstanding_debt", "total_assets", "credit_utilization_ratio",
                      "cheque_bounce_count_12m", "auto_debit_success_rate", "app_login_frequency_month",
                      "statement_open_rate", "notification_dismiss_speed_sec", "behavioral_risk_score",
                      "total_financial_assets"}
CROSS_SNAP = cross(lambda n, d: d if n in ABSENT_IN_SNAPSHOT else f"coalesce({n}, {d})")
CROSS_FULL = cross(lambda n, d: f"coalesce({n}, {d})")

FEAT = f"SELECT *, {cols(FEATURES)}, {cols(CROSS_SNAP)} FROM snap"

WEIGHTS = {"income_stability": 0.12, "debt_burden": 0.15, "savings_adequacy": 0.08, "payment_history": 0.12,
           "emi_cushion": 0.08, "expenditure_pattern": 0.07, "cash_flow": 0.05, "credit_score_adj": 0.07,
           "employer_health": 0.05, "healthcare_costs": 0.03, "network_risk": 0.02, "behavioral_signals": 0.05,
           "life_events": 0.04, "age_vintage": 0.02, "external_factors": 0.05}


def components(v) -> dict:
    """``v(name, default)``: the column, in the imputed form with its default for missing values."""
    isi = f"(CASE WHEN {v('isi', '15.0')} < 2 THEN {v('isi', '15.0')} * 100 ELSE {v('isi', '15.0')} END)"
    dti, spike = v("computed_dti", "30.0"), f"coalesce({v('healthcare_spike_ratio', '1.0')}, 1.0)"
    seg = v("segment_category", "'EMPLOYED'")
    sr, sdt = v("healthcare_spike_ratio", "1.0"), v("sdt", "0.0")
    ind = v("industry_stress_index", "30.0")
    return {
        "income_stability": case((f"{isi} < 10", "10.0"), (f"{isi} < 25", "30.0"), (f"{isi} < 50", "60.0"), other="90.0"),
        "debt_burden": case((f"{dti} < 30", "15.0"), (f"{dti} < 40", "40.0"), (f"{dti} < 50", "70.0"), other="95.0"),
        "savings_adequacy": clip(f"100 - {v('savings_rate_pct', '20.0')}", 0, 100),
        "payment_history": clip(f"(1 - {v('ontime_payment_rate_12m', '0.95')}) * 50 + {clip(v('avg_delay_days', '0.0'), hi=30)}"
                                f" * 1.5 + {v('num_dpd_30_plus', '0')} * 5", 0, 100),
        "emi_cushion": clip(f"100 * (1 - {v('eci', '1.0')} / 2)", 0, 100),
        "expenditure_pattern": clip(f"{v('evs_ratio', '0.2')} * 50 + {max0('30 - ' + v('dsr', '20.0'))} * 2", 0, 100),
        "cash_flow": case((f"coalesce({seg} <> 'BUSINESS_OWNER', true)", "0.0"), (f"{v('cdps', '70.0')} IS NULL", "30.0"),
                          other=clip(f"{max0('100 - ' + v('cdps', '70.0'))} * 0.6 + "
                                     f"{max0('1.5 - ' + v('cash_sufficiency_ratio', '1.2'))} * 40", 0, 100)),
        "credit_score_adj": clip(f"(900 - {v('CreditScore', '700')}) / 6", 0, 100),
        "employer_health": case((f"{seg} = 'EMPLOYED'", clip(
            f"(100 - {v('employer_health_score', '70.0')}) * 0.5 + {v('peer_default_rate', '0.05')} * 200", 0, 100)), other="10.0"),
        "healthcare_costs": case((f"{spike} < 2", "10.0"), (f"{spike} < 3", "50.0"), other="80.0"),
        "network_risk": clip(f"(({v('employer_risk_multiplier', '1.0')} - 1) * 30 + {v('merchant_downgrade_score', '0')} * 5)"
                             f" + CASE WHEN {v('parent_income_stable', '1.0')} = 0 THEN 20.0 ELSE 0.0 END", 0, 100),
        "behavioral_signals": clip(f"{v('subscription_cascade_score', '0.25')} * 40 + {v('wallet_velocity', '0.2')} * 30", 0, 100),
        "life_events": f"(CASE WHEN (CASE WHEN {sr} = 0 THEN 1.0 ELSE {sr} END) > 3 THEN 40.0 ELSE 0.0 END"
                       f" + CASE WHEN {sdt} > 5 THEN 30.0 ELSE 0.0 END"
                       f" + CASE WHEN {v('max_dpd_last_12m', '0')} > 60 THEN 30.0 ELSE 0.0 END)",
        "age_vintage": f"(CASE WHEN {v('Age', '35')} < 25 THEN 20.0 WHEN {v('Age', '35')} > 60 THEN 15.0 ELSE 0.0 END"
                       f" + CASE WHEN {v('oldest_credit_line_years', '5.0')} < 2 THEN 30.0 ELSE 0.0 END)",
        "external_factors": clip(f"CASE WHEN {ind} = 0 THEN 30.0 ELSE {ind} END", 0, 100),
    }


COMP = components(lambda n, d: n)
COMP_IMPUTED = components(lambda n, d: f"coalesce({n}, {d})")
BANDS = [(0, 25, "SAFE"), (26, 45, "LOW RISK"), (46, 60, "MODERATE"), (61, 75, "HIGH RISK"), (76, 100, "CRITICAL")]


def classify(s, other="'CRITICAL'", extra=()):
    return case(*[(f"{s} BETWEEN {lo} AND {hi}", f"'{b}'") for lo, hi, b in BANDS], *extra, other=other)


def _scored(comp) -> str:
    total = "0.0 + " + " + ".join(f"comp_{n} * {w}" for n, w in WEIGHTS.items())
    return (f"SELECT *, {classify('risk_score_v2')} AS risk_band FROM (SELECT *, {rnd(total, 2)} AS risk_score_v2 FROM "
            f"(SELECT *, {cols({f'comp_{n}': e for n, e in comp.items()})} FROM feat))")


GIVEN = {"booster_a": (37, 900, 0.1), "booster_b": (53, 800, 0.2), "random_forest": (71, 950, 0.05), "logistic": (89, 700, 0.3)}
MODEL_WEIGHTS = {"booster_a": 0.35, "booster_b": 0.30, "random_forest": 0.20, "logistic": 0.15}
GIV = ("SELECT *, " + rnd("0.0 + " + " + ".join(f"{w} * p_{n}" for n, w in MODEL_WEIGHTS.items()), 6)
       + " AS ensemble_probability FROM (SELECT LoanID, \"Default\" AS y, " + ", ".join(
           f"CAST(LoanID * {a} % {m} AS DOUBLE) / 1000 + \"Default\" * {w} AS p_{n}" for n, (a, m, w) in GIVEN.items()) + " FROM snap)")

MONEY = lambda x, d=0: "format('{:,." + str(d) + "f}', CAST(" + x + " AS DOUBLE))"
NUM = lambda x, d=0: "format('{:." + str(d) + "f}', CAST(" + x + " AS DOUBLE))"


def _nan(x):
    return f"coalesce({x}, 'nan')"


ZERO = lambda c, d: f"(CASE WHEN {c} = 0 THEN {d} ELSE {c} END)"


def scenario_arms():
    """(rule number, condition, name, override, message, reason) in order."""
    cd, cs = ZERO("cdps", "0.0"), ZERO("cash_sufficiency_ratio", "0.0")
    cash = f"segment_category = 'BUSINESS_OWNER' AND avg_monthly_balance_6m < {EMI} AND cash_deposit_before_emi_days <= 3"
    fig = f"'CDPS=' || {_nan(NUM(cd))} || '%, CSR=' || {_nan(NUM(cs, 2))}"
    days = "CAST(trunc(cash_deposit_before_emi_days) AS BIGINT)"
    spike = ZERO("healthcare_spike_ratio", "1.0")
    med = (f"'We understand medical emergencies are stressful. We can offer:' || chr(10) || '1. ₹' || {MONEY(EMI + ' * 3')} || "
           "' medical emergency loan at 0% for 60 days' || chr(10) || '2. 3-month EMI payment holiday' || chr(10) || "
           "'3. Insurance claim assistance' || chr(10) || 'Your pension is safe. Let us help.'")
    zero, plat = ZERO("zero_income_days_month", "0.0"), ZERO("multi_platform_count", "1.0")
    whole = lambda x: f"CAST(trunc({x}) AS BIGINT)"
    peer, stress = ZERO("peer_default_rate", "0.0"), ZERO("industry_stress_index", "30.0")
    health = ZERO("employer_health_score", "70.0")
    gig = f"segment_category = 'SELF_EMPLOYED' AND {zero} > 10"
    student = "contains(detailed_segment, 'STUDENT')"
    return [
        (1, f"{cash} AND {cd} > 70 AND {cs} >= 1.1", "CASH_BUSINESSMAN_RELIABLE", "'MODERATE'",
         f"'Reminder: EMI of ₹' || {MONEY(EMI)} || ' due in ' || {days} || ' days. Your cash deposit pattern is consistent."
         " Please ensure deposit before EMI date.'", f"{fig} || ' — reliable cash pattern'"),
        (1, cash, "CASH_BUSINESSMAN_STRESSED", "'CRITICAL'",
         f"'Your EMI of ₹' || {MONEY(EMI)} || ' is due in ' || {days} || ' days. Current balance: ₹' || "
         f"{MONEY('avg_monthly_balance_6m')} || '. Need help? We can offer flexible options. Call us.'",
         f"{fig} || ' — irregular cash flow'"),
        (2, f"{student} AND parent_income_stable = 0", "STUDENT_FAMILY_STRESS", "'HIGH RISK'",
         "'We notice your family may be facing some financial changes. Your education loan EMI of ₹{emi:,.0f} is protected. "
         "Options: moratorium extension, income-based repayment. Focus on your studies — we''ll work with your family.'",
         "'Parent income instability detected'"),
        (2, f"{student} AND parent_income_monthly > 0 AND parent_income_monthly > {EMI} * 3", "STUDENT_FAMILY_STRONG",
         "'LOW RISK'", "NULL", "'Strong family financial support'"),
        (3, "NumCreditLines >= 3 AND computed_dti > 45", "MULTI_LOAN_STRESS", "NULL",
         f"'Managing ' || NumCreditLines || ' active credit lines with DTI of ' || {NUM('computed_dti', 1)} || '% requires careful"
         " planning. Would you like us to help consolidate? We can restructure into a single lower EMI.'",
         f"NumCreditLines || ' loans, DTI=' || {NUM('computed_dti', 1)} || '% — consolidation recommended'"),
        (4, f"segment_category = 'RETIRED' AND {spike} > 3 AND monthly_pension > 0", "RETIRED_MEDICAL_EMERGENCY", "'MODERATE'",
         med, f"'Healthcare spike ' || {NUM(spike, 1)} || 'x, pension=stable'"),
        (4, f"segment_category = 'RETIRED' AND {spike} > 3", "RETIRED_MEDICAL_EMERGENCY", "'CRITICAL'",
         med, f"'Healthcare spike ' || {NUM(spike, 1)} || 'x, pension=none'"),
        (5, f"{gig} AND {plat} > 1", "GIG_PARTIAL_SUSPENSION", "'MODERATE'",
         "'We noticed your primary platform earnings stopped. Since you earn on other platforms, we can offer a flexible EMI"
         " plan until your account is restored.'",
         f"{whole(zero)} || ' zero-income days but ' || {whole(plat)} || ' platforms active'"),
        (5, gig, "GIG_FULL_SUSPENSION", "'CRITICAL'",
         "'We noticed your platform earnings stopped. Is everything okay? We can help:' || chr(10) || '1. 30-day payment holiday'"
         f" || chr(10) || '2. ₹' || {MONEY(EMI)} || ' emergency loan to cover EMI' || chr(10) || '3. Connect to alternate gig"
         " platforms' || chr(10) || 'Reply YES to speak with support.'",
         f"{whole(zero)} || ' zero-income days, single platform dependency'"),
        (6, f"segment_category = 'EMPLOYED' AND ({peer} > 0.15 OR ({stress} > 70 AND {health} < 40))", "EMPLOYER_LAYOFF_RISK",
         "NULL",
         "'We noticed news about your industry/employer. Your financial wellness is important to us. If you''re affected, we can:'"
         " || chr(10) || '1. Pause EMIs for 3 months' || chr(10) || '2. Provide job placement assistance' || chr(10) || "
         "'3. Offer emergency funds' || chr(10) || 'This is proactive support, not a collection call.'",
         f"'Peer default rate=' || {_nan(NUM(peer + ' * 100', 1))} || '%, industry stress=' || "
         f"{_nan('CAST(' + stress + ' AS VARCHAR)')}"),
    ]


ARMS = scenario_arms()


def scenario_cols(rule=None) -> dict:
    arms = [a for a in ARMS if rule is None or a[0] == rule]
    return {"scenario": case(*[(a[1], f"'{a[2]}'") for a in arms]),
            "risk_override": f"CAST({case(*[(a[1], a[3]) for a in arms])} AS VARCHAR)",
            "scenario_message": case(*[(a[1], a[4]) for a in arms]),
            "scenario_reason": case(*[(a[1], a[5]) for a in arms])}


RES = (f"SELECT *, coalesce(risk_override, risk_band) AS final_band FROM (SELECT *, {cols(scenario_cols())} FROM scored"
       " WHERE risk_band IN ('MODERATE', 'HIGH RISK', 'CRITICAL'))")


def message(band: str) -> str:
    emi, emi2, emi3 = MONEY(EMI), MONEY(EMI + " * 2"), MONEY(EMI + " * 3")
    days, hi = "CAST(LoanID % 18 + 3 AS VARCHAR)", "'Hi Customer ' || LoanID || '"
    nl = "' || chr(10) || '"
    texts = {
        "LOW RISK": f"{hi}, a quick wellness tip: maintaining a savings buffer of 3x your EMI (₹' || {emi3} || ') helps avoid"
                    f" payment stress. Your next EMI of ₹' || {emi} || ' is due on upcoming. Stay on track! 🌟'",
        "MODERATE": f"{hi}, we noticed some changes in your financial pattern. Your EMI of ₹' || {emi} || ' is due in ' || {days}"
                    f" || ' days. We can help with:{nl}1️⃣ EMI date shift{nl}2️⃣ Flexible payment plan{nl}Reply YES to explore options.'",
        "HIGH RISK": f"{hi}, your financial wellness is important to us. We see your EMI of ₹' || {emi} || ' is coming up in ' || "
                     f"{days} || ' days. We''d like to offer:{nl}1️⃣ EMI restructuring at lower rate{nl}2️⃣ 1-month payment holiday"
                     f"{nl}3️⃣ Emergency bridge loan at 0% for 30 days{nl}Call us at 1800-XXX-XXXX or reply HELP.'",
        "CRITICAL": f"'URGENT: ' || {hi}, we understand you may be facing financial difficulty. Your EMI of ₹' || {emi} || ' is due"
                    f" in ' || {days} || ' days. We''re here to help, not to pressure:{nl}1️⃣ 3-month EMI pause{nl}2️⃣ Loan"
                    f" restructuring{nl}3️⃣ Emergency ₹' || {emi2} || ' loan at 0% for 60 days{nl}4️⃣ Insurance claim assistance"
                    f"{nl}A support specialist will call you within the hour.'",
    }
    return case(*[(f"{band} = '{b}'", t) for b, t in texts.items()])


CHANNEL = case(("final_band = 'LOW RISK'", "'SMS'"), ("final_band = 'MODERATE'", "'SMS,Email'"),
               ("final_band = 'HIGH RISK'", "'WhatsApp,SMS'"), ("final_band = 'CRITICAL'", "'Phone Call,WhatsApp'"))
TIMING = case(("final_band = 'LOW RISK'", "'Within 48 hours'"), ("final_band = 'MODERATE'", "'Within 24 hours'"),
              ("final_band = 'HIGH RISK'", "'Same day (by 10 AM)'"), ("final_band = 'CRITICAL'", "'Immediate (within 1 hour)'"))
OUT = (f"SELECT LoanID, final_band AS risk_band, risk_score_v2 AS risk_score, {CHANNEL} AS channel, {TIMING} AS timing, "
       f"{message('final_band')} AS message, scenario FROM res WHERE final_band <> 'SAFE'")

_AMT = lambda cond: f"CASE WHEN {cond} THEN amount ELSE 0.0 END"
_W = "OVER (PARTITION BY customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
TOT = f"""SELECT *, CAST(coalesce(failures_all - max(CASE WHEN type = 'salary' THEN failures_all END) {_W}, failures_all) AS BIGINT)
 AS consecutive_failures FROM (SELECT *, count(*) {_W} AS transaction_count,
 sum({_AMT("type IN ('credit', 'salary')")}) {_W} AS total_credits, sum({_AMT("type = 'debit'")}) {_W} AS total_debits,
 sum(CASE WHEN type IN ('credit', 'salary') THEN amount WHEN type = 'debit' THEN -amount ELSE 0.0 END) {_W} AS current_balance_estimate,
 CAST(sum(CASE WHEN type = 'payment_failure' THEN 1 ELSE 0 END) {_W} AS BIGINT) AS failures_all,
 sum({_AMT("category = 'healthcare'")}) {_W} AS healthcare_spend, max(CASE WHEN type = 'salary' THEN ts END) {_W} AS last_salary_date,
 first_value(monthly_income) {_W} AS baseline_monthly_income FROM txn)"""
_SPIKE = "(healthcare_spend / greatest(baseline_monthly_income * 0.05, 1.0))"
R1 = case(("amount / greatest(baseline_monthly_income, 1.0) > 0.3", f"'Large expense: ₹' || {MONEY('amount')} || ' (' || "
           f"{NUM('amount / greatest(baseline_monthly_income, 1.0) * 100')} || '% of income)'"))
R2 = case(("consecutive_failures >= 2", "'Consecutive payment failures: ' || consecutive_failures"))
R3 = case((f"{_SPIKE} > 3", f"'Healthcare spike: ' || {NUM(_SPIKE, 1)} || 'x baseline'"))
ALE = f"SELECT *, {R1} AS r1, {R2} AS r2, {R3} AS r3 FROM tot"

_BODIES = {
    "li": (LI, []), "snap": (SNAP, ["li"]), "enr": (ENR, ["snap"]), "feat": (FEAT, ["snap"]),
    "scored": (_scored(COMP), ["feat"]), "imputed": (_scored(COMP_IMPUTED), ["feat"]), "res": (RES, ["scored"]),
    "outreach": (OUT, ["res"]), "giv": (GIV, ["snap"]), "txn": (TXN_CTE, []), "acct": (ACCT, []),
    "tot": (TOT, ["txn"]), "ale": (ALE, ["tot"]),
}


def sql(body: str, extra: dict | None = None) -> str:
    """A full statement: the needed common table expressions, then ``body``.

    ``extra`` are further expressions, local to this statement.
    """
    extra = extra or {}
    order: list[str] = []

    def need(name):
        for dep in _BODIES[name][1]:
            need(dep)
        if name not in order:
            order.append(name)

    text = " ".join([body, *extra.values()])
    for name in _BODIES:
        if re.search(rf"\b(FROM|JOIN|from|join)\s+{name}\b", text):
            need(name)
    ctes = [f"{n} AS ({_BODIES[n][0]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return dbl((f"WITH {', '.join(ctes)} " if ctes else "") + body)
