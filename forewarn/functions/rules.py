"""Fixed values the results depend on: weights, bands, maps, thresholds, texts.

Everything here is data.  The logic that reads it lives in ``operators``.
"""

from __future__ import annotations

# --- fixed values: risk score ------------------------------------------------

COMPONENT_WEIGHTS = {
    "income_stability": 0.12,
    "debt_burden": 0.15,
    "savings_adequacy": 0.08,
    "payment_history": 0.12,
    "emi_cushion": 0.08,
    "expenditure_pattern": 0.07,
    "cash_flow": 0.05,
    "credit_score_adj": 0.07,
    "employer_health": 0.05,
    "healthcare_costs": 0.03,
    "network_risk": 0.02,
    "behavioral_signals": 0.05,
    "life_events": 0.04,
    "age_vintage": 0.02,
    "external_factors": 0.05,
}

# (low, high, band, default probability, action); both edges inclusive, gaps intended
RISK_BANDS = [
    (0, 25, "SAFE", "< 5%", "Monitor only"),
    (26, 45, "LOW RISK", "5-15%", "Gentle nudge, wellness tips"),
    (46, 60, "MODERATE", "15-35%", "Proactive outreach, options"),
    (61, 75, "HIGH RISK", "35-60%", "Urgent call, restructuring"),
    (76, 100, "CRITICAL", "> 60%", "Immediate intervention"),
]
BAND_NAMES = [band for _, _, band, _, _ in RISK_BANDS]
AT_RISK_BANDS = ["MODERATE", "HIGH RISK", "CRITICAL"]

# --- fixed values: feature formulas ------------------------------------------

SEGMENT_VOLATILITY = {
    "SALARIED_PRIVATE": 0.05,
    "SALARIED_GOVT": 0.02,
    "BUSINESS_OWNER": 0.35,
    "SELF_EMPLOYED": 0.40,
    "GIG_WORKER": 0.45,
    "RETIRED": 0.02,
    "STUDENT": 0.50,
}
DEFAULT_VOLATILITY = 0.20

ISI_BANDS = ([-1, 10, 25, 50, 200],
             ["Very Stable", "Stable", "Moderate Volatility", "High Volatility"])
DTI_BANDS = ([-1, 30, 40, 50, 200],
             ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"])
SAVINGS_BANDS = ([-1, 5, 10, 20, 1000], ["Poor", "Fair", "Good", "Excellent"])
ECI_BANDS = ([-10, 0.5, 1.0, 2.0, 100], ["Critical", "Tight", "Moderate", "Safe"])
DSR_BANDS = ([-1, 10, 15, 30, 100], ["Stressed", "Low", "Normal", "High"])
PTC_BANDS = ([-1, 0.7, 0.9, 1.01], ["Inconsistent", "Moderate", "Consistent"])

CASCADE_SCORES = {1: 0.25, 2: 0.50, 3: 0.75}
CASCADE_DEFAULT = 0.95

# --- fixed values: segments --------------------------------------------------

# detailed segment -> (category, sub-category, income source)
SEGMENTS = {
    "SALARIED_PRIVATE": ("EMPLOYED", "Private Sector", "Monthly Salary"),
    "SALARIED_GOVT": ("EMPLOYED", "Government", "Fixed Salary"),
    "SALARIED_CONTRACT": ("EMPLOYED", "Contract/Temporary", "Variable Salary"),
    "BUSINESS_SMALL": ("BUSINESS_OWNER", "Small Business", "Business Income"),
    "BUSINESS_MSME": ("BUSINESS_OWNER", "MSME", "Business Profit"),
    "BUSINESS_CASH": ("BUSINESS_OWNER", "Cash-Only Business", "Cash Revenue"),
    "SELF_FREELANCER": ("SELF_EMPLOYED", "Freelancer", "Project-based"),
    "SELF_GIG": ("SELF_EMPLOYED", "Gig Worker", "Daily/Weekly"),
    "SELF_PROFESSIONAL": ("SELF_EMPLOYED", "Professional Practice", "Client Fees"),
    "RETIRED_GOVT": ("RETIRED", "Pension (Govt)", "Monthly Pension"),
    "RETIRED_PRIVATE": ("RETIRED", "Pension (Private)", "Monthly/Lump"),
    "STUDENT_UG": ("STUDENT", "Undergraduate", "Family/Scholarship"),
    "STUDENT_PG": ("STUDENT", "Postgraduate", "Assistantship/Loan"),
}

# employment type -> [(detailed segment, share)]
EMPLOYMENT_SEGMENTS = {
    "Full-time": [("SALARIED_PRIVATE", 0.55), ("SALARIED_GOVT", 0.30), ("SALARIED_CONTRACT", 0.15)],
    "Part-time": [("SELF_FREELANCER", 0.40), ("SELF_GIG", 0.35), ("SELF_PROFESSIONAL", 0.25)],
    "Self-employed": [("BUSINESS_SMALL", 0.40), ("BUSINESS_MSME", 0.35), ("BUSINESS_CASH", 0.25)],
    "Unemployed": [("STUDENT_UG", 0.25), ("STUDENT_PG", 0.25),
                   ("RETIRED_GOVT", 0.25), ("RETIRED_PRIVATE", 0.25)],
}
RETIREE_SEGMENTS = [("RETIRED_GOVT", 0.6), ("RETIRED_PRIVATE", 0.4)]
YOUNG_SEGMENTS = [("STUDENT_UG", 0.6), ("STUDENT_PG", 0.4)]

CATEGORY_STABILITY = {
    "EMPLOYED": 0.85, "BUSINESS_OWNER": 0.65, "SELF_EMPLOYED": 0.55, "RETIRED": 0.90,
}
CATEGORY_STABILITY_DEFAULT = 0.30

# opt-in bridge between the two segment vocabularies
SEGMENT_ALIASES = {
    "SALARIED_PRIVATE": "EMPLOYED", "SALARIED_GOVT": "EMPLOYED", "GIG_WORKER": "SELF_EMPLOYED",
}

# --- fixed values: outreach --------------------------------------------------

# band -> (channels, timing, text before and between the money fields)
INTERVENTIONS = {
    "LOW RISK": (
        ["SMS"], "Within 48 hours",
        "Hi {name}, a quick wellness tip: maintaining a savings buffer "
        "of 3x your EMI (₹{emi_3x}) helps avoid payment stress. "
        "Your next EMI of ₹{emi} is due on {due_date}. Stay on track! 🌟"),
    "MODERATE": (
        ["SMS", "Email"], "Within 24 hours",
        "Hi {name}, we noticed some changes in your financial pattern. "
        "Your EMI of ₹{emi} is due in {days_to_emi} days. "
        "We can help with:\n"
        "1️⃣ EMI date shift\n"
        "2️⃣ Flexible payment plan\n"
        "Reply YES to explore options."),
    "HIGH RISK": (
        ["WhatsApp", "SMS"], "Same day (by 10 AM)",
        "Hi {name}, your financial wellness is important to us. "
        "We see your EMI of ₹{emi} is coming up in {days_to_emi} days. "
        "We'd like to offer:\n"
        "1️⃣ EMI restructuring at lower rate\n"
        "2️⃣ 1-month payment holiday\n"
        "3️⃣ Emergency bridge loan at 0% for 30 days\n"
        "Call us at 1800-XXX-XXXX or reply HELP."),
    "CRITICAL": (
        ["Phone Call", "WhatsApp"], "Immediate (within 1 hour)",
        "URGENT: Hi {name}, we understand you may be facing financial difficulty. "
        "Your EMI of ₹{emi} is due in {days_to_emi} days. "
        "We're here to help, not to pressure:\n"
        "1️⃣ 3-month EMI pause\n"
        "2️⃣ Loan restructuring\n"
        "3️⃣ Emergency ₹{emergency_loan} loan at 0% for 60 days\n"
        "4️⃣ Insurance claim assistance\n"
        "A support specialist will call you within the hour."),
}
# special situation -> (message, reason); the marks are filled from the row
SCENARIO_TEXTS = {
    "cash_reliable": (
        "Reminder: EMI of {emi} due in {days} days. Your cash deposit pattern is consistent. "
        "Please ensure deposit before EMI date.",
        "CDPS={cdps}%, CSR={csr} — reliable cash pattern"),
    "cash_stressed": (
        "Your EMI of {emi} is due in {days} days. Current balance: {balance}. "
        "Need help? We can offer flexible options. Call us.",
        "CDPS={cdps}%, CSR={csr} — irregular cash flow"),
    "student_stress": (
        # the amount mark stays as it is in this text
        "We notice your family may be facing some financial changes. "
        "Your education loan EMI of ₹{emi:,.0f} is protected. "
        "Options: moratorium extension, income-based repayment. "
        "Focus on your studies — we'll work with your family.",
        "Parent income instability detected"),
    "student_strong": (None, "Strong family financial support"),
    "multi_loan": (
        "Managing {loans} active credit lines with DTI of {dti}% requires careful planning. "
        "Would you like us to help consolidate? We can restructure into a single lower EMI.",
        "{loans} loans, DTI={dti}% — consolidation recommended"),
    "medical_pension": (
        "We understand medical emergencies are stressful. We can offer:\n"
        "1. {emi_3x} medical emergency loan at 0% for 60 days\n"
        "2. 3-month EMI payment holiday\n"
        "3. Insurance claim assistance\n"
        "Your pension is safe. Let us help.",
        "Healthcare spike {spike}x, pension=stable"),
    "medical_no_pension": (
        "We understand medical emergencies are stressful. We can offer:\n"
        "1. {emi_3x} medical emergency loan at 0% for 60 days\n"
        "2. 3-month EMI payment holiday\n"
        "3. Insurance claim assistance\n"
        "Your pension is safe. Let us help.",
        "Healthcare spike {spike}x, pension=none"),
    "gig_partial": (
        "We noticed your primary platform earnings stopped. Since you earn on other platforms, we can offer "
        "a flexible EMI plan until your account is restored.",
        "{zero_days} zero-income days but {platforms} platforms active"),
    "gig_full": (
        "We noticed your platform earnings stopped. Is everything okay? We can help:\n"
        "1. 30-day payment holiday\n"
        "2. {emi} emergency loan to cover EMI\n"
        "3. Connect to alternate gig platforms\n"
        "Reply YES to speak with support.",
        "{zero_days} zero-income days, single platform dependency"),
    "layoff": (
        "We noticed news about your industry/employer. Your financial wellness is important to us. "
        "If you're affected, we can:\n"
        "1. Pause EMIs for 3 months\n"
        "2. Provide job placement assistance\n"
        "3. Offer emergency funds\n"
        "This is proactive support, not a collection call.",
        "Peer default rate={peer_rate}, industry stress={stress}"),
}

DUE_DATE_TEXT = "upcoming"

DISPLAY_ACTIONS = {
    "SAFE": ("No action needed", "success"),
    "LOW RISK": ("Send wellness tips within 48h", "info"),
    "MODERATE": ("Proactive outreach — offer restructuring", "warning"),
    "HIGH RISK": ("Urgent call — restructuring + holiday", "danger"),
    "CRITICAL": ("Immediate intervention — emergency loan", "danger"),
}
DISPLAY_ACTION_DEFAULT = ("Monitor", "secondary")

SUCCESS_RATE = 0.72
API_SUCCESS_RATE = 0.70
INTERVENTION_COST = 50
DEFAULT_COST = 8000

# --- fixed values: "why this score" and customer card ------------------------

# (label, column, (good, fair, warning), higher is worse, number format)
FACTORS = [
    ("DTI Ratio", "DTIRatio", (30, 45, 60), True, ".1f%"),
    ("Computed DTI", "computed_dti", (35, 50, 70), True, ".1f%"),
    ("Credit Score", "CreditScore", (750, 650, 550), False, ".0f"),
    ("On-time Payments", "ontime_payment_rate_12m", (0.95, 0.85, 0.70), False, ".0%"),
    ("Savings Rate", "savings_rate", (15, 8, 3), False, ".1f%"),
    ("Credit Utilization", "credit_utilization_ratio", (30, 60, 80), True, ".0f%"),
    ("Total Debt / Assets", "total_debt_to_assets", (0.4, 0.7, 0.9), True, ".2f"),
    ("Behavioral Risk", "behavioral_risk_score", (30, 50, 70), True, ".0f"),
    ("Peer Default Rate", "peer_default_rate", (0.05, 0.15, 0.30), True, ".1%"),
    ("Financial Stress", "financial_stress_score", (30, 50, 70), True, ".0f"),
    ("Employer Risk", "employer_risk_multiplier", (1.2, 1.5, 2.0), True, ".2fx"),
    ("Income Stability", "isi", (70, 50, 30), False, ".0f"),
]
SEVERITY_LABELS = ["Good", "Fair", "Warning", "Critical"]

# (label, column, number format)
CARD_METRICS = [
    ("Income", "Income", "₹,.0f"),
    ("Loan", "LoanAmount", "₹,.0f"),
    ("Credit Score", "CreditScore", ".0f"),
    ("DTI", "DTIRatio", ".1f%"),
    ("On-time Rate", "ontime_payment_rate_12m", ".0%"),
    ("Savings", "savings_rate", ".1f%"),
]

# --- fixed values: request defaults (name -> (Spark type, default)) ----------

REQUEST_DEFAULTS = {
    "Age": ("int", 35),
    "Income": ("double", 50000),
    "LoanAmount": ("double", 500000),
    "CreditScore": ("int", 700),
    "MonthsEmployed": ("int", 36),
    "NumCreditLines": ("int", 3),
    "InterestRate": ("double", 12.0),
    "LoanTerm": ("int", 36),
    "DTIRatio": ("double", 30.0),
    "HasCoSigner": ("int", 0),
    "segment_category": ("string", "EMPLOYED"),
    "ontime_payment_rate_12m": ("double", 0.95),
    "avg_delay_days": ("double", 0),
    "avg_monthly_balance_6m": ("double", 30000),
    "total_outstanding_debt": ("double", 300000),
    "credit_utilization_ratio": ("double", 40),
    "num_dpd_30_plus": ("int", 0),
}

# --- fixed values: models ----------------------------------------------------

ENSEMBLE_WEIGHTS = {
    "booster_a": 0.35, "booster_b": 0.30, "random_forest": 0.20, "logistic": 0.15,
}
COST_FP = 50
COST_FN = 8000
MISSING_FILL = -999.0
FALLBACK_PROBABILITY = 0.5

# --- fixed values: transaction alerts ----------------------------------------

RESCORE = {
    "large_expense_ratio": 0.3,
    "balance_drop_pct": 0.4,
    "consecutive_failures": 2,
    "salary_delay_days": 5,
    "health_expense_spike": 3.0,
    "health_income_share": 0.05,
}
EVENT_DEFAULTS = {"type": "debit", "amount": 0.0, "category": "other", "monthly_income": 50000.0}

# --- fixed values: account profiles ------------------------------------------

FINTECH_LENDERS = ["PaySense", "MoneyTap", "CASHe", "EarlySalary"]

# --- fixed values: feature views (name -> (ttl in hours, features)) ----------

FEATURE_VIEWS = {
    "core_financial_features": (24, [
        "Income", "LoanAmount", "CreditScore", "DTIRatio", "InterestRate", "LoanTerm",
        "avg_monthly_balance_6m", "total_monthly_expense", "savings_rate"]),
    "behavioral_features": (24, [
        "ontime_payment_rate_12m", "payment_day_consistency", "max_dpd_last_12m",
        "subscription_cascade_phase", "p2p_borrow_requests_30d", "instant_cashouts_month",
        "salary_delay_days"]),
    "formula_features": (24, [
        "isi", "computed_dti", "savings_rate_pct", "eci", "evs", "evs_ratio", "sdt", "cdps",
        "dsr", "ptc", "abt"]),
    "advanced_behavioral_features": (24, [
        "subscription_cascade_score", "wallet_velocity", "merchant_downgrade_score",
        "healthcare_spike_ratio", "employer_risk_multiplier"]),
    "risk_score_features": (6, ["risk_score_v2", "risk_band"]),
}
