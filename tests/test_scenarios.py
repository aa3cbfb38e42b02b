import pytest
from frames import frame
from pyspark.sql import functions as F

from forewarn.operators import reporting, scenarios

EMPTY = {"segment_category": None, "detailed_segment": None, "cdps": None, "cash_sufficiency_ratio": None,
         "cash_deposit_before_emi_days": None, "avg_monthly_balance_6m": None, "parent_income_monthly": None,
         "parent_income_stable": None, "NumCreditLines": None, "computed_dti": None, "healthcare_spike_ratio": None,
         "monthly_pension": None, "zero_income_days_month": None, "multi_platform_count": None, "peer_default_rate": None,
         "industry_stress_index": None, "employer_health_score": None}
LOAN = {"LoanID": 7, "LoanAmount": 36000.0, "LoanTerm": 36}
CASH = {"segment_category": "BUSINESS_OWNER", "avg_monthly_balance_6m": 999.0, "cash_deposit_before_emi_days": 3.0, "cdps": 71.0,
        "cash_sufficiency_ratio": 1.1}
STUDENT = {"detailed_segment": "STUDENT_UG", "parent_income_stable": 1.0, "parent_income_monthly": 3001.0}
MULTI = {"NumCreditLines": 3, "computed_dti": 45.1}
RETIRED = {"segment_category": "RETIRED", "healthcare_spike_ratio": 3.1, "monthly_pension": 1.0}
GIG = {"segment_category": "SELF_EMPLOYED", "zero_income_days_month": 11.0, "multi_platform_count": 2.0}
JOB = {"segment_category": "EMPLOYED", "peer_default_rate": 0.16}


@pytest.mark.parametrize("row,want", [
    (CASH, ("CASH_BUSINESSMAN_RELIABLE", "MODERATE")),
    ({**CASH, "cdps": 70.0}, ("CASH_BUSINESSMAN_STRESSED", "CRITICAL")),
    ({**CASH, "cdps": None}, ("CASH_BUSINESSMAN_STRESSED", "CRITICAL")),
    ({**CASH, "cash_sufficiency_ratio": 1.09}, ("CASH_BUSINESSMAN_STRESSED", "CRITICAL")),
    ({**CASH, "avg_monthly_balance_6m": 1000.0}, (None, None)), ({**CASH, "cash_deposit_before_emi_days": 4.0}, (None, None)),
    (STUDENT, ("STUDENT_FAMILY_STRONG", "LOW RISK")), ({**STUDENT, "parent_income_monthly": 3000.0}, (None, None)),
    ({**STUDENT, "parent_income_stable": 0.0}, ("STUDENT_FAMILY_STRESS", "HIGH RISK")),
    (MULTI, ("MULTI_LOAN_STRESS", None)), ({**MULTI, "NumCreditLines": 2}, (None, None)), ({**MULTI, "computed_dti": 45.0}, (None, None)),
    (RETIRED, ("RETIRED_MEDICAL_EMERGENCY", "MODERATE")), ({**RETIRED, "monthly_pension": None}, ("RETIRED_MEDICAL_EMERGENCY", "CRITICAL")),
    ({**RETIRED, "healthcare_spike_ratio": 3.0}, (None, None)),
    (GIG, ("GIG_PARTIAL_SUSPENSION", "MODERATE")), ({**GIG, "multi_platform_count": 0.0}, ("GIG_FULL_SUSPENSION", "CRITICAL")),
    ({**GIG, "zero_income_days_month": 10.0}, (None, None)),
    (JOB, ("EMPLOYER_LAYOFF_RISK", None)), ({**JOB, "peer_default_rate": 0.15}, (None, None)),
    ({**JOB, "peer_default_rate": 0.0, "industry_stress_index": 71.0, "employer_health_score": 39.0}, ("EMPLOYER_LAYOFF_RISK", None)),
    ({**JOB, "peer_default_rate": None, "industry_stress_index": 71.0, "employer_health_score": 40.0}, (None, None)),
    ({}, (None, None)),
    ({**STUDENT, **MULTI}, ("STUDENT_FAMILY_STRONG", "LOW RISK")),
])
def test_rules(spark, row, want):
    df = frame(spark, [{**EMPTY, **LOAN, **row}]).withColumns(
        {c: F.col(c).cast("string") for c in ("segment_category", "detailed_segment")})
    r = scenarios.match(df).first()
    assert (r.scenario, r.risk_override) == want
    assert want[0] is None or r.scenario_reason


def test_interventions_and_messages(spark):
    rows = [{**EMPTY, **LOAN, "LoanID": i, "risk_band": b, "risk_score_v2": 50.0, **extra} for i, (b, extra) in enumerate([
        ("SAFE", {}), ("LOW RISK", {}), ("MODERATE", {}), ("HIGH RISK", STUDENT), ("CRITICAL", {})])]
    df = frame(spark, rows).withColumns({c: F.col(c).cast("string") for c in ("segment_category", "detailed_segment")})
    out = {r.LoanID: r for r in scenarios.interventions(df, F.lit(5)).collect()}
    assert sorted(out) == [2, 3, 4]
    assert out[3].risk_band == "LOW RISK" and out[3].scenario == "STUDENT_FAMILY_STRONG" and "₹3,000" in out[3].message
    assert out[2].channel == ["SMS", "Email"] and "is due in 5 days" in out[2].message
    assert out[4].message.endswith("within the hour.")  # whole, whatever its length
    m = reporting.monitoring(df, scenarios.interventions(df, F.lit(5))).first()
    assert (m.total, m.interventions, m.prevented, m.cost, m.savings) == (5, 3, 2, 150, 15850)


def test_factors_sorted_and_card_skips_missing(spark):
    df = frame(spark, [{"DTIRatio": 61.0, "CreditScore": 800, "Income": 1234567.0, "savings_rate": None, "isi": 10.0}])
    r = df.select(scenarios.factors(df).alias("f"), scenarios.customer_card(df).alias("c")).first()
    assert [(x.label, x.severity, x.bar_pct) for x in r.f] == [
        ("DTI Ratio", "Critical", 100.0), ("Income Stability", "Critical", 100.0), ("Credit Score", "Good", 25.0)]
    assert r.c == ["Income: ₹1,234,567", "Credit Score: 800", "DTI: 61.0%"]


def test_messages_are_whole_and_survive_missing_fields(spark):
    df = frame(spark, [{**LOAN, "name": None}, {**LOAN, "LoanAmount": None, "name": "Ada"}])
    df = df.withColumn("name", F.col("name").cast("string"))
    texts = [r.m for r in df.select(scenarios.message(df, F.lit("CRITICAL"), F.lit(4)).alias("m")).collect()]
    assert all(t.endswith("within the hour.") for t in texts) and "Customer 7" in texts[0] and "Ada" in texts[1]
