import pytest
from frames import WORKED, frame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.operators import features, scoring

EXPECTED = {"income_stability": 90, "debt_burden": 15, "savings_adequacy": 67, "payment_history": 10, "emi_cushion": 50,
            "expenditure_pattern": 37.5, "cash_flow": 0, "credit_score_adj": 30, "employer_health": 11.5,
            "healthcare_costs": 80, "network_risk": 10, "behavioral_signals": 29, "life_events": 0, "age_vintage": 0,
            "external_factors": 15}


def component(spark, name, **row):
    df = frame(spark, [{"k": 1, **row}])
    return df.select(scoring.component(df, name)).first()[0]


def test_worked_example(spark):
    r = scoring.score(frame(spark, [WORKED])).first()
    assert {n: r[f"comp_{n}"] for n in EXPECTED} == pytest.approx(EXPECTED)
    assert (r.risk_score_v2, r.risk_band) == (33.71, "LOW RISK")


def test_weights_sum_to_one():
    assert sum(rules.COMPONENT_WEIGHTS.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("name,row,want", [
    ("income_stability", {"isi": 5.0}, 10), ("income_stability", {"isi": 60.0}, 90), ("income_stability", {"isi": 1.99}, 90),
    ("income_stability", {"isi": 2.0}, 10), ("income_stability", {"isi": None}, 90), ("income_stability", {}, 90),
    ("income_stability", {"income_stability_index": 0.2}, 30),
    ("debt_burden", {"computed_dti": 20.0}, 15), ("debt_burden", {"computed_dti": 65.0}, 95), ("debt_burden", {"computed_dti": 30.0}, 40),
    ("debt_burden", {"DTIRatio": 45.0}, 70), ("debt_burden", {"computed_dti": None}, 95),
    ("savings_adequacy", {"savings_rate": 0.3}, 70), ("savings_adequacy", {}, 0), ("savings_adequacy", {"savings_rate_pct": None}, None),
    ("payment_history", {"avg_delay_days": None}, None), ("payment_history", {"avg_delay_days": 50.0}, 47.5),
    ("emi_cushion", {"eci": 2.5}, 0), ("emi_cushion", {"eci": 0.3}, 85), ("expenditure_pattern", {"dsr": None}, 10),
    ("cash_flow", {"segment_category": "BUSINESS_OWNER", "cdps": None}, 30), ("cash_flow", {"segment_category": None}, 0),
    ("cash_flow", {"segment_category": "BUSINESS_OWNER", "cdps": 50.0, "cash_sufficiency_ratio": 1.0}, 50),
    ("credit_score_adj", {"CreditScore": 720}, 30), ("employer_health", {"segment_category": "RETIRED"}, 10),
    ("healthcare_costs", {"healthcare_spike_ratio": None}, 10), ("healthcare_costs", {"healthcare_spike_ratio": 2.0}, 50),
    ("network_risk", {"parent_income_stable": 0.0}, 20), ("life_events", {"sdt": 6.0, "healthcare_spike_ratio": 3.5}, 70),
    ("life_events", {"sdt": None, "max_dpd_last_12m": 61}, 30), ("age_vintage", {"Age": 24, "oldest_credit_line_years": 1.0}, 50),
    ("age_vintage", {"Age": 61}, 15), ("external_factors", {"industry_stress_index": 0.0}, 30),
    ("external_factors", {"industry_stress_index": None}, None),
])
def test_component_edges(spark, name, row, want):
    got = component(spark, name, **row)
    assert got == (None if want is None else pytest.approx(want))


def test_classify_modes(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 25.0, 25.5, 26.0, 45.0, 46.0, 60.0, 75.0, 75.5, 76.0, 100.0, 101.0, -1.0, None)], "s double")
    modes = ["scorer", "predict", "display", "contiguous"]
    rows = df.select(*[scoring.classify(F.col("s"), m).alias(m) for m in modes]).collect()
    got = {m: [r[m] for r in rows] for m in modes}
    inner = ["LOW RISK", "LOW RISK", "MODERATE", "MODERATE", "HIGH RISK"]
    assert got["scorer"] == ["SAFE", "SAFE", "CRITICAL", *inner, "CRITICAL", "CRITICAL", "CRITICAL", "CRITICAL", "CRITICAL", "CRITICAL"]
    assert got["predict"] == ["SAFE", "SAFE", "SAFE", *inner, "SAFE", "CRITICAL", "CRITICAL", "SAFE", "SAFE", "SAFE"]
    assert got["display"] == ["SAFE", "SAFE", "SAFE", *inner, "SAFE", "CRITICAL", "CRITICAL", "CRITICAL", "SAFE", "SAFE"]
    assert got["contiguous"] == ["SAFE", "SAFE", "LOW RISK", *inner, "CRITICAL", "CRITICAL", "CRITICAL", "CRITICAL", "SAFE", None]


def test_missing_input_gives_no_score_unless_imputed(spark):
    row = {**WORKED, "industry_stress_index": None}
    df = frame(spark, [WORKED, {**row, "LoanID": 2}])
    plain = {r.LoanID: (r.risk_score_v2, r.risk_band) for r in scoring.score(df).collect()}
    assert plain[2] == (None, "CRITICAL")
    filled = {r.LoanID: r.risk_score_v2 for r in scoring.score(df, impute_missing=True).collect()}
    assert filled[2] == pytest.approx(33.71 + 15 * 0.05)


def test_scored_invariants(spark, sf):
    from forewarn.catalog import scored
    s = scored(spark, sf, impute=True).cache()
    n, bad = s.agg(F.count("*"), F.count_if(~F.col("risk_score_v2").between(0, 100))).first()
    assert n > 0 and bad == 0
    from forewarn.operators import reporting
    assert sum(r.n for r in reporting.band_distribution(s).collect()) == n
    s.unpersist()


def test_feature_edges(spark):
    base = {"LoanID": 1, "segment_category": "EMPLOYED", "Income": 0.0, "LoanAmount": 1000.0, "LoanTerm": 0, "CreditScore": 700}
    df = features.debt_to_income(frame(spark, [base, {**base, "Income": None}, {**base, "Income": 100000.0, "LoanTerm": 12}]))
    assert [(r.computed_dti, r.dti_band) for r in df.collect()] == [(200.0, "Critical Risk"), (None, None), (0.09, "Low Risk")]
    # any expense_ column counts, including a ratio added earlier
    e = frame(spark, [{"expense_a": 1.0, "expense_to_income_ratio": 3.0, "total_monthly_expense": 4.0}])
    assert features.expenditure_volatility(e).first().evs == 1.0
    assert features.expenditure_volatility(frame(spark, [{"x": 1.0}])).first().evs == 0.0


def test_nan_counts_as_missing(spark, sf):
    from forewarn import catalog

    base = catalog.loan_snapshot(spark, sf).where("LoanID < 60").drop("DTIRatio")

    def scores(missing):
        rows = base.withColumn("DTIRatio", F.lit(missing).cast("double"))
        return sorted((r.LoanID, r.computed_dti, r.risk_score_v2) for r in scoring.score(features.run(rows), True).collect())

    nan = scores(float("nan"))
    assert nan == scores(None) and all(x == x for _, x, _ in nan if x is not None)
