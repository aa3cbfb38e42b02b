"""A worked example and small frames for the tests."""

# A salaried customer with a known hand-computed score.
WORKED = {
    "LoanID": 1, "Age": 32, "segment_category": "EMPLOYED", "Income": 85000.0, "LoanAmount": 540000.0, "LoanTerm": 36,
    "CreditScore": 720, "DTIRatio": 23.5, "isi": 1.22, "computed_dti": 23.5, "savings_rate_pct": 33.0,
    "avg_monthly_balance_6m": 28000.0, "ontime_payment_rate_12m": 0.83, "avg_delay_days": 1.0, "num_dpd_30_plus": 0,
    "eci": 1.0, "evs_ratio": 0.15, "dsr": 15.0, "cdps": None, "cash_sufficiency_ratio": None,
    "employer_health_score": 85.0, "peer_default_rate": 0.02, "industry_stress_index": 15.0,
    "healthcare_spike_ratio": 3.0, "employer_risk_multiplier": 1.0, "merchant_downgrade_score": 2,
    "parent_income_stable": 1.0, "subscription_cascade_score": 0.5, "wallet_velocity": 0.3, "sdt": 0.0,
    "max_dpd_last_12m": 7, "oldest_credit_line_years": 8.0,
}


def frame(spark, rows):
    """Rows of dicts to a frame; the first row decides the types, None columns are double."""
    kinds = {}
    for r in rows:
        for k, v in r.items():
            kind = {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(v))
            if kind and kinds.get(k) in (None, "long"):
                kinds[k] = kind
            kinds.setdefault(k, None)
    schema = ", ".join(f"`{k}` {v or 'double'}" for k, v in kinds.items())
    cast = {"double": float, "long": int}
    data = [tuple(None if r.get(k) is None else cast.get(v, lambda x: x)(r[k]) for k, v in kinds.items()) for r in rows]
    return spark.createDataFrame(data, schema)
