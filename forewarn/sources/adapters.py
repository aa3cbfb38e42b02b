"""Domain tables derived from the star-schema tables.

The expressions are plain SQL text valid in Spark and in ANSI engines, so the
test oracle can build the very same input rows and differ only in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# lineitem -> one row per order
LINE_TOTALS = {
    "q0": "SUM(CASE WHEN l_linenumber % 4 = 0 THEN l_quantity ELSE 0e0 END)",
    "q1": "SUM(CASE WHEN l_linenumber % 4 = 1 THEN l_quantity ELSE 0e0 END)",
    "q2": "SUM(CASE WHEN l_linenumber % 4 = 2 THEN l_quantity ELSE 0e0 END)",
    "q3": "SUM(CASE WHEN l_linenumber % 4 = 3 THEN l_quantity ELSE 0e0 END)",
}


def _by_segment(auto=None, building=None, furniture=None, household=None, machinery=None):
    arms = [("AUTOMOBILE", auto), ("BUILDING", building), ("FURNITURE", furniture),
            ("HOUSEHOLD", household), ("MACHINERY", machinery)]
    return lambda otherwise="": "CASE" + "".join(
        f" WHEN c_mktsegment = '{seg}' THEN {value}" for seg, value in arms if value
    ) + (f" ELSE {otherwise}" if otherwise else "") + " END"


# orders x customer x line totals -> one loan row per order
SNAPSHOT = {
    "LoanID": "CAST(o_orderkey AS BIGINT)",
    "customer_id": "o_custkey",
    "event_timestamp": "o_orderdate",
    "segment_category": _by_segment("'EMPLOYED'", "'BUSINESS_OWNER'", "'SELF_EMPLOYED'", "'RETIRED'")("'STUDENT'"),
    "Default": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "Age": "18 + (o_orderkey * 7) % 60",
    "Income": "CAST(8000 + (o_custkey * 7919) % 120000 AS DOUBLE)",
    "LoanAmount": "o_totalprice",
    "LoanTerm": "12 + 12 * (o_orderkey % 5)",
    "CreditScore": "300 + (o_custkey * 37) % 601",
    "DTIRatio": "CAST((o_orderkey * 13) % 7000 AS DOUBLE) / 100",
    "NumCreditLines": "1 + o_orderkey % 6",
    "expense_housing": "COALESCE(q0, 0e0) * 100",
    "expense_food_groceries": "COALESCE(q1, 0e0) * 80",
    "expense_transportation": "COALESCE(q2, 0e0) * 40",
    "expense_healthcare": "COALESCE(q3, 0e0) * 30",
    "ontime_payment_rate_12m": "CAST(300 + (o_orderkey * 17) % 700 AS DOUBLE) / 1000",
    "avg_monthly_balance_6m": "c_acctbal * 5",
    "industry_stress_index": _by_segment("CAST((o_custkey * 3) % 100 AS DOUBLE)")(),
    "detailed_segment": _by_segment("'SALARIED_PRIVATE'", "'BUSINESS_CASH'", "'SELF_GIG'", "'RETIRED_GOVT'")("'STUDENT_UG'"),
    "expense_lifestyle_entertainment": "COALESCE(q0 + q1, 0e0) * 20",
    "expense_discretionary_vices": "COALESCE(q2 + q3, 0e0) * 10",
    "avg_delay_days": "CAST((o_orderkey * 19) % 40 AS DOUBLE)",
    "num_dpd_30_plus": "o_orderkey % 4",
    "max_dpd_last_12m": "(o_orderkey * 23) % 181",
    "salary_delay_days": _by_segment("CAST((o_orderkey * 5) % 21 AS DOUBLE)")("0e0"),
    "employer_health_score": _by_segment("CAST(10 + (o_custkey * 11) % 91 AS DOUBLE)")(),
    "peer_default_rate": _by_segment("CAST((o_custkey * 29) % 300 AS DOUBLE) / 1000")(),
    "cash_deposit_consistency_score": _by_segment(building="CAST((o_orderkey * 31) % 101 AS DOUBLE)")(),
    "cash_deposit_avg_amount": _by_segment(building="CAST(5000 + (o_orderkey * 37) % 60000 AS DOUBLE)")("0e0"),
    "cash_deposit_before_emi_days": _by_segment(building="CAST(o_orderkey % 10 AS DOUBLE)")(),
    "zero_income_days_month": _by_segment(furniture="CAST(o_orderkey % 21 AS DOUBLE)")(),
    "multi_platform_count": _by_segment(furniture="CAST(1 + o_custkey % 3 AS DOUBLE)")(),
    "income_cv_daily": _by_segment(furniture="CAST(100 + (o_orderkey * 3) % 1400 AS DOUBLE) / 1000")(),
    "monthly_pension": "CASE WHEN c_mktsegment = 'HOUSEHOLD' AND o_custkey % 2 = 0"
                       " THEN CAST(15000 + (o_custkey * 41) % 45000 AS DOUBLE) END",
    "parent_income_monthly": _by_segment(machinery="CAST(10000 + (o_custkey * 43) % 90000 AS DOUBLE)")(),
    "parent_income_stable": "CASE WHEN c_mktsegment = 'MACHINERY' THEN"
                            " CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE 1e0 END END",
    "subscription_cascade_phase": "1 + o_orderkey % 4",
    "instant_cashouts_month": "o_orderkey % 7",
    "p2p_borrow_requests_30d": "o_custkey % 4",
    "healthcare_multiplier": "CASE WHEN o_orderkey % 12 = 0 THEN 2e0 + CAST(o_orderkey % 5 AS DOUBLE) ELSE 1e0 END",
    "payment_day_consistency": "CAST((o_orderkey * 47) % 1001 AS DOUBLE) / 1000",
    "oldest_credit_line_years": "CAST(5 + (o_custkey * 7) % 250 AS DOUBLE) / 10",
}

# further columns the enrichment and label formulas read, from a snapshot row
ENRICHED = {
    "total_monthly_expense": "expense_housing + expense_food_groceries + expense_transportation"
                             " + expense_healthcare + expense_lifestyle_entertainment + expense_discretionary_vices",
    "EmploymentType": "CASE segment_category WHEN 'EMPLOYED' THEN 'Full-time' WHEN 'BUSINESS_OWNER' THEN 'Self-employed'"
                      " WHEN 'SELF_EMPLOYED' THEN 'Part-time' ELSE 'Unemployed' END",
    "InterestRate": "7 + CAST((LoanID * 11) % 170 AS DOUBLE) / 10",
    "MonthsEmployed": "(LoanID * 3) % 120",
    "HasCoSigner": "LoanID % 2",
    "num_dependents": "LoanID % 5",
    "fd_rd_total": "CAST((customer_id * 101) % 300000 AS DOUBLE)",
    "mutual_fund_value": "CAST((customer_id * 211) % 200000 AS DOUBLE)",
    "stock_portfolio_value": "CAST((customer_id * 307) % 150000 AS DOUBLE)",
    "gold_value": "CAST((customer_id * 401) % 100000 AS DOUBLE)",
    "epf_ppf_balance": "CAST((customer_id * 503) % 400000 AS DOUBLE)",
    "property_value_total": "CAST((customer_id * 601) % 5000000 AS DOUBLE)",
    "total_outstanding_debt": "CASE WHEN LoanID % 10 = 0 THEN 0e0 ELSE LoanAmount * 1.25 END",
    "auto_debit_success_rate": "CAST(500 + (LoanID * 13) % 501 AS DOUBLE) / 1000",
    "credit_utilization_ratio": "CAST((LoanID * 29) % 1001 AS DOUBLE) / 10",
    "savings_rate": "CAST((LoanID * 31) % 300 AS DOUBLE) / 10",
    "cheque_bounce_count_12m": "LoanID % 4",
    "partial_payment_count_12m": "LoanID % 3",
    "password_resets_30d": "LoanID % 5",
    "statement_open_rate": "CAST((LoanID * 41) % 1001 AS DOUBLE) / 1000",
    "customer_service_calls_30d": "LoanID % 6",
    "app_login_frequency_month": "(LoanID * 7) % 30",
    "notification_dismiss_speed_sec": "CAST((LoanID * 53) % 300 AS DOUBLE) / 10",
    "discretionary_spending_change_pct": "CAST((LoanID * 59) % 1000 AS DOUBLE) / 10 - 50",
    "balance_trajectory_pct": "CAST((LoanID * 61) % 800 AS DOUBLE) / 10 - 40",
    "healthcare_spending_multiplier": "healthcare_multiplier",
    "revenue_variance_cv": "CAST((LoanID * 67) % 100 AS DOUBLE) / 100",
}

# events -> transactions
TXN = {
    "event_id": "event_id",
    "customer_id": "CAST(user_id AS VARCHAR(20))",
    "type": "CASE event_type WHEN 'purchase' THEN 'debit' WHEN 'view' THEN 'credit' WHEN 'signup' THEN 'salary'"
            " WHEN 'error' THEN 'payment_failure' ELSE 'payment' END",
    "amount": "value * 100",
    "category": "CASE event_id % 4 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'entertainment'"
                " WHEN 2 THEN 'groceries' ELSE 'other' END",
    "ts": "ts",
    "monthly_income": "CAST(20000 + user_id * 200 AS DOUBLE)",
}

# orders -> accounts of a customer's profile
ACCOUNT = {
    "customer_id": "CAST(o_custkey AS VARCHAR(20))",
    "account_key": "o_orderkey",
    "fip_id": "CASE WHEN o_orderkey % 11 = 0 THEN"
              " CASE o_orderkey % 4 WHEN 0 THEN 'PaySense' WHEN 1 THEN 'MoneyTap' WHEN 2 THEN 'CASHe' ELSE 'EarlySalary' END"
              " ELSE CASE o_orderkey % 7 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'ICICI' WHEN 2 THEN 'SBI' WHEN 3 THEN 'AXIS'"
              " WHEN 4 THEN 'KOTAK' WHEN 5 THEN 'PNB' ELSE 'BOB' END END",
    "account_type": "CASE WHEN o_orderkey % 3 <> 0 THEN 'SAVINGS' ELSE 'LOAN' END",
    "balance": "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 10 END",
    "emi": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 60 END",
    "outstanding": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END",
}


def _spark_sql(text: str) -> str:
    return text.replace("VARCHAR(20)", "STRING")


def _project(df: DataFrame, exprs: dict, keep=()) -> DataFrame:
    return df.select(*keep, *[F.expr(_spark_sql(e)).alias(n) for n, e in exprs.items()])


def loan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan row per order.

    Line items are pre-aggregated per order before the join, and the join
    disappears from the plan when no expense column is used.  No side is hinted:
    the optimizer broadcasts by measured size and splits skewed join keys.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.expr(e).alias(n) for n, e in LINE_TOTALS.items()])
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))
    return _project(joined, SNAPSHOT).withColumn(
        "total_monthly_expense", F.expr(ENRICHED["total_monthly_expense"]))


def enriched_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = loan_snapshot(spark, sf_dir)
    return base.withColumns({n: F.expr(e) for n, e in ENRICHED.items() if n not in base.columns})


def as_transactions(events: DataFrame) -> DataFrame:
    return _project(events, TXN)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(table(spark, sf_dir, "events"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), ACCOUNT)
