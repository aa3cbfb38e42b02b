"""Deterministic enrichment columns and the label-model formulas.

Some names exist twice with different definitions (for example
``emi_to_income_ratio``); ``enrichment_ratios`` and ``ledger_ratios`` keep them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import (
    clip, first_match, has, map_values, npmin, npround, opt, pymax0, row_sum, safe_divide, select_cols,
)
from forewarn.operators.features import emi_amortised

col = F.col
BUCKETS = 10_000


def stable_bucket(key: Column) -> Column:
    """Repeatable pseudo-random bucket 0..9999 of a key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _weighted_pick(bucket: Column, options) -> Column:
    edge, arms = 0.0, []
    for name, share in options:
        edge += share
        arms.append((bucket < F.lit(round(edge * BUCKETS)), F.lit(name)))
    return first_match(*arms, otherwise=F.lit(options[-1][0]))


def assign_segment(df: DataFrame, bucket: Column) -> DataFrame:
    """Detailed segment by employment type, age and a stable bucket; category by lookup."""
    job, age = col("EmploymentType"), col("Age")
    unemployed = job == "Unemployed"
    detailed = first_match(
        (unemployed & (age >= 55), _weighted_pick(bucket, rules.RETIREE_SEGMENTS)),
        (unemployed & (age <= 25), _weighted_pick(bucket, rules.YOUNG_SEGMENTS)),
        *[(job == name, _weighted_pick(bucket, options)) for name, options in rules.EMPLOYMENT_SEGMENTS.items()],
        otherwise=F.lit("SALARIED_PRIVATE"))
    return df.withColumn("detailed_segment", detailed).withColumn(
        "segment_category", map_values(col("detailed_segment"), {k: v[0] for k, v in rules.SEGMENTS.items()}))


def segment_dimension(spark) -> DataFrame:
    """The 13-row segment table."""
    return spark.createDataFrame(
        [(k, *v) for k, v in rules.SEGMENTS.items()],
        "detailed_segment string, category string, sub_category string, income_source string")


def lookup_segment(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left lookup into the fixed 13-row table, safe to broadcast."""
    return df.join(F.broadcast(dim), "detailed_segment", "left")


def normalize_segment(c: Column) -> Column:
    """Opt-in bridge from the generator's segment names to the enriched ones."""
    return F.coalesce(map_values(c, rules.SEGMENT_ALIASES), c)


def totals(df: DataFrame) -> DataFrame:
    expense = npround(row_sum([F.coalesce(col(c).cast("double"), F.lit(0.0))
                               for c in select_cols(df, prefix="expense_")]))
    financial = (col("fd_rd_total") + col("mutual_fund_value") + col("stock_portfolio_value")
                 + col("gold_value") + col("epf_ppf_balance"))
    return df.withColumns({
        "total_monthly_expense": expense,
        "total_financial_assets": financial,
        "manual_payment_pct": npround(1 - col("auto_debit_success_rate"), 3),
    }).withColumns({
        "savings_rate": npround(clip(F.try_divide(
            col("Income") - col("total_monthly_expense"), col("Income")), -0.5, 0.8), 3),
        "total_assets": col("total_financial_assets") + col("property_value_total"),
    }).withColumn("asset_to_debt_ratio", F.when(
        col("total_outstanding_debt") > 0, npround(col("total_assets") / col("total_outstanding_debt"), 2)
    ).otherwise(999.0))


def enrichment_ratios(df: DataFrame) -> DataFrame:
    expense = col("total_monthly_expense")
    return df.withColumns({
        "emi_to_income_ratio": npround(clip(
            col("LoanAmount") / (col("LoanTerm") * col("Income") + 1), 0, 5), 4),
        "expense_to_income_ratio": npround(clip(expense / (col("Income") + 1), 0, 3), 3),
        "liquidity_ratio": npround(clip(col("avg_monthly_balance_6m") / (expense + 1), 0, 20), 3),
        "debt_service_coverage": npround(clip(
            col("Income") / (F.try_divide(col("LoanAmount"), col("LoanTerm")) + 1), 0, 50), 3),
        "net_worth": npround(col("total_assets") - col("total_outstanding_debt")),
        "financial_cushion_months": npround(clip(col("total_financial_assets") / (expense + 1), 0, 120), 1),
    })


def behavioral_flags(df: DataFrame) -> DataFrame:
    """Weighted share of six warning flags, 0-1."""
    flags = [
        (0.20, col("p2p_borrow_requests_30d") > 0),
        (0.15, col("instant_cashouts_month") > 3),
        (0.15, col("subscription_cascade_phase") > 1),
        (0.20, col("password_resets_30d") > 1),
        (0.15, col("statement_open_rate") < 0.3),
        (0.15, col("customer_service_calls_30d") > 2),
    ]
    total = row_sum([F.lit(w) * F.when(cond, 1.0).otherwise(0.0) for w, cond in flags])
    return df.withColumn("behavioral_risk_score", npround(total, 3))


def category_stability(df: DataFrame, noise=0.0) -> DataFrame:
    base = map_values(col("segment_category"), rules.CATEGORY_STABILITY, rules.CATEGORY_STABILITY_DEFAULT)
    return df.withColumn("income_stability_index", npround(clip(base + noise, 0, 1), 3))


def loan_instalment(df: DataFrame) -> DataFrame:
    """``emi`` at the loan's own yearly rate (simple split at rate 0) and ``DTIRatio`` from it."""
    months = col("LoanTerm")
    rate = F.when(col("InterestRate") > 0, col("InterestRate") / 12 / 100)
    emi = F.when(rate.isNotNull(), emi_amortised(col("LoanAmount"), months, rate)).otherwise(
        F.try_divide(col("LoanAmount"), months))
    return df.withColumn("_emi", emi).withColumns({
        "emi": npround(col("_emi"), 2),
        "DTIRatio": npround(F.try_divide(col("_emi"), col("Income")) * 100, 2),
    }).drop("_emi")


def ledger_ratios(df: DataFrame) -> DataFrame:
    """Eight ratios on the instalment column ``emi``, percentages on a 0-100 scale."""
    balance, emi, expense = col("avg_monthly_balance_6m"), col("emi"), col("total_monthly_expense")
    return df.withColumns({
        "emi_to_income_ratio": npround(safe_divide(emi, col("Income")) * 100, 2),
        "emi_to_savings_ratio": npround(safe_divide(emi, balance) * 100, 2),
        "liquidity_ratio": npround(safe_divide(balance, emi), 3),
        "financial_cushion_months": npround(safe_divide(col("total_financial_assets"), expense), 1),
        "debt_service_coverage": npround(safe_divide(col("Income"), emi), 3),
        "months_of_runway": npround(safe_divide(balance, expense), 1),
        "bounce_per_credit_line": npround(safe_divide(col("cheque_bounce_count_12m"), col("NumCreditLines")), 3),
        "loan_burden_score": npround(
            col("DTIRatio") * 0.4 + col("credit_utilization_ratio") * 0.3
            + (1 - col("ontime_payment_rate_12m")) * 100 * 0.3, 1),
    })


def _add_if(cond: Column, points: float) -> Column:
    return F.when(cond, points).otherwise(0.0)


def default_logit(df: DataFrame, noise=0.0) -> DataFrame:
    """Logistic label model: ``default_logit`` and ``delinquency_prob``."""
    seg = col("EmploymentType")
    gig = 0.3 * pymax0(opt(df, "income_cv_daily", 0.3) - 0.4) + 0.05 * opt(df, "zero_income_days_month", 0.0)
    terms = [
        0.025 * (col("DTIRatio") - 35),
        -0.006 * (col("CreditScore") - 680),
        0.015 * pymax0(col("credit_utilization_ratio") - 50),
        -0.02 * col("savings_rate"),
        0.8 * pymax0(opt(df, "total_debt_to_assets", 0.5) - 0.6),
        -2.0 * (col("ontime_payment_rate_12m") - 0.85),
        0.03 * col("max_dpd_last_12m"),
        0.15 * col("cheque_bounce_count_12m"),
        0.12 * col("partial_payment_count_12m"),
        _add_if(col("statement_open_rate") < 0.2, 0.5),
        0.25 * col("password_resets_30d"),
        0.35 * (col("subscription_cascade_phase") - 1),
        0.15 * col("instant_cashouts_month"),
        0.20 * col("p2p_borrow_requests_30d"),
        _add_if(col("discretionary_spending_change_pct") < -25, 0.7),
        _add_if(col("balance_trajectory_pct") < -15, 0.9),
        _add_if(col("salary_delay_days") > 5, 0.6),
        1.0 * col("peer_default_rate"),
        _add_if(col("employer_health_score") < 50, 0.4),
        _add_if(col("healthcare_spending_multiplier") > 2, 0.8),
        first_match(
            (seg == "GIG_WORKER", gig),
            ((seg == "BUSINESS_OWNER") & (opt(df, "revenue_variance_cv", 0.2) > 0.4), F.lit(0.3)),
            ((seg == "STUDENT") & (opt(df, "parent_income_stable", 1.0) == 0), F.lit(0.5)),
            otherwise=F.lit(0.0)),
        _add_if(col("Age") < 25, 0.2),
        _add_if(col("MonthsEmployed") < 12, 0.3),
        F.lit(noise) if not isinstance(noise, Column) else noise,
    ]
    logit = F.lit(-3.5)
    for term in terms:
        logit = logit + term
    return df.withColumn("default_logit", logit).withColumn(
        "delinquency_prob", npround(1 / (1 + F.exp(-col("default_logit"))), 4))


def stress_composite(df: DataFrame) -> DataFrame:
    raw = (15 * pymax0(col("DTIRatio") - 30) / 30
           + 20 * (1 - col("ontime_payment_rate_12m"))
           + 15 * col("credit_utilization_ratio") / 100
           + 10 * npmin(col("cheque_bounce_count_12m"), 5) / 5
           + 10 * (col("subscription_cascade_phase") - 1) / 3
           + 10 * npmin(col("p2p_borrow_requests_30d"), 4) / 4
           + 10 * pymax0(-col("balance_trajectory_pct")) / 30
           + 10 * pymax0(opt(df, "healthcare_spending_multiplier", 1.0) - 1) / 4)
    return df.withColumn("financial_stress_score", npround(clip(raw, 0, 100), 1))


def behavioral_composite(df: DataFrame) -> DataFrame:
    """0-100 composite (the 0-1 flag score is ``behavioral_flags``)."""
    raw = (20 * (1 - col("statement_open_rate"))
           + 15 * npmin(col("password_resets_30d"), 5) / 5
           + 15 * (col("subscription_cascade_phase") - 1) / 3
           + 15 * npmin(col("instant_cashouts_month"), 5) / 5
           + 10 * npmin(col("p2p_borrow_requests_30d"), 4) / 4
           + 10 * pymax0(-col("discretionary_spending_change_pct")) / 40
           + 15 * npmin(opt(df, "customer_service_calls_30d", 0.0), 5) / 5)
    return df.withColumn("behavioral_risk_score", npround(clip(raw, 0, 100), 1))


def engagement(df: DataFrame) -> DataFrame:
    """Stress factor from the credit score and the 0-100 engagement composite."""
    factor = pymax0((700 - col("CreditScore")) / 400)
    return df.withColumn("stress_factor", factor).withColumn("digital_engagement_score", npround(clip(
        0.3 * col("statement_open_rate") + 0.3 * (col("app_login_frequency_month") / 20)
        + 0.2 * (1 - col("stress_factor")) + 0.2 * (col("notification_dismiss_speed_sec") / 10), 0, 1) * 100, 1))


def alias_columns(df: DataFrame) -> DataFrame:
    """Display names: ``employment_type``, ``monthly_income`` where absent."""
    pairs = {"employment_type": "EmploymentType", "monthly_income": "Income"}
    return df.withColumns({new: col(old) for new, old in pairs.items() if not has(df, new) and has(df, old)})


def derived_ratios(df: DataFrame) -> DataFrame:
    """Every enrichment column that does not depend on random draws."""
    return (df.transform(totals).transform(enrichment_ratios)
            .transform(behavioral_flags).transform(category_stability))
