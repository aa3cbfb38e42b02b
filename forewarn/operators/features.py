"""Batch feature formulas: each step adds its columns to the loan frame.

A formula is a list of layers, each layer a dict of columns that only read
earlier layers.  A single formula applies its own layers; ``run`` merges the
layers of all formulas, so the whole table of features takes a handful of
projections instead of one per column.

Random terms of the formulas are explicit inputs (``noise`` is a column or a
number, 0 by default), so a run is repeatable.
"""

from __future__ import annotations

import functools
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import (
    as_col, clip, cut, first_match, has, map_values, npmax, npround, opt, row_std,
    safe_divide, select_cols, null_nan,
)

col = F.col


def emi_simple(df: DataFrame) -> Column:
    """Instalment without interest: ``LoanAmount / max(LoanTerm, 1)``."""
    return safe_divide(opt(df, "LoanAmount", 0.0), opt(df, "LoanTerm", 1))


def emi_amortised(amount: Column, months: Column, monthly_rate: Column) -> Column:
    growth = F.pow(F.lit(1.0) + monthly_rate, months)
    return amount * monthly_rate * growth / (growth - 1)


Layers = list[dict[str, Column]]


def _apply(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns(layer)
    return df


def formula(layers_of):
    """``f(df, ...) -> DataFrame`` from a function that lists the layers; the list stays at ``f.layers``."""
    @functools.wraps(layers_of)
    def apply(df: DataFrame, *args, **kwargs) -> DataFrame:
        return _apply(df, layers_of(df, *args, **kwargs))
    apply.layers = layers_of
    return apply


@formula
def income_stability(df: DataFrame, noise=0.0) -> Layers:
    source = next((c for c in ("segment_category", "EmploymentType") if has(df, c)), None)
    cv = map_values(col(source), rules.SEGMENT_VOLATILITY, rules.DEFAULT_VOLATILITY) \
        if source else F.lit(rules.DEFAULT_VOLATILITY)
    return [{"isi": npround(clip((cv + as_col(noise)) * 100, 0.5, 100), 2)},
            {"isi_band": cut(col("isi"), *rules.ISI_BANDS)}]


@formula
def debt_to_income(df: DataFrame) -> Layers:
    if has(df, "emi"):
        emi = col("emi")
    else:
        emi = emi_amortised(col("LoanAmount"), npmax(col("LoanTerm"), 1), F.lit(0.12 / 12))
    return [{"computed_dti": npround(clip(safe_divide(emi, col("Income")) * 100, 0, 200), 2)},
            {"dti_band": cut(col("computed_dti"), *rules.DTI_BANDS)}]


@formula
def savings_rate(df: DataFrame) -> Layers:
    rate = safe_divide(col("avg_monthly_balance_6m"), col("Income")) * 100
    return [{"savings_rate_pct": npround(clip(rate, 0, 500), 2)},
            {"savings_band": cut(col("savings_rate_pct"), *rules.SAVINGS_BANDS)}]


@formula
def emi_cushion(df: DataFrame) -> Layers:
    essential = (opt(df, "expense_housing", 0.0) + opt(df, "expense_food_groceries", 0.0)
                 + opt(df, "expense_transportation", 0.0) + opt(df, "expense_healthcare", 0.0))
    emi = emi_simple(df)
    return [{"eci": npround(clip(safe_divide(col("Income") - essential - emi, emi), -2, 10), 3)},
            {"eci_band": cut(col("eci"), *rules.ECI_BANDS)}]


@formula
def expenditure_volatility(df: DataFrame) -> Layers:
    """Spread over every ``expense_*`` column the frame has at this point."""
    names = select_cols(df, prefix="expense_")
    if not names:
        return [{"evs": F.lit(0.0), "evs_ratio": F.lit(0.0)}]
    evs = row_std([F.coalesce(col(n).cast("double"), F.lit(0.0)) for n in names])
    return [{"evs": npround(evs)},
            {"evs_ratio": npround(safe_divide(col("evs"), col("total_monthly_expense")), 3)}]


@formula
def salary_delay_trend(df: DataFrame, noise=0.0) -> Layers:
    sdt = col("sdt")
    return [{"sdt": F.when(col("segment_category") == "EMPLOYED",
                           npround(clip(col("salary_delay_days") + as_col(noise), 0, 30), 1))},
            {"sdt_band": first_match((sdt.isNull(), "N/A"), (sdt <= 0, "Perfect"), (sdt <= 2, "Normal"),
                                     (sdt <= 5, "Warning"), otherwise="Critical")}]


@formula
def cash_deposit_pattern(df: DataFrame) -> Layers:
    is_business, cdps = col("segment_category") == "BUSINESS_OWNER", col("cdps")
    ratio = safe_divide(col("cash_deposit_avg_amount"), emi_simple(df))
    return [{"cdps": F.when(is_business, npround(clip(col("cash_deposit_consistency_score"), 0, 100), 1)),
             "cash_sufficiency_ratio": F.when(is_business, npround(clip(ratio, 0, 10), 3))},
            {"cdps_band": first_match((cdps.isNull(), "N/A"), (cdps >= 80, "Consistent"), (cdps >= 50, "Mixed"),
                                      otherwise="Irregular")}]


@formula
def discretionary_spending(df: DataFrame) -> Layers:
    spend = (opt(df, "expense_lifestyle_entertainment", 0.0) + opt(df, "dining_out_monthly", 0.0)
             + opt(df, "shopping_monthly", 0.0) + opt(df, "expense_discretionary_vices", 0.0))
    return [{"dsr": npround(clip(safe_divide(spend, col("total_monthly_expense")) * 100, 0, 100), 2)},
            {"dsr_band": cut(col("dsr"), *rules.DSR_BANDS)}]


@formula
def payment_timing(df: DataFrame) -> Layers:
    return [{"ptc": npround(col("payment_day_consistency"), 3)},
            {"ptc_band": cut(col("ptc"), *rules.PTC_BANDS)}]


@formula
def balance_trajectory(df: DataFrame, noise=0.0) -> Layers:
    depletion, abt = col("DTIRatio") / 100 - col("CreditScore") / 900 * 0.5, col("abt")
    return [{"abt": npround(clip(-depletion + as_col(noise), -0.5, 0.5), 4)},
            {"abt_band": first_match((abt > 0.05, "Building Reserves"), (abt > -0.05, "Stable"),
                                     (abt > -0.15, "Declining"), otherwise="Depleting")}]


@formula
def subscription_cascade(df: DataFrame) -> Layers:
    return [{"subscription_cascade_score": map_values(
        col("subscription_cascade_phase"), rules.CASCADE_SCORES, rules.CASCADE_DEFAULT)}]


@formula
def wallet_velocity(df: DataFrame, bill_splits=0.0) -> Layers:
    total = col("instant_cashouts_month") + col("p2p_borrow_requests_30d") + as_col(bill_splits)
    v = col("wallet_velocity")
    return [{"wallet_velocity": npround(total / 10, 3)},
            {"wallet_velocity_band": first_match((v < 0.3, "Normal"), (v < 0.6, "Moderate Stress"),
                                                 otherwise="High Stress")}]


@formula
def merchant_downgrade(df: DataFrame, noise=0.0) -> Layers:
    stress = col("DTIRatio") / 100 + (1 - col("CreditScore") / 900)
    s = col("merchant_downgrade_score")
    return [{"merchant_downgrade_score": clip(npround(stress * 3 + as_col(noise)), 0, 10).cast("int")},
            {"merchant_downgrade_band": first_match((s <= 2, "Mild"), (s <= 5, "Moderate"), otherwise="Severe")}]


@formula
def healthcare_spike(df: DataFrame, multiplier=1.0) -> Layers:
    baseline, ratio = npmax(col("expense_healthcare"), 1), col("healthcare_spike_ratio")
    return [{"healthcare_current_spend": npround(baseline * as_col(multiplier))},
            {"healthcare_spike_ratio": npround(col("healthcare_current_spend") / baseline, 2)},
            {"healthcare_spike_band": first_match((ratio < 2, "Normal"), (ratio < 3, "Moderate"),
                                                  otherwise="Emergency")}]


@formula
def employer_contagion(df: DataFrame) -> Layers:
    peer = F.coalesce(col("peer_default_rate"), F.lit(0.0))
    stress = opt(df, "industry_stress_index", 30.0, fill=True) / 100
    mult = clip(1.0 + peer * 1.5 + F.when(stress > 0.5, 0.3).otherwise(0.0), 1.0, 2.5)
    return [{"employer_risk_multiplier": npround(mult, 3)}]


@formula
def gig_income_variance(df: DataFrame) -> Layers:
    cv = col("income_cv_daily")
    return [{"gig_cv_band": first_match(
        (cv.isNull(), "N/A"), (cv < 0.3, "Stable for Gig"), (cv < 0.6, "Normal Variance"),
        (cv < 1.0, "High Variance"), otherwise="Extreme")}]


def cross_features(df: DataFrame) -> DataFrame:
    """Fourteen interaction columns in one projection."""
    def filled(name, default=0.0):
        return opt(df, name, default, fill=True)

    stress = (filled("computed_dti", 30.0) / 50 * 0.25
              + (1 - filled("savings_rate_pct", 20.0) / 50) * 0.20
              + (1 - clip(filled("eci", 1.0), -1, 3) / 3) * 0.20
              + filled("evs_ratio", 0.2) * 0.15
              + filled("behavioral_risk_score", 0.3) * 0.20)
    return df.withColumns({
        "income_per_dependent": npround(safe_divide(col("Income"), filled("num_dependents") + 1)),
        "emi_to_savings_ratio": npround(clip(
            safe_divide(emi_simple(df), col("avg_monthly_balance_6m")), 0, 50), 3),
        "total_debt_to_assets": npround(clip(
            safe_divide(filled("total_outstanding_debt"), filled("total_assets", 1.0)), 0, 100), 4),
        "credit_score_x_dti": npround(col("CreditScore") * col("DTIRatio") / 100, 2),
        "credit_score_x_util": npround(col("CreditScore") * filled("credit_utilization_ratio", 40.0) / 100, 2),
        "credit_lines_per_year": npround(
            safe_divide(filled("NumCreditLines", 2), filled("oldest_credit_line_years", 5.0), 0.5), 2),
        "bounce_per_credit_line": npround(
            safe_divide(filled("cheque_bounce_count_12m"), filled("NumCreditLines", 1)), 3),
        "auto_debit_x_ontime": npround(
            filled("auto_debit_success_rate", 0.9) * filled("ontime_payment_rate_12m", 0.9), 4),
        "income_stability_x_dti": npround(filled("isi", 15.0) * col("DTIRatio"), 3),
        "age_x_credit_score": npround(filled("Age", 30) * col("CreditScore") / 100, 2),
        "digital_engagement_score": npround(
            filled("app_login_frequency_month", 10.0) * 0.3 + filled("statement_open_rate", 0.5) * 30
            + (1 - filled("notification_dismiss_speed_sec", 5.0) / 30) * 10, 2),
        "financial_stress_index": npround(clip(stress, 0, 1), 4),
        "months_of_runway": npround(clip(
            safe_divide(filled("total_financial_assets", 100000.0), col("total_monthly_expense")), 0, 120), 1),
        "loan_burden_score": npround(clip(
            safe_divide(col("LoanAmount"), col("Income") * 12) * 100, 0, 500), 2),
    })


def run(df: DataFrame, healthcare_multiplier=1.0, isi_noise=0.0, sdt_noise=0.0, abt_noise=0.0,
        bill_splits=0.0, merchant_noise=0.0) -> DataFrame:
    """All seventeen steps; later steps read earlier outputs.  NaN counts as missing."""
    df = null_nan(df)
    steps = [
        income_stability.layers(df, isi_noise), debt_to_income.layers(df), savings_rate.layers(df),
        emi_cushion.layers(df), expenditure_volatility.layers(df), salary_delay_trend.layers(df, sdt_noise),
        cash_deposit_pattern.layers(df), discretionary_spending.layers(df), payment_timing.layers(df),
        balance_trajectory.layers(df, abt_noise), subscription_cascade.layers(df),
        wallet_velocity.layers(df, bill_splits), merchant_downgrade.layers(df, merchant_noise),
        healthcare_spike.layers(df, healthcare_multiplier), employer_contagion.layers(df),
        gig_income_variance.layers(df),
    ]
    merged = [{n: c for layer in level for n, c in layer.items()} for level in zip_longest(*steps, fillvalue={})]
    return cross_features(_apply(df, merged))


SUMMARY_COLUMNS = ["isi", "computed_dti", "savings_rate_pct", "eci", "evs_ratio", "dsr", "ptc", "abt",
                   "wallet_velocity", "financial_stress_index"]


def summary(df: DataFrame, columns=None) -> DataFrame:
    """mean/std/min/max per column: one aggregate, then one row per column."""
    names = [c for c in (columns or SUMMARY_COLUMNS) if has(df, c)]
    stats = df.agg(*[F.struct(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("s")) for c in names])
    return stats.select(F.explode(rows).alias("r")).select("r.feature", "r.s.mean", "r.s.std", "r.s.min", "r.s.max")
