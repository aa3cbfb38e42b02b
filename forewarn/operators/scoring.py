"""Fifteen-component risk score (0-100) and its bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import clip, first_match, has, npmin, npround, null_nan, opt, or_default, pymax0
from forewarn.plans.fence import fence


class _Inputs:
    """Reads a column, or its documented default when the frame lacks it.

    ``impute`` also replaces missing values by that default.
    """

    def __init__(self, df: DataFrame, impute: bool):
        self.df, self.impute = df, impute

    def __call__(self, name: str, default) -> Column:
        return opt(self.df, name, default, fill=self.impute)

    def has(self, name: str) -> bool:
        return has(self.df, name)


def _steps(c: Column, *pairs, otherwise) -> Column:
    """Score of the first upper limit that c stays below."""
    return first_match(*[(c < limit, float(p)) for limit, p in pairs], otherwise=float(otherwise))


def _as_percent(c: Column) -> Column:
    """Values below 2 are read as a ratio."""
    return F.when(c < 2, c * 100).otherwise(c)


def income_stability(get) -> Column:
    if get.has("isi"):
        isi = _as_percent(get("isi", 15.0))
    else:
        isi = get("income_stability_index", 15.0) * 100
    return _steps(isi, (10, 10), (25, 30), (50, 60), otherwise=90)


def debt_burden(get) -> Column:
    dti = get("computed_dti", 30.0) if get.has("computed_dti") else get("DTIRatio", 30.0)
    return _steps(dti, (30, 15), (40, 40), (50, 70), otherwise=95)


def savings_adequacy(get) -> Column:
    if get.has("savings_rate_pct"):
        rate = get("savings_rate_pct", 20.0)
    elif get.has("savings_rate"):
        rate = _as_percent(get("savings_rate", 20.0))
    else:
        rate = F.lit(2000.0)
    return clip(100 - rate, 0, 100)


def payment_history(get) -> Column:
    raw = ((1 - get("ontime_payment_rate_12m", 0.95)) * 50
           + npmin(get("avg_delay_days", 0.0), 30) * 1.5
           + get("num_dpd_30_plus", 0) * 5)
    return clip(raw, 0, 100)


def emi_cushion(get) -> Column:
    return clip(100 * (1 - get("eci", 1.0) / 2), 0, 100)


def expenditure_pattern(get) -> Column:
    return clip(get("evs_ratio", 0.2) * 50 + pymax0(30 - get("dsr", 20.0)) * 2, 0, 100)


def cash_flow(get) -> Column:
    cdps, csr = get("cdps", 70.0), get("cash_sufficiency_ratio", 1.2)
    is_business = F.coalesce(get("segment_category", "EMPLOYED") == "BUSINESS_OWNER", F.lit(False))
    score = clip(pymax0(100 - cdps) * 0.6 + pymax0(1.5 - csr) * 40, 0, 100)
    return first_match((~is_business, 0.0), (cdps.isNull(), 30.0), otherwise=score)


def credit_score_adj(get) -> Column:
    return clip((900 - get("CreditScore", 700)) / 6, 0, 100)


def employer_health(get) -> Column:
    score = clip((100 - get("employer_health_score", 70.0)) * 0.5 + get("peer_default_rate", 0.05) * 200, 0, 100)
    return F.when(get("segment_category", "EMPLOYED") == "EMPLOYED", score).otherwise(10.0)


def healthcare_costs(get) -> Column:
    spike = F.coalesce(get("healthcare_spike_ratio", 1.0), F.lit(1.0))
    return _steps(spike, (2, 10), (3, 50), otherwise=80)


def network_risk(get) -> Column:
    raw = (get("employer_risk_multiplier", 1.0) - 1) * 30 + get("merchant_downgrade_score", 0) * 5
    family = F.when(get("parent_income_stable", 1.0) == 0, 20.0).otherwise(0.0)
    return clip(raw + family, 0, 100)


def behavioral_signals(get) -> Column:
    return clip(get("subscription_cascade_score", 0.25) * 40 + get("wallet_velocity", 0.2) * 30, 0, 100)


def _flag(cond: Column, points: float) -> Column:
    return F.when(cond, points).otherwise(0.0)


def life_events(get) -> Column:
    spike = or_default(get("healthcare_spike_ratio", 1.0), 1.0)
    return (_flag(spike > 3, 40.0) + _flag(get("sdt", 0.0) > 5, 30.0)
            + _flag(get("max_dpd_last_12m", 0) > 60, 30.0))


def age_vintage(get) -> Column:
    age = get("Age", 35)
    return (first_match((age < 25, 20.0), (age > 60, 15.0), otherwise=0.0)
            + _flag(get("oldest_credit_line_years", 5.0) < 2, 30.0))


def external_factors(get) -> Column:
    return clip(or_default(get("industry_stress_index", 30.0), 30.0), 0, 100)


COMPONENTS = {
    "income_stability": income_stability,
    "debt_burden": debt_burden,
    "savings_adequacy": savings_adequacy,
    "payment_history": payment_history,
    "emi_cushion": emi_cushion,
    "expenditure_pattern": expenditure_pattern,
    "cash_flow": cash_flow,
    "credit_score_adj": credit_score_adj,
    "employer_health": employer_health,
    "healthcare_costs": healthcare_costs,
    "network_risk": network_risk,
    "behavioral_signals": behavioral_signals,
    "life_events": life_events,
    "age_vintage": age_vintage,
    "external_factors": external_factors,
}


def component(df: DataFrame, name: str, impute_missing: bool = False) -> Column:
    return COMPONENTS[name](_Inputs(df, impute_missing))


def components(df: DataFrame, impute_missing: bool = False) -> dict[str, Column]:
    return {f"comp_{name}": component(df, name, impute_missing) for name in COMPONENTS}


def weighted_score(comp=lambda name: F.col(f"comp_{name}")) -> Column:
    """Weighted sum in component order, rounded to two digits."""
    total = F.lit(0.0)
    for name, weight in rules.COMPONENT_WEIGHTS.items():
        total = total + comp(name) * weight
    return npround(total, 2)


def classify(score: Column, mode: str = "scorer") -> Column:
    """Band of a score.  The modes differ only in the gaps between the bands.

    ``scorer``      gap, out of range or missing -> CRITICAL
    ``predict``     the same cases -> SAFE
    ``display``     gap, below 0 or missing -> SAFE, above 100 -> CRITICAL
    ``contiguous``  no gaps: upper edges alone decide; missing stays missing
    """
    if mode == "contiguous":
        return first_match(*[(score <= hi, band) for _, hi, band, _, _ in rules.RISK_BANDS[:-1]],
                           (score.isNotNull(), rules.RISK_BANDS[-1][2]))
    arms = [((score >= lo) & (score <= hi), band) for lo, hi, band, _, _ in rules.RISK_BANDS]
    if mode == "scorer":
        return first_match(*arms, otherwise="CRITICAL")
    if mode == "predict":
        return first_match(*arms, otherwise="SAFE")
    if mode == "display":
        return first_match(*arms, (score > 100, "CRITICAL"), otherwise="SAFE")
    raise ValueError(f"unknown classify mode: {mode}")


def band_probability(band: Column) -> Column:
    return first_match(*[(band == b, p) for _, _, b, p, _ in rules.RISK_BANDS])


def band_action(band: Column) -> Column:
    return first_match(*[(band == b, a) for _, _, b, _, a in rules.RISK_BANDS])


def score(df: DataFrame, impute_missing: bool = False, mode: str = "scorer") -> DataFrame:
    """Adds the 15 ``comp_*`` columns, ``risk_score_v2`` and ``risk_band``.

    NaN counts as missing.  Filters on input columns belong before this call: later ones stay above it (see ``fence``).
    """
    df = null_nan(df)
    return fence(df.withColumns(components(df, impute_missing))
                 .withColumn("risk_score_v2", weighted_score())
                 .withColumn("risk_band", classify(F.col("risk_score_v2"), mode)), "scored")


def top_components(df: DataFrame, n: int = 5) -> Column:
    """``["name: score", ...]`` of the n largest components; ties keep component order."""
    entries = F.array(*[
        F.struct((-F.coalesce(F.col(f"comp_{name}"), F.lit(float("-inf")))).alias("neg"), F.lit(i).alias("pos"),
                 F.lit(name).alias("name"))
        for i, name in enumerate(rules.COMPONENT_WEIGHTS)])
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.concat(
        e["name"], F.lit(": "), F.replace(F.format_number(-e["neg"], 1), F.lit(","), F.lit(""))))


def predict_score(probability: Column) -> Column:
    return npround(probability * 100, 1)


def display_fallback_score(df: DataFrame) -> DataFrame:
    """Score column for reports: ``risk_score_v2``, else ``risk_score``, else from the credit score."""
    if has(df, "risk_score_v2"):
        return df.withColumn("risk_score", F.col("risk_score_v2"))
    if has(df, "risk_score"):
        return df
    return df.withColumn("risk_score", npround(clip((900 - F.col("CreditScore")) / 6, 0, 100), 1))


def band_lookup(df: DataFrame, score_col: str) -> DataFrame:
    """Band, probability and action by an inclusive range join with the five-row band table."""
    bands = df.sparkSession.createDataFrame(
        [(float(lo), float(hi), b, p, a) for lo, hi, b, p, a in rules.RISK_BANDS],
        "lo double, hi double, band string, probability string, action string")
    _, _, band, prob, action = rules.RISK_BANDS[-1]
    s = F.col(score_col)
    # five fixed rows
    hit = df.join(F.broadcast(bands), (s >= F.col("lo")) & (s <= F.col("hi")), "left")
    return hit.withColumns({"band": F.coalesce("band", F.lit(band)), "probability": F.coalesce("probability", F.lit(prob)),
                            "action": F.coalesce("action", F.lit(action))}).drop("lo", "hi")
