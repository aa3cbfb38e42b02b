"""Special-situation rules, first match wins, and the outreach table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import clip, first_match, has, number_text, opt, or_default
from forewarn.operators.features import emi_simple

@dataclass
class Arm:
    """One outcome of a rule: when it applies and what it says."""
    when: Column
    scenario: str
    override: str | None
    message: Column | str | None
    reason: Column | str


def _num(c: Column, fmt: str) -> Column:
    return F.coalesce(number_text(c, fmt), F.lit("nan"))


def _money(c: Column) -> Column:
    return _num(c, "₹,.0f")


def _whole(c: Column) -> Column:
    return c.cast("long").cast("string")


def _render(template: str, fields: dict[str, Column]) -> Column:
    """Text with ``{field}`` marks as one concat; unknown marks stay as they are."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), fields[name]] if name in fields else [F.lit(head + "{" + name + "}")]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)


def _arm(when: Column, scenario: str, override: str | None, text: str, **fields: Column) -> Arm:
    message, reason = rules.SCENARIO_TEXTS[text]
    return Arm(when, scenario, override, message and _render(message, fields), _render(reason, fields))


def cash_businessman(df: DataFrame) -> list[Arm]:
    cdps, csr = or_default(opt(df, "cdps", 0.0), 0.0), or_default(opt(df, "cash_sufficiency_ratio", 0.0), 0.0)
    days, balance = opt(df, "cash_deposit_before_emi_days", 99.0), opt(df, "avg_monthly_balance_6m", 0.0)
    emi = emi_simple(df)
    hit = (opt(df, "segment_category") == "BUSINESS_OWNER") & (balance < emi) & (days <= 3)
    fields = dict(emi=_money(emi), days=_whole(days), balance=_money(balance), cdps=_num(cdps, ".0f"), csr=_num(csr, ".2f"))
    return [_arm(hit & (cdps > 70) & (csr >= 1.1), "CASH_BUSINESSMAN_RELIABLE", "MODERATE", "cash_reliable", **fields),
            _arm(hit, "CASH_BUSINESSMAN_STRESSED", "CRITICAL", "cash_stressed", **fields)]


def student_family(df: DataFrame) -> list[Arm]:
    student = F.contains(opt(df, "detailed_segment", "").cast("string"), F.lit("STUDENT"))
    stable, income = opt(df, "parent_income_stable", 1.0), opt(df, "parent_income_monthly", 0.0)
    supported = (income > 0) & (income > emi_simple(df) * 3)
    return [_arm(student & (stable == 0), "STUDENT_FAMILY_STRESS", "HIGH RISK", "student_stress"),
            _arm(student & supported, "STUDENT_FAMILY_STRONG", "LOW RISK", "student_strong")]


def multiple_loans(df: DataFrame) -> list[Arm]:
    loans = opt(df, "NumCreditLines", 1)
    dti = opt(df, "computed_dti") if has(df, "computed_dti") else opt(df, "DTIRatio", 30.0)
    return [_arm((loans >= 3) & (dti > 45), "MULTI_LOAN_STRESS", None, "multi_loan",
                 loans=_whole(loans), dti=_num(dti, ".1f"))]


def retired_healthcare(df: DataFrame) -> list[Arm]:
    spike = or_default(opt(df, "healthcare_spike_ratio", 1.0), 1.0)
    hit = (opt(df, "segment_category", "") == "RETIRED") & (spike > 3.0)
    fields = dict(emi_3x=_money(emi_simple(df) * 3), spike=_num(spike, ".1f"))
    return [_arm(hit & (opt(df, "monthly_pension", 0.0) > 0), "RETIRED_MEDICAL_EMERGENCY", "MODERATE",
                 "medical_pension", **fields),
            _arm(hit, "RETIRED_MEDICAL_EMERGENCY", "CRITICAL", "medical_no_pension", **fields)]


def gig_suspension(df: DataFrame) -> list[Arm]:
    zero_days = or_default(opt(df, "zero_income_days_month", 0.0), 0.0)
    platforms = or_default(opt(df, "multi_platform_count", 1.0), 1.0)
    hit = (opt(df, "segment_category", "") == "SELF_EMPLOYED") & (zero_days > 10)
    fields = dict(emi=_money(emi_simple(df)), zero_days=_whole(zero_days), platforms=_whole(platforms))
    return [_arm(hit & (platforms > 1), "GIG_PARTIAL_SUSPENSION", "MODERATE", "gig_partial", **fields),
            _arm(hit, "GIG_FULL_SUSPENSION", "CRITICAL", "gig_full", **fields)]


def employer_layoff(df: DataFrame) -> list[Arm]:
    peer = or_default(opt(df, "peer_default_rate", 0.0), 0.0)
    stress = or_default(opt(df, "industry_stress_index", 30.0), 30.0)
    health = or_default(opt(df, "employer_health_score", 70.0), 70.0)
    hit = (opt(df, "segment_category", "") == "EMPLOYED") & ((peer > 0.15) | ((stress > 70) & (health < 40)))
    return [_arm(hit, "EMPLOYER_LAYOFF_RISK", None, "layoff", peer_rate=_num(peer, ".1%"),
                 stress=F.coalesce(stress.cast("string"), F.lit("nan")))]


SCENARIOS = [cash_businessman, student_family, multiple_loans, retired_healthcare, gig_suspension, employer_layoff]


def match(df: DataFrame, rules_=None, texts: bool = True) -> DataFrame:
    """Adds ``scenario`` and ``risk_override`` of the first rule that applies (null without one).

    One chain finds the number of the first matching outcome; names, overrides
    and, with ``texts``, ``scenario_message`` and ``scenario_reason`` hang off that number.
    """
    arms = [arm for rule in (rules_ or SCENARIOS) for arm in rule(df)]
    hit = F.col("_arm")

    def pick(attr: str) -> Column:
        out = F.lit(None).cast("string")
        values = [(i, getattr(a, attr)) for i, a in enumerate(arms) if getattr(a, attr) is not None]
        return first_match(*[(hit == i, v if isinstance(v, Column) else F.lit(v)) for i, v in values],
                           otherwise=out) if values else out

    added = {"scenario": pick("scenario"), "risk_override": pick("override")}
    if texts:
        added |= {"scenario_message": pick("message"), "scenario_reason": pick("reason")}
    return df.withColumn("_arm", first_match(*[(a.when, F.lit(i)) for i, a in enumerate(arms)])).withColumns(
        added).drop("_arm")


def resolve(df: DataFrame, texts: bool = False) -> DataFrame:
    """Adds the first matching scenario and ``final_band`` = override or scored band."""
    return match(df, texts=texts).withColumn("final_band", F.coalesce("risk_override", "risk_band"))


def at_risk(df: DataFrame) -> DataFrame:
    return df.where(F.col("risk_band").isin(rules.AT_RISK_BANDS))


def message(df: DataFrame, band: Column, days_to_emi: Column) -> Column:
    """Outreach text of a band, whole; null for bands without one.  A missing name or amount never removes the text."""
    emi = emi_simple(df)
    loan_id = F.coalesce(opt(df, "LoanID", "").cast("string"), F.lit(""))
    fields = {
        "name": F.coalesce(opt(df, "name", None).cast("string"), F.concat(F.lit("Customer "), loan_id)),
        "emi": _num(emi, ",.0f"), "emi_3x": _num(emi * 3, ",.0f"), "emergency_loan": _num(emi * 2, ",.0f"),
        "due_date": F.lit(rules.DUE_DATE_TEXT), "days_to_emi": days_to_emi.cast("string"),
    }
    fields = {n: F.coalesce(c, F.lit("")) for n, c in fields.items()}
    return first_match(*[(band == b, _render(t, fields)) for b, (_, _, t) in rules.INTERVENTIONS.items()])


def stable_days(key: Column) -> Column:
    """Repeatable 3..20 days from a key."""
    return F.pmod(F.xxhash64(key), F.lit(18)) + 3


def interventions(df: DataFrame, days_to_emi: Column | None = None) -> DataFrame:
    """One row per at-risk customer whose final band has an outreach text."""
    days = stable_days(F.col("LoanID")) if days_to_emi is None else days_to_emi
    hit = resolve(at_risk(df)).where(F.col("final_band").isin(list(rules.INTERVENTIONS)))
    band = F.col("final_band")
    channel = first_match(*[(band == b, F.array(*map(F.lit, ch))) for b, (ch, _, _) in rules.INTERVENTIONS.items()])
    timing = first_match(*[(band == b, F.lit(t)) for b, (_, t, _) in rules.INTERVENTIONS.items()])
    return hit.select(
        F.col("LoanID"), band.alias("risk_band"), opt(df, "risk_score_v2", 0.0).alias("risk_score"),
        channel.alias("channel"), timing.alias("timing"), message(hit, band, days).alias("message"),
        F.col("scenario"))


def display_action(band: Column) -> Column:
    arms = [(band == b, F.struct(F.lit(t).alias("text"), F.lit(c).alias("colour")))
            for b, (t, c) in rules.DISPLAY_ACTIONS.items()]
    text, colour = rules.DISPLAY_ACTION_DEFAULT
    return first_match(*arms, otherwise=F.struct(F.lit(text).alias("text"), F.lit(colour).alias("colour")))


def severity(c: Column, thresholds, higher_is_worse: bool) -> Column:
    within = (lambda t: c <= t) if higher_is_worse else (lambda t: c >= t)
    return F.when(c.isNotNull(), first_match(*[(within(t), F.lit(i)) for i, t in enumerate(thresholds)],
                                             otherwise=F.lit(len(thresholds))))


def factors(df: DataFrame, n: int = 8) -> Column:
    """Worst metrics first (ties keep their fixed order), missing metrics left out."""
    entries = []
    for i, (label, name, thresholds, worse, fmt) in enumerate(rules.FACTORS):
        if not has(df, name):
            continue
        c = F.col(name)
        sev = severity(c, thresholds, worse)
        entries.append(F.when(c.isNotNull(), F.struct(
            (-sev).alias("rank"), F.lit(i).alias("pos"), F.lit(label).alias("label"),
            number_text(c, fmt).alias("value"),
            F.element_at(F.array(*map(F.lit, rules.SEVERITY_LABELS)), sev + 1).alias("severity"),
            clip((sev + 1) / 4 * 100, 15, 100).alias("bar_pct"))))
    kept = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, n)
    return F.transform(kept, lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value"),
                                                e["severity"].alias("severity"), e["bar_pct"].alias("bar_pct")))


def customer_card(df: DataFrame) -> Column:
    """``["label: value", ...]`` of the six headline metrics, missing ones left out."""
    return F.array_compact(F.array(*[
        F.concat(F.lit(f"{label}: "), number_text(F.col(name), fmt))
        for label, name, fmt in rules.CARD_METRICS if has(df, name)]))
