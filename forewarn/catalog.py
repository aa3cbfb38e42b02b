"""Every operator as a named query over the star-schema tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions import semantics as sem
from forewarn.functions.semantics import npround
from forewarn.operators import (
    boosting, derived, documents, explain, features, history, metrics, ml, online, reporting, scenarios, scoring, tables,
)
from forewarn.plans import workflow
from forewarn.session import configure
from forewarn.sources import io
from forewarn.sources.adapters import (
    accounts, as_transactions, enriched_snapshot, loan_snapshot, table, transactions,
)
from forewarn.streaming import alerts, ordered

col = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        return fn
    return register


# --- shared inputs -----------------------------------------------------------

def featured(spark, d) -> DataFrame:
    return features.run(loan_snapshot(spark, d), healthcare_multiplier=col("healthcare_multiplier"))


def scored(spark, d, impute=False) -> DataFrame:
    return scoring.score(featured(spark, d), impute)


def key_days():
    return col("LoanID") % 18 + 3


def outreach(spark, d) -> DataFrame:
    return scenarios.interventions(scored(spark, d), key_days())


# stand-in model outputs, so that the metric queries have an exact SQL twin
GIVEN = {"booster_a": (37, 900, 0.1), "booster_b": (53, 800, 0.2), "random_forest": (71, 950, 0.05),
         "logistic": (89, 700, 0.3)}


def given_probabilities(spark, d) -> DataFrame:
    base = loan_snapshot(spark, d).select("LoanID", "Default")
    p = {f"p_{n}": (col("LoanID") * a % m).cast("double") / 1000 + col("Default") * w for n, (a, m, w) in GIVEN.items()}
    return base.withColumns(p).withColumn("ensemble_probability", npround(ml.weighted_probability(list(GIVEN)), 6))


# --- sources and sinks -------------------------------------------------------

@query("s1_parquet_scan")
def _(spark, d):
    return table(spark, d, "orders").where(col("o_totalprice") > 200000).select("o_orderkey", "o_totalprice")


@query("s2_csv_scan")
def _(spark, d):
    names = ["LoanID", "Age", "Income", "LoanAmount", "CreditScore", "MonthsEmployed", "NumCreditLines",
             "InterestRate", "LoanTerm", "DTIRatio", "EmploymentType"]
    path = io.work_dir(spark, "raw")
    io.write_csv(enriched_snapshot(spark, d).select(*names), path)
    schema = ", ".join(f.strip() for f in io.RAW_LOAN_SCHEMA.split(",") if f.split()[0] in names)
    return io.read_csv(spark, path, schema)


@query("s3_path_fallback")
def _(spark, d):
    found = io.load_best(spark, [f"{d}/scored_v2.parquet", f"{d}/scored.parquet", f"{d}/customer.parquet"])
    return found.select("c_custkey", "c_acctbal")


@query("s4_parquet_sink")
def _(spark, d):
    path = io.work_dir(spark, "scored")
    io.write_scored(scored(spark, d).select("LoanID", "risk_score_v2", "risk_band"), path)
    return spark.read.parquet(path).select("LoanID", "risk_score_v2", "risk_band")


@query("s5_csv_sink")
def _(spark, d):
    path = io.work_dir(spark, "interventions")
    io.write_csv(outreach(spark, d), path)
    schema = ("LoanID long, risk_band string, risk_score double, channel string, timing string, message string, "
              "scenario string")
    back = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path, header=True)
    return back.select("LoanID", "risk_band", "risk_score", "channel", "timing", "message", "scenario")


@query("s6_sample_sink")
def _(spark, d):
    path = io.work_dir(spark, "sample")
    io.write_sample(loan_snapshot(spark, d).select("LoanID", "Income", "LoanAmount", "segment_category"), "LoanID", path)
    return spark.read.schema("LoanID long, Income double, LoanAmount double, segment_category string").csv(
        path, header=True)


@query("s7_json_lines")
def _(spark, d):
    path = io.work_dir(spark, "profiles")
    io.write_json(documents.assemble(accounts(spark, d), PAGE), path)
    back = io.read_json(spark, path, documents.PROFILE_SCHEMA)
    return documents.flatten(back).select("customer_id", "fip_id", "account_type", "balance", "is_primary", "emi",
                                          "outstanding")


def _txn_json(spark, d):
    t = transactions(spark, d)
    return t.select("event_id", F.to_json(F.struct(
        "customer_id", "type", "amount", "category",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "monthly_income")).alias("value"))


@query("s8_json_events")
def _(spark, d):
    return alerts.parse_json(_txn_json(spark, d))


def _txn_stream(spark, d):
    schema = table(spark, d, "events").schema
    raw = alerts.file_events(spark, f"{d}/events.parquet", schema, max_files=100)
    return as_transactions(raw)


def _consumed(spark, stream, name):
    out = io.work_dir(spark, name)
    alerts.consume(stream, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


@query("s9_bounded_consume")
def _(spark, d):
    return _consumed(spark, alerts.clean(_txn_stream(spark, d)), "consume").select(
        "event_id", "customer_id", "type", "amount", "category", "ts", "monthly_income")


@query("s10_alert_sink")
def _(spark, d):
    out = io.work_dir(spark, "alert-sink")
    query_ = alerts.alert_sink(
        alerts.alerts(_txn_stream(spark, d)),
        lambda df, batch_id: df.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}"), f"{out}/checkpoint")
    query_.awaitTermination()
    return _alert_text(spark.read.parquet(f"{out}/data").drop("batch"))


# --- projections and predicates ----------------------------------------------

@query("p1_optional_filled")
def _(spark, d):
    s = loan_snapshot(spark, d)
    return s.select("LoanID", sem.opt(s, "industry_stress_index", 30.0, fill=True).alias("stress"),
                    sem.opt(s, "not_there", 7.0, fill=True).alias("absent"))


@query("p2_optional_absent")
def _(spark, d):
    s = loan_snapshot(spark, d)
    return s.select("LoanID", sem.opt(s, "industry_stress_index", 30.0).alias("stress"),
                    sem.opt(s, "dining_out_monthly", 0.0).alias("dining"))


@query("p3_right_closed_bands")
def _(spark, d):
    return loan_snapshot(spark, d).select("LoanID", sem.cut(col("DTIRatio"), *rules.DTI_BANDS).alias("dti_band"),
                                          sem.cut(col("Age"), [18, 25, 40, 60], ["young", "mid", "senior"]).alias("age_band"))


@query("p4_nested_bands")
def _(spark, d):
    return features.salary_delay_trend(loan_snapshot(spark, d).withColumn(
        "salary_delay_days", F.when(col("LoanID") % 3 > 0, col("salary_delay_days")))).select("LoanID", "sdt", "sdt_band")


@query("p5_clip")
def _(spark, d):
    return loan_snapshot(spark, d).select("LoanID", sem.clip(col("peer_default_rate"), 0.1, 0.2).alias("both"),
                                          sem.clip(col("income_cv_daily"), lo=0.5).alias("low"),
                                          sem.clip(col("CreditScore"), hi=700).alias("high"))


@query("p6_half_even_round")
def _(spark, d):
    c = col("LoanID") / 8
    return loan_snapshot(spark, d).select("LoanID", *[npround(c, n).alias(f"r{n}") for n in (0, 1, 2)])


@query("p7_null_fill")
def _(spark, d):
    s = loan_snapshot(spark, d).select("LoanID", "industry_stress_index", "peer_default_rate", "income_cv_daily")
    return s.na.fill(rules.MISSING_FILL)


@query("p8_value_map")
def _(spark, d):
    return loan_snapshot(spark, d).select("LoanID", sem.map_values(
        col("segment_category"), rules.SEGMENT_VOLATILITY, rules.DEFAULT_VOLATILITY).alias("cv"))


@query("p9_select_by_prefix")
def _(spark, d):
    s = loan_snapshot(spark, d)
    return s.select("LoanID", *sem.select_cols(s, prefix="expense_"), *sem.select_cols(s, suffix="_30d"))


@query("p10_drop_present")
def _(spark, d):
    s = loan_snapshot(spark, d).select("LoanID", "Default", "Income", "Age")
    return tables.drop_present(s, ["Default", "days_to_default", "Age"])


@query("p11_align_features")
def _(spark, d):
    return tables.align(loan_snapshot(spark, d), ["Income", "unknown_feature", "Age", "CreditScore"], keep=["LoanID"])


@query("p12_feature_mismatch")
def _(spark, d):
    s = loan_snapshot(spark, d).select("LoanID", "Income")
    return tables.probability_or_fallback(s, ["Income", "unknown_feature"], lambda df: df)


@query("p13_membership")
def _(spark, d):
    return loan_snapshot(spark, d).where(col("segment_category").isin("RETIRED", "STUDENT")).select(
        "LoanID", "segment_category")


@query("p14_range_filter")
def _(spark, d):
    return loan_snapshot(spark, d).where((col("segment_category") == "EMPLOYED") & col("DTIRatio").between(30, 45)).select(
        "LoanID", "DTIRatio")


@query("p15_key_lookup")
def _(spark, d):
    wanted = table(spark, d, "orders").where(col("o_orderstatus") == "F").select(
        col("o_orderkey").cast("string").alias("id"))
    return reporting.lookup_many(loan_snapshot(spark, d), "LoanID", wanted, "id").select("LoanID", "LoanAmount")


@query("p16_column_alias")
def _(spark, d):
    s = derived.alias_columns(enriched_snapshot(spark, d).select("LoanID", "EmploymentType", "Income", "CreditScore"))
    return scoring.display_fallback_score(s).select("LoanID", "employment_type", "monthly_income", "risk_score")


@query("p17_request_defaults")
def _(spark, d):
    s = loan_snapshot(spark, d)
    return tables.apply_defaults(s.select("LoanID", "Age", "Income", F.when(
        col("LoanID") % 2 == 0, col("CreditScore")).alias("CreditScore"), "segment_category"))


@query("p18_keep_last")
def _(spark, d):
    s = loan_snapshot(spark, d).select("customer_id", "LoanID", "event_timestamp", "LoanAmount")
    return tables.keep_last(s, "customer_id", ["event_timestamp", "LoanID"])


@query("p19_safe_divide")
def _(spark, d):
    return loan_snapshot(spark, d).select("LoanID", npround(
        sem.safe_divide(col("LoanAmount"), col("industry_stress_index")), 4).alias("ratio"))


@query("p20_label_encode")
def _(spark, d):
    s = loan_snapshot(spark, d).select("LoanID", F.when(
        col("LoanID") % 7 > 0, col("detailed_segment")).alias("detailed_segment"))
    return tables.label_encode(s, "detailed_segment").select("LoanID", "detailed_segment", "detailed_segment_code")


# --- joins and lookups -------------------------------------------------------

@query("j1_attach_components")
def _(spark, d):
    s = scored(spark, d)
    return s.select("LoanID", *[npround(col(f"comp_{c}"), 4).alias(f"comp_{c}") for c in rules.COMPONENT_WEIGHTS])


@query("j2_segment_lookup")
def _(spark, d):
    s = loan_snapshot(spark, d).select("LoanID", "detailed_segment")
    return derived.lookup_segment(s, derived.segment_dimension(spark)).select(
        "LoanID", "detailed_segment", "category", "sub_category", "income_source")


@query("j3_band_lookup")
def _(spark, d):
    return scoring.band_lookup(scored(spark, d, impute=True).select("LoanID", "risk_score_v2"), "risk_score_v2")


@query("j4_point_in_time")
def _(spark, d):
    s = loan_snapshot(spark, d)
    spine = s.where(col("LoanID") % 2 == 0).select("customer_id", "event_timestamp", "LoanID")
    view = s.where(col("LoanID") % 2 == 1).select("customer_id", "event_timestamp", "LoanID", "LoanAmount", "DTIRatio",
                                                 "CreditScore")
    return history.point_in_time(spine, view, "customer_id", "event_timestamp", ["LoanAmount", "DTIRatio", "CreditScore"],
                                 ttl_hours=90 * 24, spine_key="LoanID", tiebreak="LoanID")


@query("j5_online_latest")
def _(spark, d):
    f = features.run(loan_snapshot(spark, d), healthcare_multiplier=col("healthcare_multiplier"))
    _, names = history.view_features("core_financial_features", f)
    return history.online_latest(f, "customer_id", "event_timestamp", names, 365 * 24,
                                 F.to_timestamp(F.lit("2001-01-01 00:00:00")), "LoanID")


@query("j5_online_store")
def _(spark, d):
    """The same reading from a store that was published in four batches, one of them twice, and compacted on the way."""
    f = features.run(loan_snapshot(spark, d), healthcare_multiplier=col("healthcare_multiplier"))
    _, names = history.view_features("core_financial_features", f)
    what = dict(entity="customer_id", ts="event_timestamp", features=names, ttl_hours=365 * 24, tiebreak="LoanID")
    root = io.work_dir(spark, "online")
    for i in (0, 1, 1, 2, 3):
        online.publish(f.where(col("LoanID") % 4 == i), i, root, history=100 * 365 * 86_400, every=2, **what)
    return online.latest(spark, root, as_of=F.to_timestamp(F.lit("2001-01-01 00:00:00")), **what)


@query("j6_profile_loan_join")
def _(spark, d):
    loans = tables.keep_last(loan_snapshot(spark, d).select(
        "customer_id", "LoanID", "event_timestamp", "Default", "Income"), "customer_id", ["event_timestamp", "LoanID"])
    return documents.join_loans(documents.rollup_flat(accounts(spark, d)), loans)


@query("j7_weight_join")
def _(spark, d):
    g = given_probabilities(spark, d)
    long = g.select("LoanID", F.explode(F.array(*[F.struct(
        F.lit(n).alias("model"), col(f"p_{n}").alias("probability")) for n in GIVEN])).alias("m")).select("LoanID", "m.*")
    return ml.weighted_long(long, "LoanID").withColumn("ensemble_probability", npround(col("ensemble_probability"), 6))


# --- feature formulas --------------------------------------------------------

def _formula(name, fn, *outputs, **kw):
    @query(name)
    def _(spark, d):
        return fn(loan_snapshot(spark, d), **{k: v() for k, v in kw.items()}).select("LoanID", *outputs)


_formula("f1_income_stability", features.income_stability, "isi", "isi_band")
_formula("f2_debt_to_income", features.debt_to_income, "computed_dti", "dti_band")
_formula("f3_savings_rate", features.savings_rate, "savings_rate_pct", "savings_band")
_formula("f4_emi_cushion", features.emi_cushion, "eci", "eci_band")
_formula("f5_expenditure_volatility", features.expenditure_volatility, "evs", "evs_ratio")
_formula("f6_salary_delay_trend", features.salary_delay_trend, "sdt", "sdt_band")
_formula("f7_cash_deposit_pattern", features.cash_deposit_pattern, "cdps", "cash_sufficiency_ratio", "cdps_band")
_formula("f8_discretionary_spending", features.discretionary_spending, "dsr", "dsr_band")
_formula("f9_payment_timing", features.payment_timing, "ptc", "ptc_band")
_formula("f10_balance_trajectory", features.balance_trajectory, "abt", "abt_band")
_formula("f11_subscription_cascade", features.subscription_cascade, "subscription_cascade_score")
_formula("f12_wallet_velocity", features.wallet_velocity, "wallet_velocity", "wallet_velocity_band")
_formula("f13_merchant_downgrade", features.merchant_downgrade, "merchant_downgrade_score", "merchant_downgrade_band")
_formula("f14_healthcare_spike", features.healthcare_spike, "healthcare_current_spend", "healthcare_spike_ratio",
         "healthcare_spike_band", multiplier=lambda: col("healthcare_multiplier"))
_formula("f15_employer_contagion", features.employer_contagion, "employer_risk_multiplier")
_formula("f16_gig_income_variance", features.gig_income_variance, "gig_cv_band")

CROSS = ["income_per_dependent", "emi_to_savings_ratio", "total_debt_to_assets", "credit_score_x_dti",
         "credit_score_x_util", "credit_lines_per_year", "bounce_per_credit_line", "auto_debit_x_ontime",
         "income_stability_x_dti", "age_x_credit_score", "digital_engagement_score", "financial_stress_index",
         "months_of_runway", "loan_burden_score"]


@query("f17_cross_features")
def _(spark, d):
    base = derived.totals(enriched_snapshot(spark, d)).transform(derived.behavioral_flags)
    return features.run(base, healthcare_multiplier=col("healthcare_multiplier")).select("LoanID", *CROSS)


FEATURED = ["isi", "isi_band", "computed_dti", "dti_band", "savings_rate_pct", "savings_band", "eci", "eci_band", "evs",
            "evs_ratio", "sdt", "sdt_band", "cdps", "cash_sufficiency_ratio", "cdps_band", "dsr", "dsr_band", "ptc",
            "ptc_band", "abt", "abt_band", "subscription_cascade_score", "wallet_velocity", "wallet_velocity_band",
            "merchant_downgrade_score", "merchant_downgrade_band", "healthcare_current_spend",
            "healthcare_spike_ratio", "healthcare_spike_band", "employer_risk_multiplier", "gig_cv_band"]


@query("f18_all_features")
def _(spark, d):
    return featured(spark, d).select("LoanID", *FEATURED, *CROSS)


@query("f19_feature_summary")
def _(spark, d):
    s = features.summary(featured(spark, d))
    return s.select("feature", *[npround(col(c), 6).alias(c) for c in ("mean", "std", "min", "max")])


# --- history -----------------------------------------------------------------

def _history(name, fn, **kw):
    @query(name)
    def _(spark, d):
        return fn(transactions(spark, d), **kw)


_history("h1_income_stability", history.income_stability, period="week")
_history("h2_expenditure_volatility", history.expenditure_volatility, period="week")
_history("h3_salary_delay", history.salary_delay, expected_day=1)


@query("h4_deposits_before_due")
def _(spark, d):
    t = transactions(spark, d)
    dues = t.where(col("type") == "payment").select("customer_id", "ts", col("event_id").alias("due_id"))
    return history.deposits_before_due(t.where(col("type") == "credit"), dues, days=3)


_history("h5_payment_timing", history.payment_timing, expected_day=15)
_history("h6_balance_trajectory", history.balance_trajectory, period="week", opening=1000.0)
_history("h7_healthcare_ratio", history.healthcare_ratio, period="week", trailing=2)
_history("h8_gig_variance", history.gig_variance)
_history("h9_discretionary_drop", history.discretionary_drop, period="week")


# --- derived columns ---------------------------------------------------------

@query("e1_segment_assignment")
def _(spark, d):
    base = enriched_snapshot(spark, d).select("LoanID", "EmploymentType", "Age")
    return derived.assign_segment(base, col("LoanID") * 7919 % derived.BUCKETS).select(
        "LoanID", "detailed_segment", "segment_category")


@query("e2_totals")
def _(spark, d):
    return derived.totals(enriched_snapshot(spark, d)).select(
        "LoanID", "total_monthly_expense", "savings_rate", "total_financial_assets", "total_assets",
        "asset_to_debt_ratio", "manual_payment_pct")


@query("e3_enrichment_ratios")
def _(spark, d):
    return derived.enrichment_ratios(derived.totals(enriched_snapshot(spark, d))).select(
        "LoanID", "emi_to_income_ratio", "expense_to_income_ratio", "liquidity_ratio", "debt_service_coverage",
        "net_worth", "financial_cushion_months")


@query("e4_behavioral_flags")
def _(spark, d):
    return derived.behavioral_flags(enriched_snapshot(spark, d)).select("LoanID", "behavioral_risk_score")


@query("e5_category_stability")
def _(spark, d):
    return derived.category_stability(loan_snapshot(spark, d)).select("LoanID", "income_stability_index")


@query("e6_loan_instalment")
def _(spark, d):
    base = enriched_snapshot(spark, d).withColumn(
        "InterestRate", F.when(col("LoanID") % 9 == 0, 0.0).otherwise(col("InterestRate")))
    return derived.loan_instalment(base).select("LoanID", "emi", "DTIRatio")


@query("e7_ledger_ratios")
def _(spark, d):
    base = derived.loan_instalment(derived.totals(enriched_snapshot(spark, d)))
    return derived.ledger_ratios(base).select(
        "LoanID", "emi_to_income_ratio", "emi_to_savings_ratio", "liquidity_ratio", "financial_cushion_months",
        "debt_service_coverage", "months_of_runway", "bounce_per_credit_line", "loan_burden_score")


def _generator_segments(spark, d):
    """Employment types in the vocabulary the label model branches on."""
    return enriched_snapshot(spark, d).withColumn("EmploymentType", F.when(
        col("segment_category") == "SELF_EMPLOYED", "GIG_WORKER").otherwise(col("segment_category"))).withColumns({
            c: F.coalesce(c, F.lit(v)) for c, v in (("peer_default_rate", 0.05), ("employer_health_score", 70.0))})


@query("e8_default_logit")
def _(spark, d):
    return derived.default_logit(_generator_segments(spark, d)).select(
        "LoanID", npround(col("default_logit"), 6).alias("default_logit"), "delinquency_prob")


@query("e9_stress_composite")
def _(spark, d):
    return derived.stress_composite(enriched_snapshot(spark, d)).select("LoanID", "financial_stress_score")


@query("e10_behavioral_composite")
def _(spark, d):
    return derived.behavioral_composite(enriched_snapshot(spark, d)).select("LoanID", "behavioral_risk_score")


@query("e11_engagement")
def _(spark, d):
    return derived.engagement(enriched_snapshot(spark, d)).select("LoanID", "stress_factor", "digital_engagement_score")


@query("e12_display_score")
def _(spark, d):
    return scoring.display_fallback_score(loan_snapshot(spark, d)).select("LoanID", "risk_score")


# --- risk score --------------------------------------------------------------

def _component(number, name):
    @query(f"r{number}_{name}")
    def _(spark, d):
        f = featured(spark, d)
        return f.select("LoanID", npround(scoring.component(f, name), 6).alias("component"),
                        npround(scoring.component(f, name, impute_missing=True), 6).alias("component_imputed"))


for _n, _name in enumerate(scoring.COMPONENTS, 1):
    _component(_n, _name)


@query("r16_weighted_score")
def _(spark, d):
    a = scored(spark, d)
    imputed = scoring.weighted_score(lambda name: scoring.component(a, name, impute_missing=True))
    return a.select("LoanID", "risk_score_v2", imputed.alias("risk_score_imputed"))


@query("r17_classify")
def _(spark, d):
    s = scored(spark, d, impute=True).select("LoanID", "risk_score_v2", "risk_band")
    return s.select("LoanID", "risk_band", scoring.band_probability(col("risk_band")).alias("probability"),
                    scoring.band_action(col("risk_band")).alias("action"),
                    scoring.classify(col("risk_score_v2"), "contiguous").alias("contiguous_band"))


@query("r18_batch_scoring")
def _(spark, d):
    s = scored(spark, d)
    return s.select("LoanID", "risk_score_v2", "risk_band",
                    *[npround(col(f"comp_{c}"), 4).alias(f"comp_{c}") for c in rules.COMPONENT_WEIGHTS])


@query("r19_predict_bands")
def _(spark, d):
    g = given_probabilities(spark, d).withColumn("risk_score", scoring.predict_score(col("ensemble_probability")))
    return g.select("LoanID", npround(col("ensemble_probability"), 4).alias("default_probability"), "risk_score",
                    scoring.classify(col("risk_score"), "predict").alias("risk_band"))


@query("r20_display_bands")
def _(spark, d):
    s = scoring.display_fallback_score(loan_snapshot(spark, d)).withColumn("wide", col("risk_score") * 1.5 - 20)
    return s.select("LoanID", scoring.classify(col("risk_score"), "display").alias("risk_category"),
                    scoring.classify(col("wide"), "display").alias("wide_category"))


@query("r21_top_components")
def _(spark, d):
    s = scored(spark, d, impute=True)
    return s.select("LoanID", F.array_join(scoring.top_components(s), "|").alias("top_factors"))


# --- aggregations ------------------------------------------------------------

@query("a1_band_distribution")
def _(spark, d):
    return reporting.band_distribution(scored(spark, d))


@query("a2_value_counts")
def _(spark, d):
    return reporting.value_counts(loan_snapshot(spark, d), "detailed_segment")


@query("a3_segment_default_rate")
def _(spark, d):
    return reporting.segment_default_rate(enriched_snapshot(spark, d))


@query("a4_score_stats")
def _(spark, d):
    s = reporting.score_stats(scored(spark, d, impute=True))
    return s.select("n", npround(col("mean"), 4).alias("mean"), npround(col("median"), 4).alias("median"),
                    npround(col("std"), 4).alias("std"))


@query("a5_default_rate")
def _(spark, d):
    return reporting.default_rate(loan_snapshot(spark, d))


@query("a6_distinct_count")
def _(spark, d):
    return reporting.distinct_count(loan_snapshot(spark, d), "detailed_segment")


@query("a7_kpis")
def _(spark, d):
    return reporting.kpis(scored(spark, d))


@query("a8_exposure_text")
def _(spark, d):
    by = loan_snapshot(spark, d).groupBy("customer_id").agg(npround(F.sum("LoanAmount"), 2).alias("exposure"))
    return by.select("customer_id", reporting.exposure_text(col("exposure")).alias("text"),
                     reporting.exposure_text(col("exposure") / 100).alias("small_text"))


@query("a9_crosstab")
def _(spark, d):
    return reporting.crosstab(scored(spark, d, impute=True), "segment_category")


@query("a10_score_histogram")
def _(spark, d):
    s = scored(spark, d, impute=True).select(F.rint("risk_score_v2").alias("risk_score_v2"))
    return reporting.score_histogram(s)


@query("a11_scenario_counts")
def _(spark, d):
    return reporting.scenario_counts(scenarios.resolve(scenarios.at_risk(scored(spark, d))))


@query("a12_monitoring")
def _(spark, d):
    s = scored(spark, d)
    return reporting.monitoring(s, scenarios.interventions(s, key_days()))


@query("a13_service_roi")
def _(spark, d):
    return reporting.service_roi(outreach(spark, d))


def _prediction_log(spark, d):
    return scored(spark, d).select("LoanID", col("event_timestamp").alias("ts"), F.when(
        col("LoanID") % 10 > 0, col("risk_score_v2")).otherwise(0.0).alias("risk_score"), "risk_band")


@query("a14_prediction_log_stats")
def _(spark, d):
    return reporting.prediction_log_stats(_prediction_log(spark, d)).select(
        "total_predictions", "avg_risk_score", *["n_" + b.lower().replace(" ", "_") for b in rules.BAND_NAMES],
        col("latest.LoanID").alias("latest_loan"), col("latest.risk_band").alias("latest_band"))


LOG_SINCE = "1996-01-01 00:00:00"


@query("a14_log_retention")
def _(spark, d):
    since = F.lit(LOG_SINCE).cast("timestamp")
    return reporting.retain_since(_prediction_log(spark, d), since).select("LoanID", "ts", "risk_band")


@query("a15_row_aggregates")
def _(spark, d):
    s = loan_snapshot(spark, d)
    cols = [col(c) for c in sem.select_cols(s, prefix="expense_")]
    return s.select("LoanID", npround(sem.row_sum(cols), 2).alias("total"), npround(sem.row_std(cols), 4).alias("std"))


# fixed linear model for the explanation queries
LINEAR = {"CreditScore": -0.006, "DTIRatio": 0.025, "ontime_payment_rate_12m": -2.0, "max_dpd_last_12m": 0.03,
          "avg_delay_days": 0.02}
INTERCEPT = 3.0


def _contributions(spark, d):
    return explain.linear_contributions(loan_snapshot(spark, d), LINEAR, INTERCEPT)


@query("a16_mean_abs_contribution")
def _(spark, d):
    wide = _contributions(spark, d).select(*[
        F.get("contributions", F.lit(i))["impact"].alias(n) for i, n in enumerate(LINEAR)])
    return explain.mean_abs(wide, list(LINEAR)).withColumn("mean_abs_impact", npround(col("mean_abs_impact"), 6))


# --- windows, top-k, splits --------------------------------------------------

@query("w1_band_top_list")
def _(spark, d):
    return reporting.band_top_list(scored(spark, d, impute=True), clicks=1).select(
        "LoanID", "risk_band", "risk_score_v2", "rank", "band_total", "has_more")


def _factor_text(name):
    return F.array_join(F.transform(name, lambda e: F.concat(
        e["feature"], F.lit("="), e["impact"].cast("decimal(20,4)").cast("string"))), "|")


@query("w2_top_contributions")
def _(spark, d):
    t = explain.top_factors(_contributions(spark, d), 2)
    return t.select("LoanID", _factor_text("top_risk_up").alias("up"), _factor_text("top_risk_down").alias("down"))


@query("w3_top_importance")
def _(spark, d):
    # one importance row per part: its share of revenue
    by = table(spark, d, "lineitem").groupBy(col("l_partkey").cast("string").alias("feature")).agg(
        npround(F.sum("l_extendedprice"), 2).alias("importance"))
    return reporting.top_importance(by, 30).select("feature", "importance", npround(col("scaled"), 6).alias("scaled"))


@query("w4_top_factors")
def _(spark, d):
    f = _factor_frame(spark, d)
    return f.select("LoanID", F.array_join(F.transform(
        scenarios.factors(f), lambda e: F.concat(e["severity"], F.lit(":"), e["label"])), "|").alias("factors"))


TOTAL_COLS = ["transaction_count", "total_credits", "total_debits", "current_balance_estimate", "payment_failures",
              "healthcare_spend", "last_salary_date", "baseline_monthly_income", "consecutive_failures"]


def _totals_out(df):
    money = {"total_credits", "total_debits", "current_balance_estimate", "healthcare_spend"}
    return df.select("event_id", "customer_id", *[
        (npround(col(c), 2) + F.lit(0.0)).alias(c) if c in money else col(c) for c in TOTAL_COLS])


@query("w5_running_totals")
def _(spark, d):
    return _totals_out(alerts.running_totals(transactions(spark, d))).drop("consecutive_failures")


@query("w6_consecutive_failures")
def _(spark, d):
    return _totals_out(alerts.running_totals(transactions(spark, d))).select("event_id", "consecutive_failures")


@query("w7_random_subsample")
def _(spark, d):
    return tables.random_subsample(loan_snapshot(spark, d).select("LoanID", "LoanAmount"), 1000, "LoanID",
                                   order=col("LoanID") * 7919 % 100003, space=100003)


@query("w8_stratified_split")
def _(spark, d):
    return tables.stratified_split(loan_snapshot(spark, d).select("LoanID", "Default"), "Default", "LoanID",
                                   order=col("LoanID") * 7919 % 100003, space=100003)


# --- account profiles --------------------------------------------------------

@query("n1_flatten_accounts")
def _(spark, d):
    return documents.flatten(documents.assemble(accounts(spark, d), PAGE)).select(
        "customer_id", "fip_id", "account_type", "balance", "is_primary", "emi", "outstanding")


PAGE = 10_000


@query("n2_profile_rollup")
def _(spark, d):
    return documents.rollup(documents.assemble(accounts(spark, d), PAGE))


@query("n2_account_rollup")
def _(spark, d):
    return documents.rollup_flat(accounts(spark, d))


@query("n3_assemble_profiles")
def _(spark, d):
    return documents.assemble(accounts(spark, d), PAGE).select(
        "customer_id", "page", F.size("accounts").alias("n_accounts"),
        F.array_join(F.transform("accounts", lambda a: a["fip_id"]), ",").alias("banks"),
        npround(F.aggregate("accounts", F.lit(0.0), lambda s, a: s + F.coalesce(a["balance"], F.lit(0.0))), 4).alias("balance"))


def _tax_documents(spark, d):
    """Customers with two tax years and their funds."""
    year = lambda factor: F.struct((col("c_acctbal") * 12 * factor).alias("gross_total_income"))
    return table(spark, d, "customer").select(
        col("c_custkey").cast("string").alias("customer_id"),
        F.struct(F.create_map(F.lit("2022-23"), year(1.0), F.lit("2023-24"), year(1.05)).alias("itr")).alias("tax_records"),
        F.array(F.struct(F.lit("Balanced").alias("fund_name"), (col("c_acctbal") * 2).alias("current_value")),
                F.struct(F.lit("Growth").alias("fund_name"), F.when(
                    col("c_nationkey") % 2 == 0, col("c_acctbal") * 3).alias("current_value"))).alias("mutual_funds"))


@query("n4_tax_income")
def _(spark, d):
    docs = _tax_documents(spark, d)
    years = documents.income_by_year(docs).groupBy("customer_id").agg(F.count(F.lit(1)).alias("years"))
    one = docs.select("customer_id", npround(documents.gross_income("2023-24"), 2).alias("income_2023_24"),
                      documents.gross_income("1999-00").alias("income_1999_00"))
    return one.join(years, "customer_id")


@query("n5_primary_and_funds")
def _(spark, d):
    primary = documents.primary_accounts(accounts(spark, d))
    funds = _tax_documents(spark, d).select("customer_id", npround(documents.fund_total(), 2).alias("fund_value"))
    return primary.join(funds, "customer_id")


# --- scenarios and outreach --------------------------------------------------

def _scenario(number, rule):
    @query(f"c{number}_{rule.__name__}")
    def _(spark, d):
        f = featured(spark, d)
        return scenarios.match(f, [rule]).select("LoanID", "scenario", "risk_override", "scenario_message", "scenario_reason")


for _n, _rule in enumerate(scenarios.SCENARIOS, 1):
    _scenario(_n, _rule)


@query("c7_first_match")
def _(spark, d):
    return scenarios.resolve(scenarios.at_risk(scored(spark, d)), texts=True).select(
        "LoanID", "risk_band", "final_band", "scenario", "scenario_reason")


@query("c8_interventions")
def _(spark, d):
    return outreach(spark, d).select("LoanID", "risk_band", "risk_score", F.array_join("channel", ",").alias("channel"),
                                     "timing", "scenario")


@query("c9_messages")
def _(spark, d):
    s = scored(spark, d, impute=True)
    return s.select("LoanID", scenarios.message(s, col("risk_band"), key_days()).alias("message"))


@query("c10_display_action")
def _(spark, d):
    s = scored(spark, d, impute=True).select("LoanID", scenarios.display_action(col("risk_band")).alias("a"))
    return s.select("LoanID", "a.text", "a.colour")


def _factor_frame(spark, d):
    base = enriched_snapshot(spark, d).transform(derived.stress_composite).transform(derived.behavioral_composite)
    return base.transform(features.income_stability).transform(features.debt_to_income).transform(
        features.employer_contagion).withColumn("total_debt_to_assets", col("total_outstanding_debt") / 400000)


@query("c11_why_this_score")
def _(spark, d):
    f = _factor_frame(spark, d)
    return f.select("LoanID", F.posexplode(scenarios.factors(f)).alias("pos", "f")).select(
        "LoanID", "pos", "f.label", "f.value", "f.severity", "f.bar_pct")


@query("c12_customer_card")
def _(spark, d):
    f = enriched_snapshot(spark, d).withColumn("savings_rate", F.when(col("LoanID") % 4 > 0, col("savings_rate")))
    return f.select("LoanID", F.array_join(scenarios.customer_card(f), "|").alias("card"))


# --- transaction alerts ------------------------------------------------------

def _alert_text(df):
    return df.select("event_id", "customer_id", "trigger_time", F.array_join("reasons", "|").alias("reasons"), "action",
                     "priority")


@query("t1_clean_events")
def _(spark, d):
    t = transactions(spark, d).select(
        "event_id", F.when(col("event_id") % 50 > 0, col("customer_id")).otherwise("").alias("customer_id"),
        F.when(col("event_id") % 3 > 0, col("type")).alias("type"),
        F.when(col("event_id") % 5 > 0, col("amount")).alias("amount"),
        F.when(col("event_id") % 7 > 0, col("category")).alias("category"), "ts",
        F.when(col("event_id") % 11 > 0, col("monthly_income")).alias("monthly_income"))
    return alerts.clean(t)


@query("t2_stream_totals")
def _(spark, d):
    return _totals_out(_consumed(spark, alerts.stream_totals(_txn_stream(spark, d)), "totals"))


@query("t2_batch_totals")
def _(spark, d):
    return _totals_out(alerts.running_totals(transactions(spark, d)))


def _reason(name, prefix):
    @query(name)
    def _(spark, d):
        a = alerts.alerts_batch(transactions(spark, d))
        return a.select("event_id", F.explode("reasons").alias("reason")).where(col("reason").startswith(prefix))


_reason("t3_large_expense", "Large expense")
_reason("t4_consecutive_failures", "Consecutive")
_reason("t5_healthcare_spike", "Healthcare")


@query("t6_alerts")
def _(spark, d):
    return _alert_text(alerts.alerts_batch(transactions(spark, d)))


@query("t6_stream_alerts")
def _(spark, d):
    return _alert_text(_consumed(spark, alerts.alerts(_txn_stream(spark, d)), "alerts"))


@query("t7_balance_drop")
def _(spark, d):
    return alerts.daily_balance_drop(transactions(spark, d))


@query("t7_late_salary")
def _(spark, d):
    return alerts.late_salaries(transactions(spark, d)).select("customer_id", "month", "paid", "delay_days")


def _ordered(spark, d):
    """The folder of a stream in event time: four micro-batches, events up to two days out of order, one batch repeated."""
    t = transactions(spark, d)
    start = t.agg(F.min(F.unix_seconds(F.date_trunc("day", "ts").cast("timestamp")))).first()[0] or 0
    arrival = F.unix_seconds(col("ts").cast("timestamp")) + F.pmod(F.hash("event_id"), F.lit(2 * 86_400)) - start
    dealt = t.withColumn("batch", F.least(F.floor(arrival / (8 * 86_400)), F.lit(3)))
    root = io.work_dir(spark, "ordered")
    for i in (0, 1, 1, 2, 3):
        ordered.step(dealt.where(col("batch") == i), i, root, delay=2 * 86_400, chunk="day")
    ordered.finish(spark, root, chunk="day")
    return root


@query("t2_ordered_totals")
def _(spark, d):
    return _totals_out(ordered.table(spark, _ordered(spark, d), "totals"))


@query("t7_stream_balance_drop")
def _(spark, d):
    return ordered.table(spark, _ordered(spark, d), "drops")


@query("t7_stream_overdue_salary")
def _(spark, d):
    return ordered.table(spark, _ordered(spark, d), "overdue")


@query("t7_overdue_salary")
def _(spark, d):
    t = transactions(spark, d)
    # known up to the end of the second month
    return ordered.overdue_salaries(t, F.lit("2024-02-29 00:00:00").cast(t.schema["ts"].dataType))


@query("t8_rolling_healthcare")
def _(spark, d):
    return alerts.rolling_healthcare(transactions(spark, d), days=7)


@query("t8_stream_windows")
def _(spark, d):
    folder = io.work_dir(spark, "windows")
    alerts.upserts(alerts.daily_healthcare(_txn_stream(spark, d)), f"{folder}/data", f"{folder}/checkpoint")
    out = alerts.healthcare_windows(spark.read.parquet(f"{folder}/data"), days=2)
    ts_type = table(spark, d, "events").schema["ts"].dataType
    return out.withColumns({"window_start": col("window_start").cast(ts_type), "window_end": col("window_end").cast(ts_type),
                            "healthcare_spend_30d": npround(col("healthcare_spend_30d"), 2)})


# --- models ------------------------------------------------------------------

#: Sizes of the models that differ from those of ``ml.fit``: none.
ROUNDS: dict = {}


@functools.lru_cache(maxsize=4)
def _training(app: str, d: str) -> ml.Training:
    return ml.Training(featured(SparkSession.active(), d), early_stop=True, **ROUNDS)


@functools.lru_cache(maxsize=16)
def _fitted(app: str, d: str, models: tuple[str, ...]):
    return _training(app, d).ensemble(models)


def fitted(spark, d, models: tuple[str, ...] = tuple(rules.ENSEMBLE_WEIGHTS)):
    """The ensemble of the models that a query reads; each is fitted once per application and data set."""
    return _fitted(spark.sparkContext.applicationId, d, models)


@query("m1_feature_preparation")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    f = featured(spark, d)
    prep = ml.fit_preparation(f)
    values = ml.prepare(f, prep).select("LoanID", vector_to_array("features").alias("v"))
    return values.select("LoanID", F.size("v").alias("n_features"), npround(
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("m2_class_weights")
def _(spark, d):
    w = ml.class_weights(loan_snapshot(spark, d))
    return w.select("pos", "neg", *[npround(col(c), 6).alias(c) for c in ("scale_pos_weight", "balanced_pos", "balanced_neg")])


@query("m3_standardised_vectors")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    model, _ = fitted(spark, d, ())
    s = model.scaler.transform(ml.prepare(featured(spark, d), model.prep))
    return s.select("LoanID", vector_to_array("scaled").alias("scaled"))


def _model_scores(name, column, *models):
    @query(name)
    def _(spark, d):
        model, _ = fitted(spark, d, *models)
        return model.transform(featured(spark, d)).select("LoanID", column)


_model_scores("m4_booster_a", "p_booster_a", ("booster_a",))
_model_scores("m5_booster_b", "p_booster_b", ("booster_b",))
_model_scores("m6_random_forest", "p_random_forest", ("random_forest",))
_model_scores("m7_logistic", "p_logistic", ("logistic",))


@query("m8_weighted_ensemble")
def _(spark, d):
    return given_probabilities(spark, d).select("LoanID", "ensemble_probability")


_model_scores("m9_batch_inference", "ensemble_probability")


@query("m10_predictions")
def _(spark, d):
    model, _ = fitted(spark, d)
    p = model.transform(featured(spark, d)).withColumn("risk_score", scoring.predict_score(col("ensemble_probability")))
    return p.select("LoanID", npround(col("ensemble_probability"), 4).alias("default_probability"), "risk_score",
                    scoring.classify(col("risk_score"), "predict").alias("risk_band"),
                    *[npround(col(f"p_{n}"), 4).alias(f"p_{n}") for n in model.models])


@query("m11_roc_auc")
def _(spark, d):
    return metrics.roc_auc(given_probabilities(spark, d), "ensemble_probability", "Default").select(
        npround(col("auc"), 8).alias("auc"))


@query("m12_precision_recall")
def _(spark, d):
    pr = metrics.precision_recall(given_probabilities(spark, d), "ensemble_probability", "Default")
    return pr.select("threshold", *[npround(col(c), 8).alias(c) for c in ("precision", "recall", "f1")])


@query("m12_best_f1_threshold")
def _(spark, d):
    b = metrics.best_f1_threshold(given_probabilities(spark, d), "ensemble_probability", "Default")
    return b.select("threshold", npround(col("f1"), 8).alias("f1"))


@query("m13_cost_curve")
def _(spark, d):
    c = metrics.cost_curve(given_probabilities(spark, d), "ensemble_probability", "Default")
    return c.withColumn("threshold", npround(col("threshold"), 6))


@query("m13_best_cost_threshold")
def _(spark, d):
    c = metrics.best_cost_threshold(given_probabilities(spark, d), "ensemble_probability", "Default")
    return c.withColumn("threshold", npround(col("threshold"), 6))


def _decided(spark, d):
    return given_probabilities(spark, d).withColumn("predicted", (col("ensemble_probability") >= 0.5).cast("int"))


@query("m14_confusion")
def _(spark, d):
    return metrics.confusion(_decided(spark, d), "predicted", "Default")


@query("m14_classification_report")
def _(spark, d):
    return metrics.classification_report(_decided(spark, d), "predicted", "Default")


@query("m15_model_comparison")
def _(spark, d):
    names = {**{n: f"p_{n}" for n in GIVEN}, "ENSEMBLE": "ensemble_probability"}
    return metrics.model_comparison(given_probabilities(spark, d), names, "Default").select(
        "model", npround(col("auc"), 8).alias("auc"), "weight")


@query("m16_feature_importance")
def _(spark, d):
    model, _ = fitted(spark, d, ("booster_a",))
    return model.importance("booster_a")


@query("m17_linear_contributions")
def _(spark, d):
    return _contributions(spark, d).select(
        "LoanID", npround(col("base_value"), 6).alias("base_value"),
        npround(col("risk_probability"), 6).alias("risk_probability"),
        F.explode("contributions").alias("c")).select(
        "LoanID", "base_value", "risk_probability", col("c.feature").alias("feature"),
        npround(col("c.impact"), 6).alias("impact"), "c.value")


def _explained(spark, d):
    """Every loan's contributions to the log odds of the first booster."""
    model, _ = fitted(spark, d, ("booster_a",))
    vectors = ml.prepare(featured(spark, d), model.prep).select("LoanID", "features")
    return boosting.contributions(vectors, model.models["booster_a"], model.features)


@query("m17_tree_explanations")
def _(spark, d):
    out = explain.top_factors(_explained(spark, d), 10)
    return out.select("LoanID", npround(col("base_value"), 6).alias("base_value"),
                      npround(col("risk_probability"), 6).alias("risk_probability"), "top_risk_up", "top_risk_down")


@query("m18_batch_contributions")
def _(spark, d):
    return _explained(spark, d).select("LoanID", F.explode("contributions").alias("c")).select("LoanID", "c.feature", "c.impact")


@query("m19_tree_importance")
def _(spark, d):
    return explain.global_importance(_explained(spark, d))


#: (feature, cut, left, right) inside, (value,) at leaves, and the cover of every node: a given booster of two trees.
GIVEN_TREES = [
    [("CreditScore", 600.0, 1, 2, 1000.0), ("DTIRatio", 45.0, 3, 4, 400.0), ("Income", 60000.0, 5, 6, 600.0), (0.3, 250.0), (0.9, 150.0),
     ("CreditScore", 720.0, 7, 8, 350.0), (-0.6, 250.0), (-0.1, 200.0), (-0.4, 150.0)],
    [("DTIRatio", 30.0, 1, 2, 1000.0), ("Age", 35.0, 3, 4, 450.0), (0.5, 550.0), (0.2, 150.0), ("DTIRatio", 15.0, 5, 6, 300.0),
     (-0.5, 120.0), (-0.2, 180.0)],
]
GIVEN_FEATURES = ["Age", "CreditScore", "DTIRatio", "Income"]


def given_booster() -> boosting.BoostedTrees:
    nodes = [(n, i, -1, 0.0, -1, -1, x[0], x[1], 0.0) if len(x) == 2 else
             (n, i, GIVEN_FEATURES.index(x[0]), x[1], x[2], x[3], 0.0, x[4], 0.0)
             for n, tree in enumerate(GIVEN_TREES) for i, x in enumerate(tree)]
    return boosting.BoostedTrees(nodes, -1.0, len(GIVEN_FEATURES))


@query("m17_given_tree_contributions")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector
    rows = loan_snapshot(spark, d).select("LoanID", array_to_vector(F.array(*[
        F.coalesce(col(c).cast("double"), F.lit(-999.0)) for c in GIVEN_FEATURES])).alias("features"))
    out = boosting.contributions(rows, given_booster(), GIVEN_FEATURES)
    return out.select("LoanID", npround(col("base_value"), 6).alias("base_value"), F.explode("contributions").alias("c")).select(
        "LoanID", "base_value", "c.feature", npround(col("c.impact"), 6).alias("impact"))


@query("m19_global_importance")
def _(spark, d):
    g = explain.global_importance(_contributions(spark, d))
    return g.withColumn("mean_abs_impact", npround(col("mean_abs_impact"), 6))


@query("s11_model_round_trip")
def _(spark, d):
    model, _ = fitted(spark, d)
    path = io.work_dir(spark, "model")
    model.save(path)
    back = ml.EnsembleModel.load(path)
    return back.transform(featured(spark, d)).select("LoanID", npround(col("ensemble_probability"), 6).alias("ensemble_probability"))


@query("daily_workflow")
def _(spark, d):
    out = io.work_dir(spark, "daily")
    _, _, summary = workflow.run(spark, loan_snapshot(spark, d), out, ["event_timestamp", "customer_id"], model=fitted(spark, d)[0],
                                 healthcare_multiplier=col("healthcare_multiplier"), days_to_emi=key_days())
    return summary
