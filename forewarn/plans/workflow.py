"""The daily batch as one plan: read, deduplicate, features, model, score, outreach, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import null_nan
from forewarn.operators import features, reporting, scenarios, scoring, tables
from forewarn.sources import io


def score_loans(df: DataFrame, order: list[str] | None = None, model=None, healthcare_multiplier=1.0,
                impute_missing: bool = False) -> DataFrame:
    """Loan rows to scored rows.  The only shuffle is the deduplication, when asked for by ``order``."""
    rows = null_nan(df)
    if order:
        rows = tables.keep_last(rows, "LoanID", order)
    rows = features.run(rows, healthcare_multiplier)
    rows = model.transform(rows) if model is not None else rows.withColumn(
        "ensemble_probability", F.lit(rules.FALLBACK_PROBABILITY))
    return scoring.score(rows, impute_missing)


def run(spark: SparkSession, source: str | list[str] | DataFrame, out: str, order: list[str] | None = None,
        model=None, healthcare_multiplier=1.0, days_to_emi: Column | None = None
        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole run into ``out``; returns (scored, interventions, summary).

    Scored rows are written once, by band; the outreach step reads back only the
    at-risk folders, and the figures read the written tables.
    """
    df = source if isinstance(source, DataFrame) else io.load_best(
        spark, [source] if isinstance(source, str) else source)
    io.write_scored(score_loans(df, order, model, healthcare_multiplier), f"{out}/scored")
    scored = spark.read.parquet(f"{out}/scored")
    scenarios.interventions(scored, days_to_emi).write.mode("overwrite").parquet(f"{out}/interventions")
    interventions = spark.read.parquet(f"{out}/interventions")
    io.write_csv(interventions, f"{out}/interventions_csv")
    return scored, interventions, reporting.monitoring(scored, interventions)
