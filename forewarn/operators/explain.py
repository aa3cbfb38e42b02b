"""Contributions of features to a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions.semantics import npround

col = F.col


def linear_contributions(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0,
                         keep=("LoanID",)) -> DataFrame:
    """Exact Shapley values of a linear model: ``beta * (x - mean)`` per feature.

    Adds ``base_value``, ``contributions`` (array of feature, impact, value) and
    ``risk_probability``.  The means are one aggregate row.
    """
    names = list(coefficients)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("m")).scalar()
    rows = df.select(*keep, *[col(c).cast("double").alias(c) for c in names]).withColumn("_m", means)
    base = F.lit(float(intercept))
    for c in names:
        base = base + F.lit(coefficients[c]) * col(f"_m.{c}")
    entries = F.array(*[F.struct(
        F.lit(c).alias("feature"), (F.lit(coefficients[c]) * (col(c) - col(f"_m.{c}"))).alias("impact"),
        col(c).alias("value")) for c in names])
    out = rows.select(*keep, base.alias("base_value"), entries.alias("contributions"))
    margin = col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, e: a + e["impact"])
    return out.withColumn("risk_probability", 1 / (1 + F.exp(-margin)))


def top_factors(contributions: DataFrame, n: int = 10) -> DataFrame:
    """Largest positive and negative contributions per row, by sign first; no shuffle."""
    def ranked(sign: int) -> Column:
        kept = F.filter("contributions", lambda e: e["impact"] * sign > 0)
        keyed = F.transform(kept, lambda e, i: F.struct(
            (e["impact"] * -sign).alias("k"), i.alias("i"), e.alias("e")))
        return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: F.struct(
            s["e"]["feature"].alias("feature"), npround(s["e"]["impact"], 4).alias("impact"),
            npround(s["e"]["value"], 2).alias("value")))

    return contributions.withColumns({"top_risk_up": ranked(1), "top_risk_down": ranked(-1)})


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature.

    Partial sums per feature leave every task, never the exploded rows.
    """
    return (contributions.select(F.explode("contributions").alias("c"))
            .groupBy(col("c.feature").alias("feature"))
            .agg(F.avg(F.abs("c.impact")).alias("mean_abs_impact")))


def mean_abs(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for contributions held in wide columns: one aggregate row, then turned."""
    stats = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), col(c).alias("mean_abs_impact")) for c in columns])).alias("r")).select("r.*")
