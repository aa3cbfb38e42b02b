"""Portfolio figures: band counts, KPIs, crosstabs, histograms, outreach economics, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import first_match, npround, number_text
from forewarn.plans.topk import top_k

col = F.col


def band_distribution(df: DataFrame, band: str = "risk_band") -> DataFrame:
    """Count and share per band in fixed order, bands without rows as 0."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(rules.BAND_NAMES)], "band_order int, band string")
    counts = df.groupBy(col(band).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    # from here on one row per band
    every = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("total", F.sum("n").over(every))
    filled = F.broadcast(bands).join(counts, "band", "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "total": F.max("total").over(every)})
    return filled.select("band_order", "band", "n", npround(F.try_divide(col("n"), col("total")) * 100, 4).alias("pct"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def segment_default_rate(df: DataFrame, segment: str = "EmploymentType", label: str = "Default") -> DataFrame:
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), npround(F.avg(label) * 100, 4).alias("default_pct")).orderBy(F.desc("n"), segment)


def score_stats(df: DataFrame, name: str = "risk_score_v2") -> DataFrame:
    """Mean, exact median and sample deviation.

    ``percentile`` keeps one counter per distinct value: meant for scores, which are rounded to two digits and so have
    at most 10,001 of them.
    """
    return df.agg(F.count(name).alias("n"), F.avg(name).alias("mean"), F.percentile(name, F.lit(0.5)).alias("median"),
                  F.stddev_samp(name).alias("std"))


def default_rate(df: DataFrame, label: str = "Default") -> DataFrame:
    return df.agg(
        F.count(label).alias("n"), F.count_if(col(label) == 1).alias("positives"),
        F.count_if(col(label) == 0).alias("negatives"), npround(F.avg(label) * 100, 4).alias("default_pct"))


def distinct_count(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(name) if approximate else F.count_distinct(name)
    return df.agg(agg.alias("n_distinct"))


def exposure_text(amount: Column) -> Column:
    """Money in crore (>= 1e7), lakh (>= 1e5) or plain."""
    return first_match(
        (amount >= 1e7, F.concat(F.lit("₹"), number_text(amount / 1e7, ".1f"), F.lit("Cr"))),
        (amount >= 1e5, F.concat(F.lit("₹"), number_text(amount / 1e5, ".1f"), F.lit("L"))),
        otherwise=number_text(amount, "₹,.0f"))


def kpis(df: DataFrame, band: str = "risk_band", score: str = "risk_score_v2", amount: str = "LoanAmount") -> DataFrame:
    risky = col(band).isin(rules.AT_RISK_BANDS)
    base = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(risky).alias("at_risk"),
        F.coalesce(F.sum(F.when(risky, col(amount))), F.lit(0.0)).alias("exposure"),
        F.avg(score).alias("mean_score"))
    share = col("at_risk") / F.greatest(col("total"), F.lit(1)) * 100
    return base.select(
        "total", "at_risk", F.concat(number_text(share, ".1f"), F.lit("% of portfolio")).alias("at_risk_text"),
        npround(col("exposure"), 2).alias("exposure"), exposure_text(col("exposure")).alias("exposure_text"),
        npround(col("mean_score"), 4).alias("mean_score"))


def crosstab(df: DataFrame, rows: str, band: str = "risk_band") -> DataFrame:
    """Rows x band counts with fixed columns (no extra job to find the values)."""
    pivot = df.groupBy(rows).pivot(band, rules.BAND_NAMES).agg(F.count(F.lit(1)))
    return pivot.select(rows, *[F.coalesce(col(f"`{b}`"), F.lit(0)).alias(b.lower().replace(" ", "_"))
                                for b in rules.BAND_NAMES])


HISTOGRAM_EDGES = [0, 25, 45, 60, 75, 100]


def score_histogram(df: DataFrame, score: str = "risk_score_v2", width: int = 5) -> DataFrame:
    """Counts per band and 5-wide bin; band edges are inclusive on both sides.

    A score that sits on an inner edge counts in both bands, as the last bin of
    the lower and the first of the upper one.
    """
    s = col(score)
    hits = []
    for band, lo, hi in zip(rules.BAND_NAMES, HISTOGRAM_EDGES, HISTOGRAM_EDGES[1:]):
        bin_no = F.least(F.floor((s - lo) / width), F.lit((hi - lo) // width - 1))
        hits.append(F.when((s >= lo) & (s <= hi), F.struct(
            F.lit(band).alias("band"), (F.lit(lo) + bin_no * width).cast("int").alias("bin_start"))))
    # a band entry or two per row: pre-aggregated in the same stage
    return (df.select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
            .groupBy("h.band", "h.bin_start").agg(F.count(F.lit(1)).alias("n")))


def scenario_counts(df: DataFrame) -> DataFrame:
    """Per scenario: number of rows, largest first (input: resolved at-risk rows)."""
    counts = df.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(col("scenario").isNotNull()).orderBy(F.desc("n"), "scenario")


def _economics(n: Column, rate: float) -> dict[str, Column]:
    prevented = F.floor(n * rate).cast("long")
    cost = n * rules.INTERVENTION_COST
    savings = prevented * rules.DEFAULT_COST - cost
    return {"prevented": prevented, "cost": cost, "savings": savings,
            "roi_pct": savings / F.greatest(cost, F.lit(1)) * 100}


def monitoring(df: DataFrame, interventions: DataFrame) -> DataFrame:
    """Outreach totals and projected return, one row."""
    n_int = interventions.agg(F.count(F.lit(1)).alias("n"))
    base = df.agg(F.count(F.lit(1)).alias("total")).withColumn("interventions", n_int.scalar())
    eco = _economics(col("interventions"), rules.SUCCESS_RATE)
    rate = F.try_divide(col("interventions"), col("total")) * 100
    return base.select("total", "interventions", npround(rate, 4).alias("rate_pct"),
                       eco["prevented"].alias("prevented"), eco["cost"].alias("cost"),
                       eco["savings"].alias("savings"), npround(eco["roi_pct"], 4).alias("roi_pct"))


def service_roi(interventions: DataFrame) -> DataFrame:
    """Variant with 70 % success and gross return."""
    n = col("interventions")
    cost = n * rules.INTERVENTION_COST
    gross = (n * rules.DEFAULT_COST - cost) / F.greatest(cost, F.lit(1)) * 100
    return interventions.agg(F.count(F.lit(1)).alias("interventions")).select(
        "interventions", F.floor(n * rules.API_SUCCESS_RATE).cast("long").alias("projected_prevented_defaults"),
        npround(gross, 1).alias("projected_roi_percent"))


def prediction_log_stats(log: DataFrame, ts: str = "ts", score: str = "risk_score", band: str = "risk_band") -> DataFrame:
    """Log size, mean of non-zero scores, counts per band and the latest entry."""
    counts = [F.count_if(col(band) == b).alias("n_" + b.lower().replace(" ", "_")) for b in rules.BAND_NAMES]
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(npround(F.avg(F.when(col(score) != 0, col(score))), 2), F.lit(0.0)).alias("avg_risk_score"),
        *counts,
        F.max_by(F.struct(col("LoanID"), col(score), col(band)), F.struct(col(ts), col("LoanID"))).alias("latest"))


def retain_since(log: DataFrame, since: Column, ts: str = "ts") -> DataFrame:
    """The entries of the log from ``since`` on; the filter reaches the scan.  Entries without a time go."""
    return log.where(col(ts) >= since)


def band_top_list(df: DataFrame, clicks: int = 0, page: int = 20, band: str = "risk_band",
                  score: str = "risk_score_v2", key: str = "LoanID") -> DataFrame:
    """Highest scores per band, ``page * (clicks + 1)`` rows, with the band's total.

    Reads its input twice, narrowly; give it a written scored table at scale.
    """
    k = page * (clicks + 1)
    top = top_k(df.select(key, band, score), k, [F.desc_nulls_last(score), F.asc(key)], by=[band], salt_key=key)
    totals = df.groupBy(band).agg(F.count(F.lit(1)).alias("band_total"))
    return top.join(F.broadcast(totals), band).withColumn("has_more", col("band_total") > k)


def top_importance(df: DataFrame, n: int = 15, value: str = "importance") -> DataFrame:
    """Top n features, also scaled by the largest (input: one row per feature)."""
    top = df.orderBy(F.desc(value), "feature").limit(n)
    peak = df.agg(F.max(value).alias("m")).scalar()
    return top.withColumn("scaled", F.when(peak > 0, col(value) / peak).otherwise(col(value)))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose key equals ``value`` (1 finds '1' and the reverse): the value takes the column's type, so the scan filters."""
    return df.where(col(key) == F.lit(str(value)).try_cast(df.schema[key].dataType))


def lookup_many(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is among ``ids``, which take the key's type; ids that cannot have it match nothing."""
    wanted = ids.select(col(id_col).try_cast(df.schema[key].dataType).alias("_id")).where(col("_id").isNotNull())
    return df.join(wanted, col(key) == col("_id"), "left_semi")
