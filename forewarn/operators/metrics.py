"""Binary-classifier metrics as relational queries over (score, label) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import npround
from forewarn.plans.scan import running

col = F.col


def score_chunk(score: Column) -> Column:
    """Order-keeping split of the probability axis into at most 1001 ranges."""
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 1000)


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(col(score).alias("score")).agg(
        F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) == 0).alias("neg"))


def _cumulative(df: DataFrame, score: str, label: str) -> DataFrame:
    """Counts at or below each distinct score, without one task seeing all scores."""
    return running(score_counts(df, score, label), [], ["score"], score_chunk(col("score")),
                   sums={"cum_pos": col("pos"), "cum_neg": col("neg")})


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area; tied scores count half."""
    wins = col("pos") * (col("cum_neg") - col("neg") + col("neg") / 2)
    return _cumulative(df, score, label).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(wins).alias("w")).select(
        F.try_divide(col("w"), col("p") * col("n")).alias("auc"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision, recall and F1 for the cut ``score >= threshold`` at every distinct score."""
    totals = score_counts(df, score, label).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp = col("t.p") - col("cum_pos") + col("pos")
    fp = col("t.n") - col("cum_neg") + col("neg")
    total = totals.select(F.struct("p", "n").alias("t")).scalar()
    curve = _cumulative(df, score, label).withColumn("t", total).select(
        col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), col("t.p").alias("p"))
    precision, recall = col("tp") / (col("tp") + col("fp")), F.try_divide(col("tp"), col("p"))
    return curve.select("threshold", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", 2 * (col("precision") * col("recall")) / (col("precision") + col("recall") + 1e-8))


def best_f1_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Lowest threshold with the largest F1."""
    best = precision_recall(df, score, label).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(col("f1"), -col("threshold"))).alias("b"))
    return best.select("b.*")


# fixed values: the thresholds 0.10, 0.11 ... 0.89, spaced as a floating-point range
_START, _STEP, _COUNT = 0.1, (0.1 + 0.01) - 0.1, 80


def cost_curve(df: DataFrame, score: str, label: str, fp_cost=rules.COST_FP, fn_cost=rules.COST_FN) -> DataFrame:
    """Cost at each of the 80 thresholds from at most 81 bin counts."""
    def at(i: Column) -> Column:
        return F.lit(_START) + i * F.lit(_STEP)

    guess = F.least(F.greatest(F.floor((col(score) - _START) / _STEP), F.lit(-1)), F.lit(_COUNT - 1))
    # number of thresholds at or below the score, minus one; the guess may be off by one
    bin_no = F.when(col(score) >= at(guess + 1), F.least(guess + 1, F.lit(_COUNT - 1))).when(
        col(score) < at(guess), guess - 1).otherwise(guess)
    bins = df.where(col(score).isNotNull()).groupBy(F.greatest(bin_no, F.lit(-1)).cast("long").alias("bin")).agg(
        F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) == 0).alias("neg"))
    steps = df.sparkSession.range(_COUNT).select(col("id").alias("bin"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    # from here on at most 81 rows
    filled = bins.unionByName(steps).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("bin")
    fn = F.coalesce(F.sum("pos").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fp = F.sum("neg").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return filled.select("bin", fp.alias("fp"), fn.alias("fn")).where(col("bin") >= 0).select(
        at(col("bin")).alias("threshold"), "fp", "fn", (col("fp") * fp_cost + col("fn") * fn_cost).alias("cost"))


def best_cost_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Lowest threshold with the smallest cost."""
    return cost_curve(df, score, label).agg(
        F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("b")).select("b.*")


def confusion(df: DataFrame, predicted: str, label: str) -> DataFrame:
    p, y = col(predicted), col(label)
    return df.agg(
        F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 1) & (y == 1)).alias("tp"))


def classification_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Per class, macro and weighted precision/recall/F1/support, plus accuracy."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    def scores(tp, fp, fn):
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return p, r, ratio(2 * p * r, p + r)

    m = confusion(df, predicted, label)
    tn, fp, fn, tp = (col(c) for c in ("tn", "fp", "fn", "tp"))
    neg, pos = scores(tn, fn, fp), scores(tp, fp, fn)
    n_neg, n_pos = tn + fp, tp + fn
    n = n_neg + n_pos
    accuracy = ratio(tn + tp, n)
    macro = [(a + b) / 2 for a, b in zip(neg, pos)]
    weighted = [ratio(a * n_neg + b * n_pos, n) for a, b in zip(neg, pos)]

    def row(name, values, support):
        return F.struct(F.lit(name).alias("label"), *[
            npround(v, 6).alias(k) for k, v in zip(("precision", "recall", "f1"), values)],
            support.alias("support"))

    rows = F.array(row("No Default", neg, n_neg), row("Default", pos, n_pos),
                   row("accuracy", [accuracy] * 3, n), row("macro avg", macro, n), row("weighted avg", weighted, n))
    return m.select(F.explode(rows).alias("r")).select("r.*")


def model_comparison(df: DataFrame, scores: dict[str, str], label: str) -> DataFrame:
    """AUC per model with its ensemble weight (1.0 for the ensemble itself).

    All models are ranked in one pass over long (model, score, label) counts.
    """
    long = df.select(col(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), col(c).alias("score")) for name, c in scores.items()])).alias("m"))
    counts = long.groupBy("m.model", "m.score").agg(
        F.count_if(col("label") == 1).alias("pos"), F.count_if(col("label") == 0).alias("neg"))
    cum = running(counts, ["model"], ["score"], score_chunk(col("score")), sums={"cum_neg": col("neg")})
    wins = col("pos") * (col("cum_neg") - col("neg") + col("neg") / 2)
    weight = F.coalesce(*[F.when(col("model") == k, F.lit(w)) for k, w in rules.ENSEMBLE_WEIGHTS.items()], F.lit(1.0))
    return cum.groupBy("model").agg(
        F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("auc")).withColumn("weight", weight)
