"""Weighted four-model ensemble with ``pyspark.ml``."""

from __future__ import annotations

import json
import threading
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.functions import rules
from forewarn.operators import boosting, forest as forests, metrics
from forewarn.operators.tables import stratified_split
from forewarn.sources.io import ensure_checkpoint_dir, work_dir

col = F.col

# identifiers, labels and everything computed from a label
NOT_FEATURES = {"LoanID", "customer_id", "name", "event_timestamp", "created_timestamp", "Default", "target",
                "days_to_default", "delinquency_prob", "default_logit", "risk_score_v2", "risk_score",
                "risk_category", "ensemble_probability"}
_OWN = (boosting.BoostedTrees, forests.Forest)
_READERS = {"booster_a": boosting.BoostedTrees, "booster_b": boosting.BoostedTrees,
            "random_forest": forests.Forest, "logistic": LogisticRegressionModel}


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, text) feature columns; bands and label-derived columns are left out."""
    usable = [f for f in df.schema.fields if f.name not in NOT_FEATURES and not f.name.endswith("_band")]
    numeric = [f.name for f in usable if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in usable if isinstance(f.dataType, T.StringType)]
    return numeric, text


def fit_preparation(df: DataFrame) -> PipelineModel:
    """Sorted label codes (missing or unseen -1), missing numbers -999, one vector."""
    numeric, text = feature_columns(df)
    stages, exprs = [], []
    if text:
        indexer = StringIndexer(inputCols=text, outputCols=[f"_i_{c}" for c in text],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        stages.append(indexer)
        exprs += [f"CASE WHEN `_i_{c}` = {len(labels)} THEN -1D ELSE `_i_{c}` END AS `_f_{c}`"
                  for c, labels in zip(text, indexer.labelsArray)]
    exprs += [f"COALESCE(CAST(NANVL(CAST(`{c}` AS DOUBLE), NULL) AS DOUBLE), {rules.MISSING_FILL}D) AS `_f_{c}`"
              for c in numeric]
    names = [f"_f_{c}" for c in [*text, *numeric]]
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    return PipelineModel(stages)


def prepare(df: DataFrame, prep: PipelineModel) -> DataFrame:
    out = prep.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_f_"))])


def class_weights(df: DataFrame, label: str = "Default") -> DataFrame:
    """One row: positive weight neg/pos, balanced weights n/(2*n_c)."""
    counts = df.agg(F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) == 0).alias("neg"))
    n = col("pos") + col("neg")
    return counts.select(
        "pos", "neg", F.try_divide(col("neg"), col("pos")).alias("scale_pos_weight"),
        F.try_divide(n, 2 * col("pos")).alias("balanced_pos"), F.try_divide(n, 2 * col("neg")).alias("balanced_neg"))


@dataclass
class EnsembleModel:
    prep: PipelineModel
    scaler: PipelineModel
    models: dict
    threshold: float = 0.5
    weights: dict = field(default_factory=lambda: dict(rules.ENSEMBLE_WEIGHTS))

    @property
    def features(self) -> list[str]:
        return [c[3:] for c in self.prep.stages[-1].getInputCols()]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p_<model>`` and ``ensemble_probability``; all models run in one projection."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            return df.withColumn("ensemble_probability", F.lit(rules.FALLBACK_PROBABILITY))
        return self.score_vectors(prepare(df, self.prep)).drop("features")

    def score_vectors(self, df: DataFrame) -> DataFrame:
        """The same for rows that already carry the ``features`` vector."""
        out = self.scaler.transform(df) if "logistic" in self.models else df
        for name, model in self.models.items():
            if isinstance(model, _OWN):
                out = out.withColumn(f"p_{name}", model.probability(col("features")))
            else:
                out = model.transform(out).withColumn(f"p_{name}", vector_to_array(f"_prob_{name}")[1])
        out = out.drop(*[f"_{k}_{name}" for name in self.models for k in ("prob", "raw", "pred")],
                       "scaled_raw", "scaled")
        return out.withColumn("ensemble_probability", weighted_probability(list(self.models), self.weights))

    def save(self, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        self.scaler.write().overwrite().save(f"{path}/scaler")
        for name, model in self.models.items():
            (model if isinstance(model, _OWN) else model.write().overwrite()).save(f"{path}/model-{name}")
        spark = SparkSession.active()
        meta = json.dumps({"models": list(self.models), "threshold": self.threshold, "weights": self.weights,
                           "features": self.features})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "EnsembleModel":
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first().value)
        return cls(PipelineModel.load(f"{path}/prep"), PipelineModel.load(f"{path}/scaler"),
                   {n: _READERS[n].load(f"{path}/model-{n}") for n in meta["models"]},
                   meta["threshold"], meta["weights"])

    def importance(self, name: str = "booster_a") -> DataFrame:
        """Feature importance of a tree model, one row per feature, largest first."""
        model = self.models[name]
        values = model.importance() if isinstance(model, _OWN) else model.featureImportances.toArray()
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")


def weighted_probability(models: list[str], weights=rules.ENSEMBLE_WEIGHTS, prefix: str = "p_") -> Column:
    total = F.lit(0.0)
    for name in models:
        total = total + F.lit(weights[name]) * col(f"{prefix}{name}")
    return total


def weighted_long(long: DataFrame, key: str) -> DataFrame:
    """The same from (key, model, probability) rows and the four-row weight table."""
    weights = long.sparkSession.createDataFrame(list(rules.ENSEMBLE_WEIGHTS.items()), "model string, weight double")
    return long.join(F.broadcast(weights), "model").groupBy(key).agg(
        F.sum(col("weight") * col("probability")).alias("ensemble_probability"))


def _outputs(name: str) -> dict:
    return {"probabilityCol": f"_prob_{name}", "rawPredictionCol": f"_raw_{name}", "predictionCol": f"_pred_{name}"}


#: Rounds without a lower loss on the test rows after which boosting ends.
PATIENCE = 30
#: What the boosters differ in.
BOOSTERS = {"booster_a": dict(least_rows=5, seed=42), "booster_b": dict(bins=64, seed=43)}


def estimator(name: str, label: str, n: int, forest: int):
    if name == "random_forest":
        # what ``forest.fit`` fits; Spark's own fit would keep every row's node and draws in all trees, some 2.5 KB a row
        return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="w_balanced", maxDepth=12,
                                      numTrees=forest, minInstancesPerNode=10, seed=42, maxMemoryInMB=256, cacheNodeIds=True,
                                      **_outputs(name))
    # C = 0.1 on weights that sum to n
    return LogisticRegression(labelCol=label, featuresCol="scaled", weightCol="w_balanced", maxIter=1000,
                              regParam=1.0 / (0.1 * n), standardization=False, **_outputs(name))


class Training:
    """Prepared and split rows, written once, and the models that are fitted on them, each at most once.

    The fits do not depend on one another and are made of many small jobs, so those asked for together run side by side, the forest
    behind them.
    """

    def __init__(self, df: DataFrame, label: str = "Default", key: str = "LoanID", trees: int = 500, forest: int = 300,
                 early_stop: bool = True, split_order: Column | None = None, split_space: int | None = None,
                 folder: str | None = None):
        spark = self.spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        self.label, self.key, self.trees, self.forest, self.early_stop = label, key, trees, forest, early_stop
        self.prep = fit_preparation(df)
        path = self.path = folder or work_dir(spark, "training")
        prepare(df, self.prep).select(key, label, "features").write.mode("overwrite").parquet(f"{path}/prepared")
        prepared = spark.read.parquet(f"{path}/prepared")
        split = stratified_split(prepared, label, key, 0.8, split_order, **({"space": split_space} if split_space else {}))
        # files for all cores: the fits' parallelism is that of this table
        spread = split.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
        spread.withColumn("is_test", col("is_train") == 0).drop("is_train").write.mode("overwrite").parquet(f"{path}/split")
        rows = spark.read.parquet(f"{path}/split")
        w = class_weights(rows.where(~col("is_test")), label).first()
        self.rows = rows.withColumns({
            "w_boost": F.when(col(label) == 1, w.scale_pos_weight).otherwise(1.0),
            "w_balanced": F.when(col(label) == 1, w.balanced_pos).otherwise(w.balanced_neg)})
        self.train = self.rows.where(~col("is_test"))
        n = self.n = w.pos + w.neg
        scaler = PipelineModel([StandardScaler(inputCol="features", outputCol="scaled_raw", withMean=True,
                                               withStd=True).fit(self.train)])
        self.width = len(self.prep.stages[-1].getInputCols())
        # population instead of sample deviation
        self.scaler = PipelineModel([*scaler.stages, ElementwiseProduct(
            scalingVec=Vectors.dense([(n / (n - 1)) ** 0.5] * self.width), inputCol="scaled_raw", outputCol="scaled")])
        self._fits: dict[str, Future] = {}
        self._lock = threading.Lock()

    def _fit(self, name: str):
        if name in BOOSTERS:
            return boosting.fit(self.rows, f"{self.path}/{name}", self.label, self.key, "w_boost", "is_test", self.width, self.trees,
                                patience=PATIENCE if self.early_stop else None, **BOOSTERS[name])
        spec = estimator(name, self.label, self.n, self.forest)
        if name == "random_forest":
            return forests.fit(self.rows, f"{self.path}/{name}", self.label, self.key, spec.getWeightCol(), "is_test", self.width,
                               spec.getNumTrees(), spec.getMaxDepth(), spec.getMinInstancesPerNode(), spec.getSeed(), spec.getMaxBins())
        return spec.fit(self.scaler.transform(self.train))

    def _fit_behind(self, name: str, before: list[Future]):
        wait(before)
        return self._fit(name)

    def models(self, names: tuple[str, ...]) -> dict:
        """The fitted models of these names; a fit that failed is tried again when it is asked for again."""
        with self._lock:
            missing = [n for n in names if n not in self._fits or (self._fits[n].done() and self._fits[n].exception())]
            if missing:
                pool = ThreadPoolExecutor(len(missing))
                # the forest fills all cores and most memory, so it comes behind the others
                for n in sorted(missing, key="random_forest".__eq__):
                    before = list(self._fits.values()) if n == "random_forest" else []
                    self._fits[n] = pool.submit(inheritable_thread_target(self.spark)(self._fit_behind), n, before)
                pool.shutdown(wait=False)
            fits = {n: self._fits[n] for n in names}
        return {n: f.result() for n, f in fits.items()}

    def ensemble(self, models: tuple[str, ...] = tuple(rules.ENSEMBLE_WEIGHTS)) -> tuple[EnsembleModel, DataFrame]:
        """The ensemble of these models, with the threshold of the best F1 on the test rows, and the scored test rows."""
        model = EnsembleModel(self.prep, self.scaler, self.models(models))
        test = model.score_vectors(self.rows.where(col("is_test"))).drop("features", "w_boost", "w_balanced", "is_test")
        best = metrics.best_f1_threshold(test, "ensemble_probability", self.label).first()
        if best is not None and best.threshold is not None:
            model.threshold = float(best.threshold)
        return model, test


def fit(df: DataFrame, label: str = "Default", key: str = "LoanID", models=tuple(rules.ENSEMBLE_WEIGHTS),
        trees: int = 500, forest: int = 300, early_stop: bool = True, split_order: Column | None = None,
        split_space: int | None = None, folder: str | None = None) -> tuple[EnsembleModel, DataFrame]:
    """Trains on a stratified 80 % and returns the model and the scored 20 %.

    The prepared rows are written once to the shared work folder: four fits read
    them, and a lost executor never recomputes the feature plan.  Boosting goes on
    behind its last written block when ``folder`` is that of an earlier run.
    """
    return Training(df, label, key, trees, forest, early_stop, split_order, split_space, folder).ensemble(tuple(models))
