"""Shadow risk model (L1-L12): logged next to the decision, never consulted.

Gradient-boosted trees (MLlib) with sigmoid (Platt) calibration over 5
folds: per fold the trees are fit on the other 4/5 and a logistic regression
on the held-out fold's margin calibrates them; the final probability is the
mean of the 5 calibrated models. The same 5 out-of-fold models give the
cross-validated AUC / Brier (5 fits, not the 55 of a nested CV).

Folds and the hold-out split come from a seeded hash of the merchant id:
deterministic, and no window over a whole label class.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.features.registry import ML_FEATURES
from quire.operators.monitor import auc_brier
from quire.session import write_table

# Model hyper-parameters (must equal the reference's configuration).
N_ESTIMATORS = 200
MAX_DEPTH = 4
LEARNING_RATE = 0.05
SEED = 42
CALIBRATION_FOLDS = 5
HOLDOUT_SHARE = 0.30
LOGISTIC_MAX_ITER = 1000
LOGISTIC_TOL = 1e-4


def stratified_rank(frame: DataFrame, seed: int = SEED) -> DataFrame:
    """``frame`` with _rank, the row's place among its label by a hash of merchant_id, and _n, that label's rows.

    Rows are counted per label and hash bucket, a running sum over at most 256 buckets carries the counts, and
    rows are ranked inside their bucket, so no window holds a whole class."""
    mixed = frame.withColumn("_hash", F.md5(F.concat("merchant_id", F.lit(f":{seed}")))) \
        .withColumn("_part", F.substring("_hash", 1, 2))
    before = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (mixed.groupBy("label", "_part").agg(F.count(F.lit(1)).alias("_c"))
              .select("label", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                      F.sum("_c").over(Window.partitionBy("label")).alias("_n")))
    inside = F.row_number().over(Window.partitionBy("label", "_part").orderBy("_hash", "merchant_id"))
    return (mixed.join(counts, ["label", "_part"])
            .withColumn("_rank", F.col("_before") + inside - 1).drop("_hash", "_part", "_before"))


def training_frame(features: DataFrame, merchants: DataFrame) -> DataFrame:
    """L1: the 54 model inputs (NULL -> 0) with the synthetic default label."""
    m = merchants.select("merchant_id", "is_bad_synthetic").dropDuplicates(["merchant_id"])
    j = features.join(m, "merchant_id", "inner")
    return j.select("merchant_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ML_FEATURES],
                    F.col("is_bad_synthetic").cast("int").alias("label"))


@dataclass
class ShadowModel:
    trees: list  # GBT or logistic fold models (both expose a raw margin)
    calibration: list[tuple[float, float]]  # (slope, intercept) per fold
    importances: list[float]
    metrics: dict = field(default_factory=dict)

    def score(self, features: DataFrame, out_col: str = "shadow_ml_score") -> DataFrame:
        """Mean of the calibrated fold models; columns absent in ``features`` score as 0."""
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features.columns
                else F.lit(0.0).alias(c) for c in ML_FEATURES]
        keep = [c for c in features.columns if c not in ML_FEATURES]
        x = VectorAssembler(inputCols=ML_FEATURES, outputCol="_x").transform(features.select(*keep, *cols))
        probs = []
        for k, (tree, (a, b)) in enumerate(zip(self.trees, self.calibration)):
            t = tree.copy().setFeaturesCol("_x").setRawPredictionCol(f"_raw{k}") \
                .setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
            x = t.transform(x)
            m = vector_to_array(F.col(f"_raw{k}"))[1]
            probs.append(1.0 / (1.0 + F.exp(-(F.lit(a) * m + F.lit(b)))))
        score = sum(probs[1:], probs[0]) / len(probs)
        return x.select(*keep, *[F.col(c) for c in ML_FEATURES if c in features.columns], score.alias(out_col))

    def save(self, spark: SparkSession, path: str) -> None:
        """Tree models plus a small JSON document of calibration and importances."""
        for k, t in enumerate(self.trees):
            t.write().overwrite().save(f"{path}/trees/{k}")
        kind = "logistic" if isinstance(self.trees[0], LogisticRegressionModel) else "gbm"
        doc = json.dumps({"calibration": self.calibration, "importances": self.importances,
                          "features": ML_FEATURES, "metrics": self.metrics, "model_type": kind})
        spark.createDataFrame([(doc,)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ShadowModel":
        doc = json.loads(spark.read.text(f"{path}/meta").first()[0])
        cls = LogisticRegressionModel if doc.get("model_type") == "logistic" else GBTClassificationModel
        trees = [cls.load(f"{path}/trees/{k}") for k in range(len(doc["calibration"]))]
        return ShadowModel(trees, [tuple(c) for c in doc["calibration"]], doc["importances"], doc.get("metrics", {}))


def _balanced_weights(frame: DataFrame) -> Column:
    """w = n / (2 n_class): two class counts, collected as scalars."""
    counts = {r["label"]: r["n"] for r in frame.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = F.lit(1.0)
    for cls, c in counts.items():
        w = F.when(F.col("label") == cls, F.lit(n / (2.0 * c))).otherwise(w)
    return w


def _base_estimator(model_type: str, n_trees: int, depth: int, lr: float, seed: int, n_rows: int,
                    max_iter: int = LOGISTIC_MAX_ITER):
    if model_type == "gbm":
        return GBTClassifier(featuresCol="_x", labelCol="label", maxIter=n_trees, maxDepth=depth, stepSize=lr,
                             seed=seed)
    if model_type == "logistic":
        # L2 with C = 1 and balanced class weights: lambda = 1 / sum(w) = 1 / n. Features span ~1e-3..1e6,
        # so the solver runs on standardized features (the penalty then applies in that space; unscaled
        # L-BFGS does not converge within the iteration cap)
        return LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=max_iter,
                                  regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=True,
                                  tol=LOGISTIC_TOL)
    raise ValueError(f"Unknown model_type: {model_type}")


def _sigmoid(margins: DataFrame) -> tuple[float, float]:
    """Slope and intercept of Platt's sigmoid of label on margin: the logistic of smoothed targets, (P + 1) / (P + 2) for
    the P positives and 1 / (N + 2) for the N negatives. As MLlib takes no targets between 0 and 1, each row comes in
    once as a positive and once as a negative, weighted by its target and the rest."""
    counts = {r["label"]: r["n"] for r in margins.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    high, low = (counts.get(1, 0) + 1.0) / (counts.get(1, 0) + 2.0), 1.0 / (counts.get(0, 0) + 2.0)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    both = margins.select("_m", F.explode(F.array(F.struct(F.lit(1).alias("label"), target.alias("_t")),
                                                  F.struct(F.lit(0).alias("label"), (1 - target).alias("_t")))).alias("r"))
    platt = LogisticRegression(featuresCol="_m", labelCol="label", weightCol="_t", regParam=0.0, tol=1e-10, maxIter=200).fit(
        both.select("_m", "r.*"))
    return float(platt.coefficients[0]), float(platt.intercept)


def train_shadow(frame: DataFrame, n_trees: int = N_ESTIMATORS, depth: int = MAX_DEPTH,
                 lr: float = LEARNING_RATE, seed: int = SEED, folds: int = CALIBRATION_FOLDS,
                 model_type: str = "gbm", max_iter: int = LOGISTIC_MAX_ITER) -> ShadowModel:
    """5 calibrated fold models, out-of-fold AUC / Brier, mean importances
    (tree importances, or |coefficients| for the logistic base model)."""
    ranked = VectorAssembler(inputCols=ML_FEATURES, outputCol="_x").transform(stratified_rank(frame, seed)) \
        .withColumn("_fold", (F.col("_rank") % folds).cast("int")) \
        .withColumn("_w", _balanced_weights(frame)) \
        .select("merchant_id", "label", "_x", "_fold", "_w")
    # written, not cached: a cached plan keeps every shuffle partition, and each of the trainers' thousands of small
    # jobs would start a task for each; a table has as many parts as its size asks for
    data = write_table(ranked, "shadow-training")
    n_rows = data.count()

    def fold(k: int):
        base = _base_estimator(model_type, n_trees, depth, lr, seed, n_rows, max_iter).fit(data.filter(F.col("_fold") != k))
        margin = base.transform(data.filter(F.col("_fold") == k)).select(
            "merchant_id", "label", "_fold", vector_to_array("rawPrediction")[1].alias("m"))
        held = write_table(VectorAssembler(inputCols=["m"], outputCol="_m").transform(margin), f"shadow-margins-{k}")
        return base, _sigmoid(held), held

    # folds do not wait for each other: while one plans its next small job, another one's tasks run
    with ThreadPoolExecutor(folds) as pool:
        trees, calib, oof = map(list, zip(*pool.map(inheritable_thread_target(data.sparkSession)(fold), range(folds))))
    margins = reduce(DataFrame.unionByName, oof)
    scored = []
    for k in range(folds):  # judged with a sigmoid that has not seen the fold
        a, b = _sigmoid(margins.filter(F.col("_fold") != k))
        scored.append(oof[k].withColumn("p", 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("m") + F.lit(b))))))
    scored = reduce(DataFrame.unionByName, scored)
    per_fold = auc_brier(scored, "p", "label", by=["_fold"]).collect()  # one row per fold
    aucs = [r["auc"] for r in per_fold if r["auc"] is not None]
    briers = [r["brier"] for r in per_fold]
    mean = lambda v: sum(v) / len(v) if v else None
    std = (lambda v: (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5 if v else None)
    imps = [0.0] * len(ML_FEATURES)
    for t in trees:
        vec = t.featureImportances.toArray() if model_type == "gbm" else abs(t.coefficients.toArray())
        for i, v in enumerate(vec):
            imps[i] += float(v) / len(trees)
    metrics = {"auc_cv_mean": round(mean(aucs), 4) if aucs else None,
               "auc_cv_std": round(std(aucs), 4) if aucs else None,
               "brier_cv_mean": round(mean(briers), 4) if briers else None,
               "n_samples": n_rows, "folds": folds, "n_trees": n_trees, "model_type": model_type,
               # Fixed value: the note.
               "note": "SHADOW ONLY - calibrated P(default), logged not used for decisions"}
    return ShadowModel(trees, calib, imps, metrics)


def importances_frame(spark: SparkSession, model: ShadowModel, labels: dict[str, str] | None = None,
                      top: int = 8) -> DataFrame:
    """Importances x100 (1 dp) with display labels, top ``top`` by importance."""
    labels = labels or {}
    rows = [(n, labels.get(n), float(v)) for n, v in zip(ML_FEATURES, model.importances)]
    df = spark.createDataFrame(rows, "name string, label string, importance double")
    lab = F.coalesce(F.col("label"), F.initcap(F.translate("name", "_", " ")))
    return (df.select("name", lab.alias("label"), F.round(F.col("importance") * 100, 1).alias("importance"))
            .orderBy(F.col("importance").desc(), F.col("name")).limit(top))


def holdout_split(frame: DataFrame, share: float = HOLDOUT_SHARE, seed: int = SEED) -> DataFrame:
    """``share`` of every label class, rounded, is held out: the first by a hash of merchant_id."""
    held = F.col("_rank") < F.round(F.col("_n") * share)
    return (stratified_rank(frame, seed).withColumn("split", F.when(held, "holdout").otherwise("train"))
            .drop("_rank", "_n"))


def holdout_evaluation(frame: DataFrame, share: float = HOLDOUT_SHARE, seed: int = SEED, **train_args) -> DataFrame:
    """Fit the calibrated model on the train split, AUC / Brier on the hold-out."""
    split = holdout_split(frame, share, seed)
    model = train_shadow(split.filter(F.col("split") == "train").drop("split"), **train_args)
    held = split.filter(F.col("split") == "holdout").drop("split")
    scored = model.score(held.select("merchant_id", "label", *ML_FEATURES), out_col="p")
    return auc_brier(scored, "p", "label")
