"""Classifiers, tuning, scoring and ensembles on Spark ML.

The prepared roster (E11) becomes one DataFrame with an ``id``, a
``features`` vector, a double ``label`` (class code of the risk band) and a
``split`` column (M1). Every model is a Spark ML ``Estimator`` built from a
registry (M15); tuning is ``CrossValidator`` over a ``ParamGridBuilder`` grid
with a stratified ``foldCol`` (M2/M3); scoring is ``Model.transform`` over the
whole table. Where Spark ML has no direct counterpart the estimator is a
``Pipeline`` of Spark ML stages (documented per entry):

* multi-class gradient boosting: ``OneVsRest(GBTClassifier)``; the per-class
  margins are turned into probabilities with the logistic link and
  normalised (``GBTClassifier`` is binary only);
* kernel SVM: ``OneVsRest(LinearSVC)`` on a kernel feature map (random
  Fourier features for rbf, ``PolynomialExpansion`` for poly), calibrated by
  a multinomial ``LogisticRegression`` on the class margins (Platt-style);
* neural network: ``MultilayerPerceptronClassifier`` (sigmoid hidden
  layers, L-BFGS; relu/tanh, Adam, alpha and early stopping have no
  counterpart).
"""

from __future__ import annotations

import itertools
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier,
                                       LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import bands, split
from cohortlens.operators.knn import KNNClassifier
from cohortlens.operators.labels import encode_labels
from cohortlens.operators.metrics import summary_metrics
from cohortlens.operators.prepare import RosterPreparation, RosterPreparationModel
from cohortlens.session import checkpoint_dir, discard, spread, written

CLASSES = ["Critical", "High", "Low", "Medium"]   # label codes 0..3 (alphabetical)
ROWS_PER_PARTITION, LEAST_ROWS = 100_000, 5_000
SOLVER_ROWS = 50_000   # rows a task of one class's SVM solver


# ---------------------------------------------------------------- data
@dataclass
class TrainingData:
    df: DataFrame                 # id, features, label, class_name, split, fold
    feature_names: list
    classes: list = field(default_factory=lambda: list(CLASSES))
    preparation: RosterPreparationModel | None = None


def prepare_training_data(spark: SparkSession, sf_dir: str, **options) -> TrainingData:
    """``prepare_roster`` of the roster view over the tables of ``sf_dir``."""
    return prepare_roster(fx.roster(spark, sf_dir), **options)


def feature_table(prepared: DataFrame, preparation: RosterPreparationModel) -> DataFrame:
    """(id, features, and with grades: label, class_name; split if there is one) of prepared rows."""
    out = VectorAssembler(inputCols=preparation.features, outputCol="features").transform(prepared)
    keep = [F.col("student_id").alias("id"), "features"] + [c for c in ("split",) if c in prepared.columns]
    if "label" not in prepared.columns:
        return out.select(*keep)
    coded, _ = encode_labels(out.withColumn("class_name", preparation.class_name()).drop("label"), "class_name", "label",
                             classes=CLASSES)
    return coded.select(*keep, F.col("label").cast("double").alias("label"), "class_name")


def prepare_roster(roster: DataFrame, k_folds: int = 5, seed: int = 42, val_size: float = 0.1, test_size: float = 0.2,
                   fit_on: str = "all") -> TrainingData:
    """E11 -> quantile risk bands of the cleaned target -> label codes ->
    feature vector -> stratified split (M1) and folds (M2) of the training rows.

    With ``fit_on='train'`` (E10) the rows are split first, by quartile of the raw
    grade, and every statistic and class edge comes from the training rows."""
    spark = roster.sparkSession
    if fit_on == "train":
        strata = bands.quantile_band(roster.select("student_id", "G3"), "G3", "class_name").select("student_id", "class_name")
        dealt = split.stratified_split(strata, "class_name", "student_id", val_size, test_size, seed).select("student_id", "split")
        roster = written(roster.join(dealt, "student_id"), "split-roster")
    roster = spread(roster, "roster")
    preparation = RosterPreparation(fit_on=fit_on).fit(roster)
    # several passes follow (split, folds, weights): the prepared table is written once
    base = written(feature_table(preparation.prepare(roster), preparation), "prepared")
    if fit_on == "train":
        folds = split.stratified_folds(base.filter(F.col("split") == "train"), "class_name", "id", k_folds, seed)
        sp = base.join(folds.select("id", "fold"), "id", "left")
    else:
        sp = split.stratified_split(base, "class_name", "id", val_size, test_size, seed, k_folds=k_folds)
    # M5: balanced class weights n / (k * n_c) from the training rows, usable
    # as ``weightCol``; the table has one row per class of CLASSES (4 rows), so
    # the broadcast is bounded
    cw = split.class_weights(sp.filter(F.col("split") == "train"), "class_name") \
        .select("class_name", F.col("weight"))
    joined = sp.join(F.broadcast(cw), "class_name", "left")
    # iterative learners run one job per iteration over this table: partitions
    # of at least LEAST_ROWS rows, and at most ROWS_PER_PARTITION
    n = base.count()
    parts = max(-(-n // ROWS_PER_PARTITION), min(spark.sparkContext.defaultParallelism, max(1, n // LEAST_ROWS)))
    out = joined.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    return TrainingData(out, preparation.features, list(CLASSES), preparation)


# ---------------------------------------------------------------- custom stages
class SigmoidFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sigmoid kernel values tanh(gamma x.l + coef0) against a bounded set of landmark
    rows (the empirical kernel map), saved with the stage. One numpy product a batch."""

    landmarks = Param(Params._dummy(), "landmarks", "landmark rows, one after the other", TypeConverters.toListFloat)
    nFeatures = Param(Params._dummy(), "nFeatures", "input dimension", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel scale", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "kernel offset", TypeConverters.toFloat)

    def __init__(self, inputCol="features", outputCol="kfeat", landmarks=(), n_features: int = 0, gamma: float = 0.1,
                 coef0: float = 0.0):
        super().__init__()
        self._setDefault(landmarks=[], nFeatures=0, gamma=0.1, coef0=0.0)
        self._set(inputCol=inputCol, outputCol=outputCol, landmarks=[float(v) for v in landmarks], nFeatures=n_features,
                  gamma=gamma, coef0=coef0)

    def _transform(self, df: DataFrame) -> DataFrame:
        marks = np.array(self.getOrDefault(self.landmarks)).reshape(-1, max(1, self.getOrDefault(self.nFeatures)))
        gamma, coef0 = self.getOrDefault(self.gamma), self.getOrDefault(self.coef0)

        @F.pandas_udf("array<double>")
        def values(xs: pd.Series) -> pd.Series:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, marks.shape[1]))
            return pd.Series(list(np.tanh(gamma * (x @ marks.T) + coef0)))

        return df.withColumn(self.getOutputCol(),
                             array_to_vector(values(vector_to_array(F.col(self.getInputCol())))))


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                            DefaultParamsWritable):
    """rbf kernel map z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi)
    (Rahimi & Recht, 2007). One numpy matrix product per Arrow batch (pandas
    UDF); W (D x p) is regenerated from the saved seed inside each task."""

    nFeatures = Param(Params._dummy(), "nFeatures", "input dimension", TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "rbf kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(self, inputCol="features", outputCol="rff", n_features: int = 0, dim: int = 64,
                 gamma: float = 0.1, seed: int = 42):
        super().__init__()
        self._setDefault(nFeatures=0, dim=64, gamma=0.1, seed=42)
        self._set(inputCol=inputCol, outputCol=outputCol, nFeatures=n_features, dim=dim, gamma=gamma,
                  seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        d, p = self.getOrDefault(self.dim), self.getOrDefault(self.nFeatures)
        gamma, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def rff(xs: pd.Series) -> pd.Series:
            # W and b are regenerated from the seed in each task (no shipping)
            rng = np.random.default_rng(seed)
            W = rng.normal(0.0, np.sqrt(2 * gamma), size=(d, p))
            b = rng.uniform(0, 2 * np.pi, size=d)
            X = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, p))
            Z = np.sqrt(2.0 / d) * np.cos(X @ W.T + b)
            return pd.Series(list(Z))

        return df.withColumn(self.getOutputCol(),
                             array_to_vector(rff(vector_to_array(F.col(self.getInputCol())))))


class MarginProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Per-class margins (OneVsRest rawPrediction) to probabilities:
    logistic link per class (``2m`` for boosting's log-loss), then normalised."""

    rawCol = Param(Params._dummy(), "rawCol", "column of class margins", TypeConverters.toString)
    outCol = Param(Params._dummy(), "outCol", "column of probabilities", TypeConverters.toString)
    factor = Param(Params._dummy(), "factor", "slope of the logistic link", TypeConverters.toFloat)

    def __init__(self, raw_col="rawPrediction", out_col="probability", factor: float = 2.0):
        super().__init__()
        self._setDefault(rawCol="rawPrediction", outCol="probability", factor=2.0)
        self._set(rawCol=raw_col, outCol=out_col, factor=factor)

    def _transform(self, df: DataFrame) -> DataFrame:
        factor = self.getOrDefault(self.factor)
        p = F.transform(vector_to_array(F.col(self.getOrDefault(self.rawCol))),
                        lambda m: 1.0 / (1.0 + F.exp(-F.lit(factor) * m)))
        tot = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
        return df.withColumn(self.getOrDefault(self.outCol), array_to_vector(F.transform(p, lambda v: v / tot)))


class GBTOneVsRest(Estimator):
    """Multi-class boosting: OneVsRest(GBTClassifier) + MarginProbability.
    Its settings are Spark ML Params, so ``CrossValidator`` grids apply."""

    maxIter = Param(Params._dummy(), "maxIter", "boosting rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "row sample share", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(self, maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, seed=42):
        super().__init__()
        self._setDefault(maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, seed=42)
        self._set(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, subsamplingRate=subsamplingRate,
                  seed=seed)

    def _fit(self, df: DataFrame) -> Model:
        kw = {k: self.getOrDefault(getattr(self, k))
              for k in ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "seed")}
        ovr = OneVsRest(classifier=GBTClassifier(**kw), parallelism=4)
        return PipelineModel([ovr.fit(df), MarginProbability(factor=2.0)])


class MarginColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the OvR class margins as ``svm_margin`` and free the prediction columns."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("rawPrediction", "svm_margin").drop("prediction")


class CalibratedSVM(Estimator):
    """OvR linear SVM on an optional kernel map, Platt-style calibration by a
    multinomial logistic regression on the per-class margins. Its settings
    are Spark ML Params, so ``CrossValidator`` grids apply."""

    C = Param(Params._dummy(), "C", "inverse regularisation", TypeConverters.toFloat)
    kernel = Param(Params._dummy(), "kernel", "linear, rbf, poly or sigmoid", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width: a number, scale or auto", TypeConverters.identity)
    dim = Param(Params._dummy(), "dim", "random features or landmarks of the kernel map", TypeConverters.toInt)
    nFeatures = Param(Params._dummy(), "nFeatures", "input dimension", TypeConverters.toInt)
    degree = Param(Params._dummy(), "degree", "poly degree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "solver iterations", TypeConverters.toInt)
    weighted = Param(Params._dummy(), "weighted", "use the balanced weight column", TypeConverters.toBoolean)

    def __init__(self, C=1.0, kernel="linear", gamma=0.1, n_features=0, degree=2, seed=42, max_iter=50,
                 weighted=False, dim=64):
        super().__init__()
        self._setDefault(C=1.0, kernel="linear", gamma=0.1, nFeatures=0, degree=2, seed=42, maxIter=50,
                         weighted=False, dim=64)
        self._set(C=C, kernel=kernel, gamma=gamma, nFeatures=n_features, degree=degree, seed=seed,
                  maxIter=max_iter, weighted=weighted, dim=dim)

    def _gamma(self, df: DataFrame) -> float:
        """``scale`` = 1 / (p var(X)), ``auto`` = 1 / p, or the number itself."""
        gamma, p = self.getOrDefault(self.gamma), max(1, self.getOrDefault(self.nFeatures))
        if gamma == "auto":
            return 1.0 / p
        if gamma == "scale":
            x = df.select(F.explode(vector_to_array("features")).alias("x"))
            var = x.agg(F.var_pop("x")).first()[0]
            return 1.0 / (p * var) if var else 1.0 / p
        return float(gamma)

    def _fit(self, df: DataFrame) -> Model:
        g = lambda p: self.getOrDefault(p)
        stages = []
        col = "features"
        n = max(1, df.count())
        if g(self.kernel) not in ("linear", "rbf", "poly", "sigmoid"):
            raise ValueError(f"Unknown kernel: {g(self.kernel)}")
        if g(self.kernel) == "rbf":
            stages.append(RandomFourierFeatures("features", "kfeat", g(self.nFeatures), g(self.dim), self._gamma(df),
                                                g(self.seed)))
            col = "kfeat"
        elif g(self.kernel) == "sigmoid":
            # a bounded, seeded set of rows (dim of them) serves as landmarks
            order = F.xxhash64(F.lit(g(self.seed)), F.col("features").cast("string")) if "id" not in df.columns \
                else F.xxhash64(F.lit(g(self.seed)), "id")
            marks = [r[0] for r in df.orderBy(order).limit(g(self.dim)).select(vector_to_array("features")).collect()]
            stages.append(SigmoidFeatures("features", "kfeat", [v for m in marks for v in m], g(self.nFeatures),
                                          self._gamma(df)))
            col = "kfeat"
        elif g(self.kernel) == "poly":
            stages.append(PolynomialExpansion(degree=g(self.degree), inputCol="features", outputCol="kfeat"))
            col = "kfeat"
        # a class needs some hundred short jobs: no more tasks a job than the rows are worth
        cur = df.coalesce(-(-n // SOLVER_ROWS))
        for st in stages:
            cur = st.transform(cur)
        # the kernel map is read once per iteration: keep it while fitting
        cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
        svc = LinearSVC(featuresCol=col, regParam=1.0 / (g(self.C) * n), maxIter=g(self.maxIter))
        ovr = OneVsRest(classifier=svc, featuresCol=col, parallelism=4)
        if g(self.weighted) and "weight" in df.columns:
            ovr.setWeightCol("weight")   # passed on to every binary LinearSVC
        ovr = ovr.fit(cur)
        stages += [ovr, MarginColumns()]
        margins = MarginColumns().transform(ovr.transform(cur))
        lr = LogisticRegression(featuresCol="svm_margin", family="multinomial",
                                maxIter=g(self.maxIter)).fit(margins)
        cur.unpersist()
        return PipelineModel(stages + [lr])


_NODES = ["id", "prediction", "rawCount", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold",
          "split.numCategories"]


class PrunedTree(Estimator):
    """A Spark decision tree whose nodes of fewer than ``least`` rows are leaves.

    Spark ML has no such setting, but the choice of a split does not depend on it:
    the tree is grown without it and such nodes are cut."""

    def __init__(self, tree: DecisionTreeClassifier, least: int):
        super().__init__()
        self.tree, self.least = tree, least

    def _fit(self, df: DataFrame) -> Model:
        model, spark = self.tree.fit(df), df.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
        model.write().save(path)
        saved = spark.read.parquet(f"{path}/data")
        nodes = {r["id"]: r.asDict() for r in saved.collect()}  # one tree, which the driver holds as well
        kept, left = [], [0]
        while left:  # numbered as Spark does, a node before its left and these before its right
            n = nodes[left.pop()]
            kept.append(n)
            if n["leftChild"] >= 0 and n["rawCount"] < self.least:
                n.update(leftChild=-1, rightChild=-1, gain=-1.0, split=(-1, [], -1))
            if n["leftChild"] >= 0:
                left += [n["rightChild"], n["leftChild"]]
        if len(kept) < len(nodes):
            new = {n["id"]: i for i, n in enumerate(kept)} | {-1: -1}
            rows = [tuple({**n, **{c: new[n[c]] for c in ("id", "leftChild", "rightChild")}}.values()) for n in kept]
            spark.createDataFrame(rows, saved.schema).write.mode("overwrite").parquet(f"{path}/data")
            model = DecisionTreeClassificationModel.load(path)
        discard(spark, path)
        return model


def _variants(nodes: pd.DataFrame, x: np.ndarray, stops: list[tuple[int, int]]) -> np.ndarray:
    """(stops, rows) predictions of a tree cut at each (depth, rows from which a node is split)."""
    prediction, count, left, right, feature = (nodes[c].to_numpy() for c in (
        "prediction", "rawCount", "leftChild", "rightChild", "featureIndex"))
    is_set = nodes["numCategories"].to_numpy() >= 0
    threshold = np.array([np.nan if some else v[0] if len(v) else 0.0
                          for v, some in zip(nodes["leftCategoriesOrThreshold"], is_set, strict=True)])
    out, goes_on = np.zeros((len(stops), len(x))), np.ones((len(stops), len(x)), bool)
    rows, at, depth = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    while len(rows):
        for v, (deepest, least) in enumerate(stops):
            here = goes_on[v, rows]
            out[v, rows[here]] = prediction[at[here]]
            goes_on[v, rows] = here & (depth < deepest) & (count[at] >= least)
        on = (left[at] >= 0) & goes_on[:, rows].any(0)
        rows, at = rows[on], at[on]
        value = x[rows, feature[at]]
        to_left = value <= threshold[at]
        for n in np.unique(at[is_set[at]]).tolist():
            to_left[at == n] = np.isin(value[at == n], nodes["leftCategoriesOrThreshold"].iloc[n])
        at, depth = np.where(to_left, left[at], right[at]), depth + 1
    return out


# ---------------------------------------------------------------- registry
def _weighted(est, p):
    """``class_weight='balanced'`` -> the balanced ``weight`` column (M5)."""
    if p.get("class_weight") == "balanced":
        est.setWeightCol("weight")
    return est


def _dt(p):
    tree = _weighted(DecisionTreeClassifier(maxDepth=p.get("max_depth", 5),
                                            minInstancesPerNode=p.get("min_samples_leaf", 10),
                                            impurity=p.get("criterion", "gini"), seed=42), p)
    # a node of fewer rows than two leaves is not split anyway
    least = p.get("min_samples_split", 2)
    return PrunedTree(tree, least) if least > 2 * tree.getMinInstancesPerNode() else tree


def _rf(p):
    return _weighted(RandomForestClassifier(numTrees=p.get("n_estimators", 50), maxDepth=p.get("max_depth", 10),
                                            minInstancesPerNode=p.get("min_samples_leaf", 1), seed=42), p)


def _lr(p, n=1):
    c = p.get("C", 1.0)
    pen = p.get("penalty", "l2")
    enet = {"l2": 0.0, "l1": 1.0, "elasticnet": p.get("l1_ratio", 0.5)}[pen]
    return _weighted(LogisticRegression(family="multinomial", regParam=1.0 / (c * n), elasticNetParam=enet,
                                        standardization=False, maxIter=p.get("max_iter", 50)), p)


def _mlp(p, n_features=1, n_classes=4):
    hidden = list(p.get("hidden_layer_sizes", (50,)))
    return MultilayerPerceptronClassifier(layers=[n_features] + hidden + [n_classes],
                                          maxIter=p.get("max_iter", 100), seed=42)


MODEL_DEFAULTS = {
    "decision_tree": {"max_depth": 5, "min_samples_leaf": 10, "criterion": "gini", "class_weight": "balanced"},
    "random_forest": {"n_estimators": 50, "max_depth": 10, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": 0.1, "class_weight": "balanced"},
    "neural_network": {"hidden_layer_sizes": (50,)},
    "logistic_regression": {"C": 1.0, "penalty": "l2"},
    "knn": {"n_neighbors": 5, "weights": "uniform", "metric": "euclidean"},
}
ALIASES = {"dt": "decision_tree", "rf": "random_forest", "gb": "gradient_boosting",
           "lr": "logistic_regression", "nn": "neural_network"}


def available_models() -> list[str]:
    return list(MODEL_DEFAULTS)


def model_params(name: str) -> dict:
    return dict(MODEL_DEFAULTS[ALIASES.get(name, name)])


def create_model(name: str, n_features: int, n_rows: int = 1, n_classes: int = 4, **params):
    """Spark ML estimator for a registered model name (aliases allowed)."""
    key = ALIASES.get(name, name)
    if key not in MODEL_DEFAULTS:
        raise ValueError(f"Unknown model type: {name}. Available: {available_models()}")
    p = {**MODEL_DEFAULTS[key], **params}
    if key == "decision_tree":
        return _dt(p)
    if key == "random_forest":
        return _rf(p)
    if key == "gradient_boosting":
        return GBTOneVsRest(maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"],
                            subsamplingRate=p["subsample"])
    if key == "svm":
        return CalibratedSVM(C=p["C"], kernel=p["kernel"], gamma=p["gamma"], n_features=n_features, dim=p.get("dim", 64),
                             weighted=p.get("class_weight") == "balanced")
    if key == "neural_network":
        return _mlp(p, n_features, n_classes)
    if key == "logistic_regression":
        return _lr(p, n_rows)
    return KNNClassifier(p["n_neighbors"], p["weights"], p["metric"], float(p.get("p", 2.0)), n_classes)


# The decision tree's grid is the reference's (30: Spark's greatest depth, for none); the others are small
# (the reference's full grids multiply fits by 36-216 x 5 folds).
GRIDS = {
    "decision_tree": {"maxDepth": [3, 5, 7, 10, 30], "minSamplesSplit": [10, 20, 50, 100], "minInstancesPerNode": [5, 10, 20, 50],
                      "impurity": ["gini", "entropy"]},
    "random_forest": {"numTrees": [20, 50], "maxDepth": [5, 10]},
    "logistic_regression": {"elasticNetParam": [0.0, 1.0]},
    "gradient_boosting": {"stepSize": [0.05, 0.1]},
    "svm": {"C": [0.1, 1.0]},
}


def tune(name: str, data: TrainingData, grid: dict | None = None, parallelism: int = 4,
         k_folds: int = 5):
    """M3: grid search by stratified k-fold accuracy on the training rows,
    best model refit on all of them (``CrossValidator`` with ``foldCol``)."""
    grid = GRIDS.get(ALIASES.get(name, name), {}) if grid is None else grid
    if ALIASES.get(name, name) == "decision_tree" and set(grid) <= set(_TREE_SETTINGS):
        return _tune_tree(data, grid, parallelism, k_folds)
    train = data.df.filter(F.col("split") == "train")
    est = create_model(name, len(data.feature_names), n_rows=train.count())
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(est.getParam(pname), values)
    maps = b.build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
                        foldCol="fold", numFolds=k_folds, parallelism=parallelism, seed=42)
    model = cv.fit(train)
    return model.bestModel, list(zip([{p.name: v for p, v in m.items()} for m in maps], model.avgMetrics))


#: Spark ML names of the tree's tuned settings (and one that it lacks) -> names of the registry
_TREE_SETTINGS = {"maxDepth": "max_depth", "minSamplesSplit": "min_samples_split", "minInstancesPerNode": "min_samples_leaf",
                  "impurity": "criterion"}


def _tune_tree(data: TrainingData, grid: dict, parallelism: int, k_folds: int):
    """``tune`` for the decision tree: depth and rows from which a node is split do not change the splits above
    them, so each fold grows one tree for all of these and scores it cut at each."""
    train = data.df.filter(F.col("split") == "train")
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    grown, cuts = ({k: v for k, v in grid.items() if (k in ("maxDepth", "minSamplesSplit")) == cut} for cut in (False, True))
    default = model_params("decision_tree")
    stops = [(c.get("maxDepth", default["max_depth"]), c.get("minSamplesSplit", 2))
             for c in (dict(zip(cuts, v, strict=True)) for v in itertools.product(*cuts.values()))]
    jobs = [(fold, values) for values in itertools.product(*grown.values()) for fold in range(k_folds)]

    def one(job) -> np.ndarray:
        fold, values = job
        settings = {_TREE_SETTINGS[k]: v for k, v in zip(grown, values, strict=True)}
        model = create_model("decision_tree", len(data.feature_names), **settings, max_depth=max(d for d, _ in stops)) \
            .fit(train.filter(F.col("fold") != fold))
        spark = train.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select(*_NODES).toPandas().sort_values("id", ignore_index=True)
        discard(spark, path)

        def score(batches):
            right, n = np.zeros(len(stops), np.int64), 0
            for b in batches:
                if len(b):
                    right, n = right + (_variants(nodes, np.stack(b["x"].to_numpy()), stops) == b["label"].to_numpy()).sum(1), n + len(b)
            yield pd.DataFrame({"stop": np.arange(len(stops)), "right": right, "n": n})

        held = train.filter(F.col("fold") == fold).select(vector_to_array("features").alias("x"), "label")
        told = held.mapInPandas(score, "stop int, right long, n long").groupBy("stop").agg(
            F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy")).orderBy("stop").collect()  # a row a stop
        return np.array([r["accuracy"] for r in told], float)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        found = list(pool.map(inheritable_thread_target(one), jobs))
    accuracy = {values: np.mean([a for (_, v), a in zip(jobs, found, strict=True) if v == values], axis=0) for _, values in jobs}
    scores = [(p, float(accuracy[tuple(p[k] for k in grown)][stops.index(
        (p.get("maxDepth", default["max_depth"]), p.get("minSamplesSplit", 2)))])) for p in points]
    best = {_TREE_SETTINGS[k]: v for k, v in max(scores, key=lambda g: g[1])[0].items()}
    return create_model("decision_tree", len(data.feature_names), **best).fit(train), scores


# ---------------------------------------------------------------- scoring and evaluation
def predictions(model, df: DataFrame, classes=CLASSES) -> DataFrame:
    """Score a whole table: id, split, true and predicted class names, probability array."""
    out = model.transform(df)
    cls = F.array(*[F.lit(c) for c in classes])
    prob = vector_to_array("probability") if "probability" in out.columns else F.lit(None)
    return out.select("id", "split", F.col("class_name").alias("y_true"),
                      F.element_at(cls, F.col("prediction").cast("int") + 1).alias("y_pred"),
                      prob.alias("probability"))


def out_of_fold(name: str, data: TrainingData, k: int = 5, params: dict | None = None, parallelism: int = 5) -> DataFrame:
    """M2: (model, id, fold, y_true, y_pred, probability) of every training row, from the model fitted on the other folds.

    The folds are fitted side by side and each is written as it ends; cross-validation
    figures, the comparison's CV column and votes are all taken from this table."""
    train = data.df.filter(F.col("split") == "train")
    n = train.count()

    def one(fold: int) -> DataFrame:
        est = create_model(name, len(data.feature_names), n_rows=n, n_classes=len(data.classes), **(params or {}))
        model = est.fit(train.filter(F.col("fold") != fold))
        held = predictions(model, train.filter(F.col("fold") == fold), data.classes)
        return written(held.select(F.lit(name).alias("model"), "id", F.lit(fold).alias("fold"), "y_true", "y_pred",
                                   F.col("probability").cast("array<double>").alias("probability")), "fold")

    with ThreadPoolExecutor(max(1, min(k, parallelism))) as pool:
        parts = list(pool.map(inheritable_thread_target(one), range(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cv_summary(oof: DataFrame, pred_col: str = "y_pred") -> DataFrame:
    """M4 from stored out-of-fold predictions, a row a model: mean and (population) std of the
    fold accuracies, means of the folds' weighted precision / recall / F1."""
    per_fold = summary_metrics(oof, pred_col=pred_col, by=["model", "fold"])
    return per_fold.groupBy("model").agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
        F.avg("precision").alias("cv_precision"), F.avg("recall").alias("cv_recall"), F.avg("f1").alias("cv_f1"))


def cv_rows(oof: DataFrame) -> DataFrame:
    """The cross-validation figures as report rows (model, split 'cv', metric, value)."""
    named = cv_summary(oof).select("model", F.col("cv_mean").alias("accuracy"), F.col("cv_std").alias("accuracy_std"),
                                   F.col("cv_precision").alias("precision"), F.col("cv_recall").alias("recall"),
                                   F.col("cv_f1").alias("f1"))
    long = named.unpivot(["model"], ["accuracy", "accuracy_std", "precision", "recall", "f1"], "metric", "value")
    return long.select("model", F.lit("cv").alias("split"), "metric", "value")


def split_metrics(pred: DataFrame, model_name: str) -> DataFrame:
    """Long metric table (model, split, metric, value) for train / val / test."""
    m = summary_metrics(pred, by=["split"])
    long = m.unpivot(["split"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    return long.select(F.lit(model_name).alias("model"), "split", "metric", "value")


#: Spark ML names of tuned settings -> names of the registry
_SETTINGS = {**_TREE_SETTINGS,
             "numTrees": "n_estimators", "stepSize": "learning_rate", "elasticNetParam": "l1_ratio", "C": "C", "maxIter": "n_estimators"}


def tuned_params(model, grid_scores) -> dict:
    """Registry settings of the grid point that won (none without a grid)."""
    if not grid_scores:
        return {}
    best = max(grid_scores, key=lambda g: g[1])[0]
    out = {_SETTINGS[k]: v for k, v in best.items() if k in _SETTINGS}
    return {**out, "penalty": "elasticnet"} if "l1_ratio" in out else out


def train_single_model(name: str, data: TrainingData, do_tune: bool = True, save_path: str | None = None,
                       cv: int | None = 5, held: DataFrame | None = None):
    """Tune, fit, score the three splits, time it, cross-validate in ``cv`` folds
    (or take the stored out-of-fold table ``held``), optionally save (S5)."""
    t0 = time.time()
    if do_tune and ALIASES.get(name, name) in GRIDS:
        model, grid_scores = tune(name, data)
    else:
        train = data.df.filter(F.col("split") == "train")
        model = create_model(name, len(data.feature_names), n_rows=train.count()).fit(train)
        grid_scores = []
    pred = written(predictions(model, data.df), "predictions")
    metrics = written(split_metrics(pred, name), "metrics")
    elapsed = time.time() - t0
    if cv:
        held = held if held is not None else out_of_fold(name, data, cv, tuned_params(model, grid_scores))
        metrics = written(metrics.unionByName(cv_rows(held)), "metrics")
    if save_path:
        from cohortlens.sources.io import save_model
        save_model(model, save_path, metrics)
    return {"model": model, "predictions": pred, "metrics": metrics, "training_time": elapsed,
            "grid": grid_scores, "out_of_fold": held}


def soft_vote(preds: list[DataFrame], classes=CLASSES) -> DataFrame:
    """Average the members' probability arrays per id, arg max (first
    class on ties). Members are the already fitted models' outputs."""
    u = None
    for p in preds:
        s = p.select("id", "split", "y_true", "probability")
        u = s if u is None else u.unionByName(s)
    n = len(classes)
    avg = u.groupBy("id", "split", "y_true").agg(
        *[F.avg(F.col("probability")[i]).alias(f"p{i}") for i in range(n)])
    arr = F.array(*[F.col(f"p{i}") for i in range(n)])
    # equal averages can differ in the last bit by the order of their sum: twelve digits decide
    near = F.transform(arr, lambda v: F.round(v, 12))
    best = F.array_position(near, F.array_max(near)) - 1
    cls = F.array(*[F.lit(c) for c in classes])
    return avg.select("id", "split", "y_true", F.element_at(cls, (best + 1).cast("int")).alias("y_pred"),
                      arr.alias("probability"))


def run_all(data: TrainingData, names=("decision_tree", "random_forest", "gradient_boosting", "svm",
                                        "neural_network", "logistic_regression"),
            do_tune: bool = False, cv: int | None = 5, stored: dict[str, DataFrame] | None = None
            ) -> tuple[dict, DataFrame]:
    """Train every model; failing models are recorded, not raised (X11);
    soft-voting ensemble over forest, boosting and SVM when all three exist."""
    spark = data.df.sparkSession
    results, tables, errors = {}, [], []
    for name in names:
        try:
            r = train_single_model(name, data, do_tune=do_tune, cv=cv, held=(stored or {}).get(name))
            results[name] = r
            tables.append(r["metrics"].withColumn("training_time", F.lit(r["training_time"])))
        except Exception as ex:  # noqa: BLE001 - one failing model must not stop the run
            errors.append((name, f"{type(ex).__name__}: {ex}"[:500]))
    members = [results[m]["predictions"] for m in ("random_forest", "gradient_boosting", "svm") if m in results]
    if len(members) == 3:
        t0 = time.time()
        ens = soft_vote(members)
        m = split_metrics(ens, "ensemble")
        m.count()
        tables.append(m.withColumn("training_time", F.lit(time.time() - t0)))
        results["ensemble"] = {"predictions": ens, "metrics": m}
    report = tables[0]
    for t in tables[1:]:
        report = report.unionByName(t)
    if errors:
        err = spark.createDataFrame(errors, "model string, error string")
        report = report.unionByName(err.select("model", F.lit(None).cast("string").alias("split"),
                                               F.lit("error").alias("metric"),
                                               F.lit(None).cast("double").alias("value"),
                                               F.lit(None).cast("double").alias("training_time")))
    return results, report


def best_model(report: DataFrame, order=None) -> DataFrame:
    """L4: highest test accuracy; the first model in run order wins ties."""
    order = order or list(MODEL_DEFAULTS) + ["ensemble"]
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    t = report.filter((F.col("split") == "test") & (F.col("metric") == "accuracy"))
    return t.orderBy(F.desc("value"), pos).limit(1).select("model", F.col("value").alias("test_accuracy"))


# ---------------------------------------------------------------- X1, M20
def native_importance(model, feature_names, model_name: str, spark: SparkSession) -> DataFrame:
    """Tree importances, or the mean |coefficient| over classes for linear models."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficientMatrix"):
        vals = np.abs(m.coefficientMatrix.toArray()).mean(axis=0).tolist()
    else:
        raise ValueError(f"{model_name} has no native importance")
    rows = list(zip([model_name] * len(vals), feature_names, [float(v) for v in vals]))
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def leaf_rules(model, feature_names) -> list[tuple[int, str, float, int]]:
    """(leaf, rule, prediction, depth) of every leaf of a fitted tree, leaves numbered as
    ``leafCol`` does (left to right). A rule is an SQL condition over the feature
    names; there are at most 2**maxDepth of them."""
    out, left = [], [(model._java_obj.rootNode(), [], 0)]
    while left:
        node, path, depth = left.pop()
        if not hasattr(node, "leftChild") or node.getClass().getSimpleName() == "LeafNode":
            out.append((len(out), " AND ".join(path) or "true", float(node.prediction()), depth))
            continue
        test, name = node.split(), f"`{feature_names[node.split().featureIndex()]}`"
        if test.getClass().getSimpleName() == "ContinuousSplit":
            yes, no = (f"{name} {op} {test.threshold()!r}D" for op in ("<=", ">"))
        else:
            these, those = (", ".join(f"{float(v)!r}D" for v in c) for c in (test.leftCategories(), test.rightCategories()))
            yes, no = f"{name} IN ({these})", f"{name} IN ({those})"
        left += [(node.rightChild(), [*path, no], depth + 1), (node.leftChild(), [*path, yes], depth + 1)]
    return out


def tree_leaves(model, df: DataFrame, feature_names) -> DataFrame:
    """A row for each leaf of a fitted decision tree: its rule, predicted class, support and class mix."""
    m = model.copy()
    m.setLeafCol("leaf")
    mix = m.transform(df).groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("support"),
        *[F.sum((F.col("label") == i).cast("int")).alias(f"n_{c}") for i, c in enumerate(CLASSES)])
    rules = df.sparkSession.createDataFrame(leaf_rules(model, feature_names),
                                            "leaf int, rule string, prediction double, depth int")
    names = F.array(*[F.lit(c) for c in CLASSES])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ["support", *[f"n_{c}" for c in CLASSES]]]
    return rules.join(mix, "leaf", "left").select(
        "leaf", "rule", F.element_at(names, F.col("prediction").cast("int") + 1).alias("class_name"), "depth", *counts)


def tree_rules(model, feature_names) -> str:
    """Rule text of a fitted tree with feature names substituted."""
    text = model.toDebugString
    for i in sorted(range(len(feature_names)), key=lambda j: -j):
        text = text.replace(f"feature {i} ", f"{feature_names[i]} ")
    return text


# ---------------------------------------------------------------- M16
class RiskModel:
    """Common model contract: train, predict, predict_proba, info. Using an
    untrained model is an error. Wraps any registered Spark ML estimator."""

    def __init__(self, name: str, **params):
        self.name = ALIASES.get(name, name)
        self.params = {**model_params(self.name), **params}
        self.model = None
        self.metrics: DataFrame | None = None
        self.classes = list(CLASSES)

    def _check(self):
        if self.model is None:
            raise ValueError("Model must be trained before use")

    def train(self, data: TrainingData, cv: int | None = 5) -> DataFrame:
        train = data.df.filter(F.col("split") == "train")
        self.classes = data.classes
        est = create_model(self.name, len(data.feature_names), n_rows=train.count(),
                           n_classes=len(data.classes), **self.params)
        self.model = est.fit(train)
        self.metrics = split_metrics(predictions(self.model, data.df, self.classes), self.name)
        if cv:
            self.metrics = self.metrics.unionByName(cv_rows(out_of_fold(self.name, data, cv, self.params)))
        return self.metrics

    def predict(self, df: DataFrame) -> DataFrame:
        self._check()
        cls = F.array(*[F.lit(c) for c in self.classes])
        return self.model.transform(df).select(
            "id", F.element_at(cls, F.col("prediction").cast("int") + 1).alias("prediction"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Probability array; a model without one gets the one-hot of its
        prediction sized by the full class count (M17)."""
        self._check()
        from cohortlens.operators.labels import one_hot_probability
        out = self.model.transform(df)
        if "probability" in out.columns:
            return out.select("id", vector_to_array("probability").alias("probability"))
        return out.select("id", one_hot_probability(F.col("prediction").cast("int"),
                                                    len(self.classes)).alias("probability"))

    def info(self) -> dict:
        return {"model_type": self.name, "params": dict(self.params), "is_trained": self.model is not None,
                "classes": list(self.classes)}
