"""Registered ML queries (rows-only checks: training and sampling are
iterative / randomised, correctness is covered by invariants in tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens import fixtures as _fx
from cohortlens.plans import models as ml
from cohortlens.plans import sqlgen
from cohortlens.plans import shapley as sh
from cohortlens.plans.registry import register, rounded
from cohortlens.session import checkpoint_dir, written

_W = _fx.with_views

_CACHE: dict = {}
ALL_MODELS = ("decision_tree", "random_forest", "gradient_boosting", "svm", "neural_network", "logistic_regression")

_P_CTES, _P, _ = sqlgen.preprocess_ctes()
_QE = [f"(SELECT quantile_cont(label, {q}) FROM {_P})" for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
# E11 -> quantile classes -> exact stratified split / folds -> balanced weights
_TRAIN_CTES = _P_CTES + f""",
cls AS (SELECT student_id AS id, CASE WHEN label >= {_QE[0]} AND label <= {_QE[1]} THEN 'Critical'
    WHEN label > {_QE[1]} AND label <= {_QE[2]} THEN 'High'
    WHEN label > {_QE[2]} AND label <= {_QE[3]} THEN 'Medium'
    WHEN label > {_QE[3]} AND label <= {_QE[4]} THEN 'Low' ELSE 'Medium' END AS class_name FROM {_P}),
ranked AS (SELECT id, class_name,
    row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS r,
    count(*) OVER (PARTITION BY class_name) AS n FROM cls),
sp AS (SELECT id, class_name,
    CASE WHEN r < n * 0.7 THEN 'train' WHEN r < n * 0.8 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN r < n * 0.7 THEN CAST(r % 5 AS INT) END AS fold FROM ranked),
w AS (SELECT class_name, (SELECT count(*) FROM sp WHERE split = 'train')
        / ((SELECT count(DISTINCT class_name) FROM sp WHERE split = 'train') * count(*)) AS weight
      FROM sp WHERE split = 'train' GROUP BY class_name)"""


def _app(spark) -> str:
    # the application id changes with every new SparkContext (object ids may be reused)
    return spark.sparkContext.applicationId


def training_data(spark, sf_dir) -> ml.TrainingData:
    key = (_app(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = ml.prepare_training_data(spark, sf_dir)
    return _CACHE[key]


def _fitted(spark, sf_dir, name):
    key = (_app(spark), sf_dir, "model", name)
    if key not in _CACHE:
        d = training_data(spark, sf_dir)
        train = d.df.filter(F.col("split") == "train")
        _CACHE[key] = ml.create_model(name, len(d.feature_names), n_rows=train.count()).fit(train)
    return _CACHE[key]


def _held(spark, sf_dir, name):
    """The stored out-of-fold predictions of a model."""
    key = (_app(spark), sf_dir, "held", name)
    if key not in _CACHE:
        _CACHE[key] = ml.out_of_fold(name, training_data(spark, sf_dir))
    return _CACHE[key]


def _pred_query(name):
    def q(spark, sf_dir):
        d = training_data(spark, sf_dir)
        p = ml.predictions(_fitted(spark, sf_dir, name), d.df)
        return rounded(p.select("id", "split", "y_true", "y_pred",
                                F.array_max("probability").alias("confidence")))
    return q


for _qname, _model in [("m06_decision_tree", "decision_tree"), ("m09_random_forest", "random_forest"),
                       ("m10_gradient_boosting", "gradient_boosting"), ("m08_m11_svm", "svm"),
                       ("m12_neural_network", "neural_network"), ("m07_knn_model", "knn"),
                       ("m13_logistic_regression", "logistic_regression")]:
    register(_qname)(_pred_query(_model))


def _m03(spark, sf_dir):
    d = training_data(spark, sf_dir)
    _, scores = ml.tune("decision_tree", d)
    rows = [(str(sorted(p.items())), float(s)) for p, s in scores]
    return rounded(spark.createDataFrame(rows, "params string, cv_accuracy double"))


register("m03_grid_search")(_m03)


def _m04(spark, sf_dir):
    d = training_data(spark, sf_dir)
    held = [_held(spark, sf_dir, m) for m in ALL_MODELS]
    stored = held[0]
    for h in held[1:]:
        stored = stored.unionByName(h)
    return rounded(ml.cv_summary(stored))


register("m04_cross_validation")(_m04)


def _m14(spark, sf_dir):
    d = training_data(spark, sf_dir)
    members = [ml.predictions(_fitted(spark, sf_dir, m), d.df)
               for m in ("random_forest", "gradient_boosting", "svm")]
    e = ml.soft_vote(members)
    return rounded(e.select("id", "split", "y_true", "y_pred", F.array_max("probability").alias("confidence")))


register("m14_ensemble")(_m14)


def _m19(spark, sf_dir):
    d = training_data(spark, sf_dir)
    _, report = ml.run_all(d, stored={m: _held(spark, sf_dir, m) for m in ALL_MODELS})
    return rounded(report)


register("m19_train_all")(_m19)


def _m20(spark, sf_dir):
    d = training_data(spark, sf_dir)
    return ml.tree_leaves(_fitted(spark, sf_dir, "decision_tree"), d.df, d.feature_names)


register("m20_tree_leaves")(_m20)


def _x01(spark, sf_dir):
    d = training_data(spark, sf_dir)
    rf = ml.native_importance(_fitted(spark, sf_dir, "random_forest"), d.feature_names, "random_forest", spark)
    lr = ml.native_importance(_fitted(spark, sf_dir, "logistic_regression"), d.feature_names,
                              "logistic_regression", spark)
    return rounded(rf.unionByName(lr))


register("x01_native_importance")(_x01)


def _shap(spark, sf_dir):
    d = training_data(spark, sf_dir)
    return sh.shapley_values(_fitted(spark, sf_dir, "logistic_regression"), d.df, d.feature_names,
                             d.classes)


def _x03(spark, sf_dir):
    return rounded(_shap(spark, sf_dir))


register("x03_shapley_sampling")(_x03)


def _x07(spark, sf_dir):
    d = training_data(spark, sf_dir)
    # both factor lists read the attribution table: compute it once
    attr = written(_shap(spark, sf_dir), "attributions")
    e = sh.explain_rows(_fitted(spark, sf_dir, "logistic_regression"), d.df, attr, d.classes, 5)
    names = lambda c: F.array_join(F.transform(c, lambda s: s["feature"]), "|")
    return rounded(e.select("id", "actual", "predicted", "confidence",
                            names(F.col("positive_factors")).alias("positive_factors"),
                            names(F.col("negative_factors")).alias("negative_factors")))


register("x07_explain_rows")(_x07)


def _x09(spark, sf_dir):
    d = training_data(spark, sf_dir)
    return sh.one_per_class(d.df, d.classes).select("id", "class_name")


register("x09_one_per_class", _W("""
SELECT id, class_name FROM (
  SELECT id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS rn
  FROM sp WHERE split = 'test') t
WHERE rn = 1 ORDER BY list_position(['Critical', 'High', 'Low', 'Medium'], class_name) LIMIT 3""",
    "roster", ctes=_TRAIN_CTES))(_x09)


def _m01t(spark, sf_dir):
    d = training_data(spark, sf_dir)
    return rounded(d.df.select("id", "class_name", "label", "split", "fold", "weight"))


register("m01_m02_m05_training_table", _W("""
SELECT sp.id, sp.class_name, CAST(list_position(['Critical', 'High', 'Low', 'Medium'], sp.class_name) - 1 AS DOUBLE) AS label,
  sp.split, sp.fold, round(w.weight, 6) AS weight
FROM sp LEFT JOIN w ON sp.class_name = w.class_name""", "roster", ctes=_TRAIN_CTES))(_m01t)


def _x13(spark, sf_dir):
    d = training_data(spark, sf_dir)
    return rounded(sh.base_values(_fitted(spark, sf_dir, "logistic_regression"), d.df, d.classes))


register("x13_base_values")(_x13)


def _s10(spark, sf_dir):
    from cohortlens.sources.io import batch_score, save_model
    d = training_data(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    save_model(_fitted(spark, sf_dir, "decision_tree"), f"{base}/decision_tree")
    save_model(_fitted(spark, sf_dir, "logistic_regression"), f"{base}/logistic_regression")
    paths = {"Decision Tree": f"{base}/decision_tree", "Logistic Regression": f"{base}/logistic_regression",
             "KNN": f"{base}/missing_model"}
    return batch_score(spark, d.df, paths, d.classes)


register("s10_batch_scoring")(_s10)


def _x10(spark, sf_dir):
    from cohortlens import fixtures as fx
    d = training_data(spark, sf_dir)
    rep = sh.sample_report(_fitted(spark, sf_dir, "random_forest"), d.df, fx.roster(spark, sf_dir),
                           d.classes, n=5)
    return rounded(rep.withColumn("probability", F.array_join(
        F.transform("probability", lambda v: F.format_number(v, 4)), "|")))


register("x10_sample_report")(_x10)


def _x11(spark, sf_dir):
    d = training_data(spark, sf_dir)
    models = {m: _fitted(spark, sf_dir, m) for m in ALL_MODELS}
    out = sh.attribute_models(models, d.df, d.feature_names, d.classes)
    return rounded(out)


register("x11_attribute_all_models")(_x11)


def _m16(spark, sf_dir):
    d = training_data(spark, sf_dir)
    m = ml.RiskModel("dt")
    metrics = m.train(d)
    return rounded(metrics)


register("m16_model_contract")(_m16)
