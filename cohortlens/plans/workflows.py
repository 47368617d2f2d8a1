"""End-to-end flows (the three entry points of the blueprint, section 3).

A. ``train_and_explain``: prepare, train every model, ensemble, report, save
   models, native importance, Shapley attributions, explanations with
   recommendations, risk predictions appended.
B. ``dashboard_tables``: totals, per-level student lists with factors, risk
   distribution.
C. ``validate_saved_models``: score the whole table with each saved model
   (missing / failing models become error rows), accuracy and sample rows.

The roster is a delimited file with a header (``sep``), its columns in any order
and with or without ids, or the roster view over a folder of tables. Training
saves the fitted preparation beside the models; validation applies that one to
the roster it is given, so new rows are scored with the statistics of training.

Every step is a Spark job writing to ``out_dir`` (a shared folder on a
cluster); nothing is collected except bounded summaries.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import explain as ex
from cohortlens.operators import metrics as mt
from cohortlens.operators import profile, risk
from cohortlens.operators.prepare import RosterPreparationModel
from cohortlens.plans import models as ml
from cohortlens.plans import shapley as sh
from cohortlens.session import written
from cohortlens.sources import io

DEFAULT_MODELS = ("decision_tree", "random_forest", "gradient_boosting", "svm", "neural_network",
                  "logistic_regression")


def roster_of(spark: SparkSession, data: str, sep: str = ",") -> DataFrame:
    """The roster of a delimited file, or of a folder of tables."""
    if data.rstrip("/").lower().endswith((".csv", ".txt", ".tsv")):
        return io.read_roster(spark, data, sep)
    return fx.roster(spark, data)


def train_and_explain(spark: SparkSession, data_dir: str, out_dir: str, models=DEFAULT_MODELS,
                      tune: bool = False, n_explain: int = 50, n_background: int = 100,
                      n_perm: int = 4, sep: str = ",", fit_on: str = "all") -> dict:
    """Flow A. Returns a small summary (best model, timings, output paths)."""
    out = out_dir.rstrip("/")
    t0 = time.time()
    roster = roster_of(spark, data_dir, sep)
    data = ml.prepare_roster(roster, fit_on=fit_on)
    data.preparation.write().overwrite().save(f"{out}/preparation")
    results, report = ml.run_all(data, names=models, do_tune=tune)
    io.write_report(report, f"{out}/report")
    best = ml.best_model(report).first()
    fitted = {n: r["model"] for n, r in results.items() if "model" in r}
    for name, model in fitted.items():
        io.save_model(model, f"{out}/models/{name}", results[name]["metrics"],
                      info={"model_type": name, "n_features": len(data.feature_names),
                            "training_time": results[name]["training_time"]})
        test_acc = (results[name]["metrics"].filter((F.col("split") == "test") & (F.col("metric") == "accuracy"))
                    .select("value").first())
        io.append_run_metadata(spark, f"{out}/runs", name, ml.model_params(name),
                               {"n_features": len(data.feature_names), "classes": data.classes},
                               test_acc["value"] if test_acc else None)
    # Native importance where the model has one
    imps = []
    for name, model in fitted.items():
        try:
            imps.append(ml.native_importance(model, data.feature_names, name, spark))
        except ValueError:
            continue
    if imps:
        imp = imps[0]
        for i in imps[1:]:
            imp = imp.unionByName(i)
        io.write_csv(imp, f"{out}/native_importance")
    # Shapley attributions of every model with probabilities
    attr = sh.attribute_models(fitted, data.df, data.feature_names, data.classes,
                               n_explain=n_explain, n_background=n_background, n_perm=n_perm)
    attr.write.mode("overwrite").parquet(f"{out}/attributions")
    attr = spark.read.parquet(f"{out}/attributions")
    good = attr.filter(F.col("error").isNull())
    io.write_csv(ex.global_importance(good, by=["model"]), f"{out}/shap_importance")
    # Explanations of the best single model
    best_single = best["model"] if best and best["model"] in fitted else next(iter(fitted))
    own = good.filter(F.col("model") == best_single).drop("model", "error")
    # factors and rules speak of the students' own values, not of z-scores
    own = ex.with_raw_values(own, roster, "id")
    expl = sh.explain_rows(fitted[best_single], data.df, own, data.classes, 5)
    recs = ex.recommendations(own.join(expl.select("id", F.col("predicted").alias("class_name")),
                                       ["id", "class_name"]), "id").drop("class_name")
    expl = written(expl.join(recs, "id", "left"), "explanations")
    io.write_explanations(expl, f"{out}/explanations")
    # Predictions of the best single model appended, with factors, explanation and recommendations
    io.append_predictions(ml.predictions(fitted[best_single], data.df), f"{out}/predictions", best_single, roster, expl)
    return {"best_model": best["model"] if best else None,
            "best_test_accuracy": best["test_accuracy"] if best else None,
            "explained_model": best_single, "seconds": round(time.time() - t0, 1), "out_dir": out}


def dashboard_tables(spark: SparkSession, data_dir: str, out_dir: str, sep: str = ",") -> dict:
    """Flow B: A17 totals, R1-R3 lists, A19 distribution (parquet)."""
    out = out_dir.rstrip("/")
    roster = roster_of(spark, data_dir, sep)
    risk.dashboard_totals(roster).write.mode("overwrite").parquet(f"{out}/totals")
    lists = risk.dashboard(roster)
    lists.write.mode("overwrite").partitionBy("level").parquet(f"{out}/students")
    profile.distribution(lists, "level").write.mode("overwrite").parquet(f"{out}/distribution")
    return spark.read.parquet(f"{out}/totals").first().asDict()


def validate_saved_models(spark: SparkSession, data_dir: str, model_paths: dict, out_dir: str, preparation: str,
                          sep: str = ",") -> DataFrame:
    """Flow C: S10 batch scoring, V4 accuracy percent, V5 first rows, V9 grade.

    The saved ``preparation`` is applied, not fitted again; every row of the roster is scored."""
    out = out_dir.rstrip("/")
    fitted = RosterPreparationModel.load(preparation)
    rows = ml.feature_table(fitted.transform(roster_of(spark, data_dir, sep)), fitted)
    scored = io.batch_score(spark, rows, model_paths, ml.CLASSES)
    scored.write.mode("overwrite").parquet(f"{out}/scored")
    scored = spark.read.parquet(f"{out}/scored")
    ok = scored.filter(F.col("error").isNull())
    acc = mt.accuracy_percent(ok, "y_true", "y_pred")
    g, pos = mt.grade_model()
    errors = scored.filter(F.col("error").isNotNull()).select(
        "model", F.lit(None).cast("double").alias("accuracy_pct"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("string").alias("grade"), F.lit(None).cast("boolean").alias("positive"), "error")
    summary = acc.select("model", "accuracy_pct", "n", g, pos, F.lit(None).cast("string").alias("error")) \
        .unionByName(errors)
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    mt.sample_comparisons(ok, "id", "y_true", "y_pred", 10).write.mode("overwrite").parquet(f"{out}/samples")
    return spark.read.parquet(f"{out}/summary")
