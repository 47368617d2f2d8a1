"""Hand-worked rows for the semantic traps of the blueprint (one test each)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import activity, bands, clean, encode, features, risk


def _grades(spark, values, col="G3"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                 T.StructType([T.StructField("student_id", T.LongType()),
                                               T.StructField(col, T.DoubleType())]))


def test_bins_are_right_closed(spark):
    df = bands.risk_bands(_grades(spark, [9.0, 9.5, 11.0, 14.0, 14.5, -1.0, 21.0]), "G3", "loader")
    got = [r["risk_level"] for r in df.orderBy("student_id").collect()]
    assert got == ["Critical", "High", "High", "Medium", "Low", None, None]


def test_threshold_zero_and_null_are_medium(spark):
    df = bands.risk_bands(_grades(spark, [0.0, None, 8.0, 8.5, 20.0]), "G3", "threshold")
    assert [r["risk_level"] for r in df.orderBy("student_id").collect()] == \
        ["Medium", "Medium", "Critical", "High", "Low"]


def test_quantile_lowest_edge_included_and_fallback(spark):
    df = bands.risk_bands(_grades(spark, [0.0, 5.0, 10.0, 15.0, 20.0, None]), "G3", "quantile")
    assert [r["risk_level"] for r in df.orderBy("student_id").collect()] == \
        ["Critical", "Critical", "High", "Medium", "Low", "Medium"]
    # repeated quartile edges -> equal width bins over [min, max]
    df = bands.risk_bands(_grades(spark, [1.0, 1.0, 1.0, 1.0, 9.0]), "G3", "quantile")
    assert [r["risk_level"] for r in df.orderBy("student_id").collect()] == \
        ["Critical", "Critical", "Critical", "Critical", "Low"]


def test_quantile_without_grades_raises(spark):
    with pytest.raises(ValueError):
        bands.risk_bands(_grades(spark, [None, None]), "G3", "quantile")


def test_out_of_range_text_nan_for_features_null_for_bands(spark):
    df = spark.createDataFrame([(1, 23.0, 120.0)], "student_id long, age double, absences double")
    r = df.select(features.right_closed_cut("age", features.AGE_EDGES, features.AGE_LABELS, other="nan").alias("a"),
                  bands.loader_band(F.col("absences")).alias("b")).first()
    assert r["a"] == "nan" and r["b"] is None


def test_unknown_takes_a_sorted_slot(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None)], "student_id long, paid string")
    m = encode.fit_label_codes(df, ["paid"])
    codes = {r["value"]: r["code"] for r in m.collect()}
    assert codes == {"no": 0, "unknown": 1, "yes": 2}
    out = encode.apply_label_codes(df, m, ["paid"]).orderBy("student_id").collect()
    assert [r["paid"] for r in out] == [2, 0, 1]
    unseen = spark.createDataFrame([(4, "maybe")], "student_id long, paid string")
    assert encode.apply_label_codes(unseen, m, ["paid"]).first()["paid"] == 1


def test_scaling_uses_population_std_and_skips_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "student_id long, x double, c double")
    out = {r["student_id"]: r for r in encode.smart_scaling(df).collect()}
    assert out[1]["x"] == pytest.approx(-1.0) and out[2]["x"] == pytest.approx(1.0)
    assert out[1]["c"] == 5.0   # sample std 0 -> untouched


def test_outlier_stats_come_from_unfiltered_table(spark):
    rows = [(i, 0.0) for i in range(20)] + [(99, 100.0)]
    df = spark.createDataFrame(rows, "student_id long, x double")
    kept = {r["student_id"] for r in clean.remove_outliers(df).collect()}
    assert 99 not in kept and len(kept) == 20
    # a null value has a non-finite z and passes
    df2 = df.unionByName(spark.createDataFrame([(100, None)], "student_id long, x double"))
    assert 100 in {r["student_id"] for r in clean.remove_outliers(df2).collect()}


def test_clean_makes_doubles_fills_and_clips_target(spark):
    rows = [(i, i, float(i)) for i in range(100)] + [(100, None, float("nan"))]
    df = spark.createDataFrame(rows, "student_id long, n int, G3 double")
    out = clean.clean(df)
    assert dict(out.dtypes)["n"] == "double"
    r = {x["student_id"]: x for x in out.collect()}
    assert r[100]["n"] == pytest.approx(49.5 + 0.0, abs=1.0)  # median fill, then clip range
    assert r[0]["G3"] > 0.0 and r[99]["G3"] < 99.0            # target clipped to [p01, p99]


def test_nan_is_converted_to_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "doc_id long, x double")
    got = [r["x"] for r in clean.nonfinite_to_null(df, ["x"]).orderBy("doc_id").collect()]
    assert got == [None, None, 1.0]


def _events(spark, rows):
    schema = ("event_id long, student_id long, date timestamp_ntz, grade double, attendance_rate double, "
              "lms_logins int, page_views int, resource_downloads int, discussion_posts int, "
              "assignment_completion_rate double, submission_status string")
    return spark.createDataFrame(rows, schema)


def test_late_rate_and_weekend_ratio_are_null_not_zero(spark):
    mon, sat = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 6, 10)   # Monday, Saturday
    rows = [(1, 7, mon, 50.0, 0.5, 1, 0, 0, 0, 0.5, "on_time"),
            (2, 7, mon + dt.timedelta(days=1), 60.0, 0.5, 1, 0, 0, 0, 0.5, "on_time"),
            (3, 8, sat, 70.0, 0.5, 1, 0, 0, 0, 0.5, "late"),
            (4, 8, mon, 80.0, 0.5, 0, 0, 0, 0, 0.5, "on_time")]
    f = {r["student_id"]: r for r in
         activity.activity_features(_events(spark, rows), "2024-01-31 00:00:00", 30).collect()}
    assert f[7]["late_submission_rate"] is None and f[8]["late_submission_rate"] == 0.5
    assert f[7]["weekend_activity_ratio"] is None            # no weekend row
    assert f[8]["weekend_activity_ratio"] == pytest.approx(1.0 / (0 + 1))
    assert f[7]["grade_trend"] is None                      # fewer than 3 rows


def test_weekday_counts_monday_as_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6),), (dt.datetime(2024, 1, 8),)], "date timestamp_ntz")
    assert [r["is_weekend"] for r in features.weekend_flag(df).collect()] == [True, False]


def test_grade_trend_with_null_inside_last_window(spark):
    base = dt.datetime(2024, 1, 1)
    g = [10.0, 20.0, 30.0, 40.0, None]
    rows = [(i, 1, base + dt.timedelta(hours=i), v, 0.5, 0, 0, 0, 0, 0.5, "on_time") for i, v in enumerate(g)]
    t = activity.grade_trend(_events(spark, rows)).first()
    assert t["grade_trend"] == pytest.approx(30.0)          # last full window: 20, 30, 40


def test_risk_composite_uses_filled_health(spark):
    from cohortlens.fixtures import roster
    from conftest import SF_SMALL
    r = roster(spark, SF_SMALL)
    f = features.advanced_features(r)
    assert f.filter(F.col("health").isNull() | F.col("risk_composite").isNull()).count() == 0


def test_null_never_triggers_a_factor(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, 16)],
                               "student_id long, failures int, absences int, studytime int, goout int, "
                               "Dalc int, Walc int, schoolsup string, famsup string, G3 int")
    r = risk.dashboard(df).first()
    assert r["level"] == "low" and r["factors"] == ["Strong Performance"]


def test_consensus_tie_goes_to_label_first_seen_latest(spark):
    v = spark.createDataFrame(
        [(1, "m1", "High", [0.1, 0.6, 0.2, 0.1], None), (1, "m2", "Low", [0.0, 0.0, 0.0, 0.0], None),
         (1, "m3", None, None, "boom")],
        "student_id long, model string, prediction string, probability array<double>, error string")
    r = risk.consensus(v, model_order=["m1", "m2", "m3"]).first()
    assert r["consensus"] == "Low" and r["confidence"] == pytest.approx(0.6) and r["n_valid"] == 2


def test_mode_fill_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "student_id long, s string")
    assert clean.fill_mode(df).orderBy("student_id").collect()[2]["s"] == "a"


def test_ntz_timestamps_compare_with_ntz_cutoff(spark):
    d = dt.datetime(2024, 1, 30, 23)
    rows = [(1, 1, d, 1.0, 0.9, 0, 0, 0, 0, 0.5, "x"), (2, 1, d - dt.timedelta(days=10), 1.0, 0.1, 0, 0, 0, 0, 0.5, "x")]
    f = activity.activity_features(_events(spark, rows), "2024-01-31 00:00:00", 7).first()
    assert f["recent_attendance"] == pytest.approx(0.9)


def test_stored_scaling_applies_to_present_columns(spark):
    fit_df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 30.0)], "student_id long, x double, y double")
    st = encode.fit_scaling(fit_df)
    new = spark.createDataFrame([(3, 2.0)], "student_id long, x double")     # y absent
    assert encode.apply_scaling(new, st).first()["x"] == pytest.approx(0.0)


def test_default_for_absent_column(spark):
    df = spark.createDataFrame([(1, None)], "student_id long, failures int")
    r = df.select(clean.with_default(df, "failures", 0).alias("f"),
                  clean.with_default(df, "studytime", 2).alias("s")).first()
    assert r["f"] is None and r["s"] == 2


def test_validation_messages(spark):
    df = spark.createDataFrame([(1, 16, "F", "GP"), (2, 0, "", "GP"), (3, 30, "M", "MS")],
                               "student_id long, age int, sex string, school string")   # no address column
    got = {r["student_id"]: r["message"] for r in risk.validate_rows(df).collect()}
    assert got[1] == "Missing required fields: address"
    assert got[2] == "Missing required fields: age, sex, address"
    full = df.withColumn("address", F.lit("U"))
    got = {r["student_id"]: (r["valid"], r["message"]) for r in risk.validate_rows(full).collect()}
    assert got[1] == (True, None) and got[3] == (False, "Age must be between 15 and 22")


def test_numbers_in_text_and_missing_values(spark):
    texts = ["12", " 1e1 ", "12d", "NaN", "", "x", None, "-.5", "inf"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "student_id long, G3 string")
    got = [r["G3"] for r in clean.to_numeric(df, "G3").orderBy("student_id").collect()]
    assert got == [12.0, 10.0, None, None, None, None, None, -0.5, float("inf")]
    listed = {r["student_id"]: r["level"] for r in risk.dashboard(df.filter("student_id < 7")).collect()}
    assert listed == {0: "medium", 1: "medium"}
    assert risk.dashboard_totals(df).first()["total_students"] == 9


def test_nan_is_missing_for_mean_and_median(spark):
    df = _grades(spark, [1.0, 3.0, 8.0, float("nan"), None], "x")
    assert [r["x"] for r in clean.fill_mean(df, ["x"]).orderBy("student_id").collect()] == [1.0, 3.0, 8.0, 4.0, 4.0]
    filled = clean.apply_median_fill(df, clean.fit_median_fill(df, ["x"]))
    assert [r["x"] for r in filled.orderBy("student_id").collect()] == [1.0, 3.0, 8.0, 3.0, 3.0]


def test_rows_without_prediction_are_wrong(spark):
    from cohortlens.operators import metrics
    df = spark.createDataFrame([("m", "a", "a"), ("m", "a", None), ("m", "b", "b")], "model string, y_true string, y_pred string")
    row = metrics.summary_metrics(df).first()
    assert row["accuracy"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)
    assert row["precision"] == pytest.approx(1.0)
    assert metrics.accuracy_percent(df, "y_true", "y_pred").first()["accuracy_pct"] == 66.7
    conf = {(r["true_label"], r["pred_label"]): r["n"] for r in metrics.confusion(df).collect()}
    assert conf == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 0, ("b", "b"): 1, ("a", None): 1}
    report = {r["label"]: r["support"] for r in metrics.classification_report(df).collect()}
    assert report == {"a": 2, "b": 1, "macro avg": 3, "weighted avg": 3}
    missing_truth = df.unionByName(spark.createDataFrame([("m", None, "a")], df.schema))
    assert metrics.summary_metrics(missing_truth).first()["accuracy"] == pytest.approx(2 / 4)


def test_rows_without_class_stay_in_splits(spark):
    from cohortlens.operators import split
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "student_id long, c string")
    assert split.stratified_split(df, "c", "student_id").count() == 20
    folds = split.stratified_folds(df, "c", "student_id", 5).groupBy("c", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {2}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_totals_do_not_depend_on_buckets(spark, descending, by):
    from cohortlens.operators import metrics
    scores = [float(i % 13) / 4 for i in range(13)] + [None, float("nan"), float("inf"), float("-inf")]
    rows = [(g, s, n + 1) for g in ("x", None) for n, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "g string, s double, n long")
    df = df if by else df.filter("g IS NULL").drop("g")
    want = sorted(map(repr, metrics.running_totals(df, "s", ["n"], descending, by=by).collect()))
    for size in (1, 4, 7):
        got = metrics.running_totals(df, "s", ["n"], descending, rows_per_bucket=size, by=by).collect()
        assert sorted(map(repr, got)) == want


def test_engagement_mean_is_exact_in_any_order(spark):
    rows = [(1, i, int(i % 3 == 0), int(i % 5 == 0), int(i % 7 == 0), int(i % 2 == 0)) for i in range(1, 641)]
    df = spark.createDataFrame(rows, "student_id long, event_id long, lms_logins int, page_views int, resource_downloads int, "
                                     "discussion_posts int").withColumn("date", F.lit("2024-01-06").cast("timestamp"))
    want = sum(3 * r[2] + 2 * r[3] + 3 * r[4] + 2 * r[5] for r in rows) / 6400
    for n in (1, 7):
        got = activity.activity_features(df.repartition(n), "2024-01-31", with_trend=False).first()
        assert got["lms_engagement_score"] == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cohortlens import session
    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))


def test_rules_compare_raw_values(spark):
    from cohortlens.operators import explain
    attr = spark.createDataFrame([(1, "High", "goout", 0.3, -0.5), (1, "High", "schoolsup", -0.4, -0.2), (1, "High", "made_up", 7.0, -0.1)],
                                 "id long, class_name string, feature string, value double, shap double")
    roster = spark.createDataFrame([(1, 5, "no"), (2, 1, "yes")], "student_id long, goout int, schoolsup string")
    got = {r["feature"]: r["value"] for r in explain.with_raw_values(attr, roster, "id").collect()}
    assert got == {"goout": 5.0, "schoolsup": 0.0, "made_up": 7.0}


def test_svm_kernels(spark):
    from pyspark.ml.linalg import Vectors

    from cohortlens.plans import models
    rows = [(i, Vectors.dense([i % 2 * 2.0 - 1 + (i % 5) / 10, (i % 7) / 7]), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    with pytest.raises(ValueError):
        models.CalibratedSVM(kernel="cosine", n_features=2).fit(df)
    for gamma in ("scale", "auto", 0.5):
        out = models.CalibratedSVM(kernel="sigmoid", gamma=gamma, n_features=2, dim=8, max_iter=10).fit(df).transform(df)
        assert out.filter("prediction = label").count() >= 36
    assert models.CalibratedSVM(gamma="auto", n_features=4)._gamma(df) == 0.25


def test_a_hot_student_is_cut_into_blocks(spark):
    rng = __import__("random").Random(3)
    rows = [(1 if i % 3 else i % 5, i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00" if i % 50 else None,
             None if i % 11 == 0 else float(rng.randrange(100))) for i in range(600)]
    df = spark.createDataFrame(rows, "student_id long, event_id long, d string, grade double") \
        .select("student_id", "event_id", F.to_timestamp("d").alias("date"), "grade").repartition(4)
    for window in (3, 5):
        want = {tuple(r) for r in activity.rolling_mean(df, window=window).collect()}
        for block in (1, 4, 17, 599):
            cut = activity.rolling_mean(df, window=window, block_rows=block)
            got = cut.collect()
            assert {tuple(r) for r in got} == want and len(got) == 600
    # blocks of at most as many rows and the rows before
    ranked = activity._positions(df, "student_id", "hour")
    assert ranked.groupBy("student_id").agg(F.count("*").alias("n"), F.max("_pos").alias("m"), F.count_distinct("_pos").alias("u")) \
        .filter("n <> m + 1 OR n <> u").count() == 0
