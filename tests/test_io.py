"""Sources and sinks (S1-S9), schema helpers."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from cohortlens import fixtures as fx
from cohortlens import schema
from cohortlens.sources import io


def test_read_semicolon_csv_with_schema(spark, tmp_path):
    p = tmp_path / "roster.csv"
    cols = list(schema.FEATURE_DESCRIPTIONS)
    vals = ["GP", "F", "18", "U", "GT3", "A", "4", "4", "at_home", "teacher", "course", "mother", "2", "2",
            "0", "yes", "no", "no", "no", "yes", "yes", "no", "no", "4", "3", "4", "1", "1", "3", "6",
            "5", "6", "x"]
    p.write_text(";".join(cols) + "\n" + ";".join(vals) + "\n")
    df = io.read_delimited(spark, str(p), sep=";")
    r = df.first()
    assert r["age"] == 18 and r["Mjob"] == "at_home" and r["G3"] is None   # bad number -> null
    assert schema.dictionary_comments(df)["G3"].startswith("final grade")


def test_load_allow_list(spark, tmp_path):
    with pytest.raises(ValueError):
        io.load(spark, str(tmp_path), "excel")
    df = io.load(spark, f"{SF_SMALL}/region.parquet", "parquet")
    assert df.count() > 0


def test_target_check_and_type_selection(spark):
    r = fx.roster(spark, SF_SMALL)
    with pytest.raises(ValueError):
        schema.require_column(r.drop("G3"), "G3")
    assert "age" in schema.numeric_columns(r) and "sex" in schema.string_columns(r)
    b = r.withColumn("flag", F.lit(True))
    assert "flag" not in schema.numeric_columns(b)


def test_writers(spark, tmp_path):
    r = fx.roster(spark, SF_SMALL).select("student_id", "G3")
    io.write_csv(r, str(tmp_path / "imp"))
    assert spark.read.option("header", True).csv(str(tmp_path / "imp")).count() == r.count()
    io.append_run_metadata(spark, str(tmp_path / "runs"), "dt", {"a": 1}, {"n": 3}, 0.5)
    io.append_run_metadata(spark, str(tmp_path / "runs"), "lr", {"a": 2}, {"n": 3}, None)
    runs = spark.read.json(str(tmp_path / "runs"))
    assert runs.count() == 2 and json.loads(runs.orderBy("model_type").first()["config"]) == {"a": 1}
    pred = r.select(F.col("student_id").alias("id"), F.lit("High").alias("y_pred"),
                    F.array(F.lit(0.1), F.lit(0.9)).alias("probability"))
    io.append_predictions(pred, str(tmp_path / "preds"), "dt")
    back = spark.read.parquet(str(tmp_path / "preds"))
    assert back.filter(F.col("model_name") == "dt").count() == r.count()
    io.write_explanations(spark.createDataFrame([(1, [("x", 1.0, 0.2)])],
                                                "id long, f array<struct<feature:string,value:double,impact:double>>"),
                          str(tmp_path / "expl"))
    assert spark.read.json(str(tmp_path / "expl")).count() == 1


def test_report_writer(spark, tmp_path):
    rep = spark.createDataFrame([("dt", "test", "accuracy", 0.5, 1.0)],
                                "model string, split string, metric string, value double, training_time double")
    io.write_report(rep, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).first()["value"] == 0.5


def test_columns_are_matched_by_header(spark, tmp_path):
    p = tmp_path / "roster.csv"
    p.write_text("sex;note;school; age ;G3\nF;hello;GP;18;12\nM;;MS;x;9d\n")
    rows = io.read_delimited(spark, str(p), sep=";").collect()
    assert [(r["school"], r["sex"], r["age"], r["G3"], r["note"]) for r in rows] == [("GP", "F", 18, 12, "hello"), ("MS", "M", None, None, None)]
    assert rows[0]["Medu"] is None


def test_a_model_that_fails_at_run_time_is_a_row(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    small = spark.createDataFrame([(Vectors.dense([0.0, 1.0]), 0.0), (Vectors.dense([1.0, 0.0]), 1.0)], ["features", "label"])
    model = PipelineModel([LogisticRegression(maxIter=2).fit(small)])
    io.save_model(model, str(tmp_path / "lr"))
    wide = spark.createDataFrame([(1, Vectors.dense([0.0, 1.0, 2.0]), "a")], ["id", "features", "class_name"])
    got = io.batch_score(spark, wide, {"lr": str(tmp_path / "lr"), "gone": str(tmp_path / "none")}, ["a", "b"]).collect()
    assert {r["model"] for r in got} == {"lr", "gone"} and all(r["error"] for r in got)
    ok = wide.select("id", F.lit(None).alias("x"), "class_name").drop("x").join(
        spark.createDataFrame([(1, Vectors.dense([0.0, 1.0]))], ["id", "features"]), "id")
    assert io.batch_score(spark, ok, {"lr": str(tmp_path / "lr")}, ["a", "b"]).first()["error"] is None
