"""Fitted preparation (E10, E11), exact order statistics by range, dictionary codes, wide one-hot columns."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL

from cohortlens import fixtures as fx
from cohortlens.operators import encode, order_stats
from cohortlens.operators.order_stats import OrderedCounts, dictionary_codes, modes, quantiles, value_counts
from cohortlens.operators.prepare import RosterPreparation, RosterPreparationModel, preprocess
from cohortlens.session import spread


def numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), None if i % 7 == 0 else float(i % 5))
            for i, (a, b) in enumerate(zip(rng.normal(size=900), rng.integers(0, 400, 900)))]
    return spark.createDataFrame(rows + [(None, None, None)] * 3, "a double, b double, c double").repartition(5)


PROBS = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]


def test_quantiles_by_range_equal_percentile(spark):
    df = numbers(spark).withColumn("none", F.lit(None).cast("double"))
    cols = {c: F.col(c) for c in ("a", "b", "c", "none")}
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in PROBS])).alias(c) for c in cols]).first()
    for few in (order_stats.FEW, 10):  # picked from directly, and by range
        got = quantiles(df, cols, PROBS, few)
        for c in ("a", "b", "c"):
            assert got[c] == pytest.approx(want[c], abs=1e-12)
        assert got["none"] == [None] * len(PROBS)


def test_quantiles_of_a_filled_column(spark):
    df = numbers(spark)
    filled = [2.5 if v is None else v for (v,) in df.select("c").collect()]
    for few in (order_stats.FEW, 3):
        with OrderedCounts(value_counts(df, {"c": F.col("c"), "a": F.col("a")}), few) as counts:
            assert counts.missing["c"] == filled.count(2.5)
            got = counts.quantiles({"c": PROBS}, {"c": (2.5, counts.missing["c"])})["c"]
        assert got == pytest.approx(np.quantile(filled, PROBS).tolist(), abs=1e-12)


def test_no_range_holds_all_values(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20_000, 1, 8).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
        with order_stats.Ranged(value_counts(df, {"x": F.col("x")})) as r:
            sizes = [s for _, _, s in r.offsets(F.sum("n"))["x"]]
        assert sum(sizes) == 20_000 and len(sizes) >= 6 and max(sizes) < 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None), (None, None), (None, None)],
                               "x string, y string")
    assert modes(df, {"x": F.col("x"), "y": F.col("y")}) == {"x": "a", "y": None}


def test_codes_of_many_values(spark):
    n = 300_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("wide"),
                               (F.col("id") % 3).cast("string").alias("narrow"))
    mapping = encode.fit_label_codes(df, ["wide", "narrow"])
    want = {v: i for i, v in enumerate(sorted([f"v{i}" for i in range(n)] + ["unknown"]))}
    some = mapping.filter(F.col("column") == "wide").filter(F.xxhash64("value") % 1000 == 0).collect()
    assert len(some) > 100 and all(want[r["value"]] == r["code"] for r in some)
    assert mapping.count() == n + 1 + 4
    new = spark.createDataFrame([("v7", "1"), ("nope", "9"), (None, None)], "wide string, narrow string")
    got = {tuple(r) for r in encode.apply_label_codes(new, mapping, ["wide", "narrow"]).collect()}
    assert got == {(want["v7"], 1), (want["unknown"], 3)}
    few = dictionary_codes(mapping.filter(F.col("column") == "narrow").select("column", "value"))
    assert few.exceptAll(mapping.filter(F.col("column") == "narrow")).count() == 0


def test_wide_columns_become_sparse_vectors(spark, monkeypatch):
    rows = [(i, f"k{i % 7}" if i % 5 else None, "a" if i % 2 else "b", "Low") for i in range(40)]
    df = spark.createDataFrame(rows, "student_id long, many string, two string, risk_level string")
    dense = encode.prepare_features(df).orderBy("student_id").collect()
    monkeypatch.setattr(encode, "MAX_ONE_HOT", 5)
    sparse = encode.prepare_features(df)
    assert "many_onehot" in sparse.columns and "many" not in sparse.columns and "two" in sparse.columns
    for a, b in zip(dense, sparse.orderBy("student_id").collect()):
        assert b["many_onehot"].toArray().tolist() == [float(a[f"many_k{j}"]) for j in range(7)]


def test_saved_preparation_prepares_alike(spark, tmp_path):
    roster = fx.roster(spark, SF_ORACLE)
    model = RosterPreparation().fit(roster)
    want = sorted(map(tuple, model.prepare(roster).collect()))
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p")).stages[0]
    assert isinstance(again, RosterPreparationModel) and again.edges == model.edges
    assert sorted(map(tuple, again.prepare(roster).collect())) == want
    # every row is scored: transform leaves no outlier out, and rows without a grade have no label
    assert model.transform(roster).count() == roster.count() > len(want)
    assert "label" not in model.transform(roster.drop("G3")).columns


def test_new_rows_are_prepared_with_the_fitted_statistics(spark):
    roster = fx.roster(spark, SF_SMALL)
    model = RosterPreparation().fit(roster)
    # whatever else is in the table, one row comes out the same; missing values take the fitted fill
    row = roster.filter("student_id = 5")
    alone = model.transform(row).drop("label").first()
    among = model.transform(roster).filter("student_id = 5").drop("label").first()
    assert alone == among
    holes = row.withColumn("age", F.lit(None).cast("int")).withColumn("Mjob", F.lit("astronaut")).withColumn("absences", F.lit(9999))
    got = model.transform(holes).first()
    assert all(np.isfinite(got[c]) for c in model.features)
    limits = model.state["raw"]["bounds"]["absences"]
    same = model.transform(row.withColumn("absences", F.lit(float(limits[1]))).withColumn("age", F.lit(
        model.state["raw"]["medians"]["age"])).withColumn("Mjob", F.lit(None).cast("string"))).first()
    assert got.asDict() == pytest.approx(same.asDict())


def test_train_fit_looks_at_training_rows_only(spark):
    roster = fx.roster(spark, SF_SMALL).withColumn("split", F.when(F.col("student_id") % 3 == 0, "test").otherwise("train"))
    changed = roster.withColumn("absences", F.when(F.col("split") == "test", 5000).otherwise(F.col("absences"))) \
        .withColumn("Mjob", F.when(F.col("split") == "test", "zzz").otherwise(F.col("Mjob")))
    a, b = (RosterPreparation(fit_on="train").fit(x) for x in (roster, changed))
    assert a.state == b.state and a.mapping.exceptAll(b.mapping).count() == 0
    assert RosterPreparation().fit(roster).state != RosterPreparation().fit(changed).state
    # outliers of the training rows go, rows to be scored stay
    kept = b.prepare(changed)
    assert kept.filter("split = 'test'").count() == changed.filter("split = 'test'").count()
    with pytest.raises(ValueError):
        RosterPreparation(fit_on="some")


def one_split_roster(spark, n):
    spark.range(0, n, 1, 1).selectExpr(
        "id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id * 7919 % 11000 AS DOUBLE) - 1000 AS c_acctbal",
        "CASE WHEN id % 2 = 0 THEN 'BUILDING' ELSE 'FURNITURE' END AS c_mktsegment").createOrReplaceTempView("customer")
    return spark.sql(fx.dialect(fx.ROSTER_SQL, "spark"))


def test_rows_of_one_split_are_spread(spark):
    df = one_split_roster(spark, 12_000).unionAll(one_split_roster(spark, 3)).coalesce(1)
    assert df.rdd.getNumPartitions() == 1
    out = spread(df, "roster")
    sizes = [len(p) for p in out.select("student_id").rdd.glom().collect()]
    assert len(sizes) >= 2 and max(sizes) <= 6_003
    assert out.dtypes == df.dtypes and not out.exceptAll(df).count() and not df.exceptAll(out).count()
    few = df.limit(9_999)
    assert spread(few, "roster") is few


def test_preparation_does_not_run_in_one_task(spark):
    out = preprocess(one_split_roster(spark, 12_000))
    assert out.rdd.getNumPartitions() >= 2
