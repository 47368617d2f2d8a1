"""Invariants for splits, kNN, ROC/AUC, models, Shapley sampling, model I/O."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL

from cohortlens import fixtures as fx
from cohortlens.operators import knn, metrics, split
from cohortlens.plans import models as ml
from cohortlens.plans import shapley as sh


@pytest.fixture(scope="module")
def data(spark):
    return ml.prepare_training_data(spark, SF_ORACLE)


def test_stratified_split_keeps_class_shares(spark):
    r = fx.roster(spark, SF_ORACLE).select("student_id", (F.col("student_id") % 4).alias("c"))
    s = split.stratified_split(r, "c", "student_id")
    counts = {(x["c"], x["split"]): x["n"] for x in s.groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    for c in range(4):
        n = sum(v for (cc, _), v in counts.items() if cc == c)
        assert abs(counts[(c, "train")] - 0.7 * n) <= 1
        assert abs(counts[(c, "test")] - 0.2 * n) <= 1


def test_exact_rank_equals_global_row_number(spark):
    from pyspark.sql import Window
    r = fx.roster(spark, SF_ORACLE).select("student_id", (F.col("student_id") % 3).alias("c"))
    a = split.stratified_rank(r, "c", "student_id", hex_digits=2)
    w = Window.partitionBy("c").orderBy(split.hash_key("student_id", 42), "student_id")
    b = r.withColumn("rb", F.row_number().over(w) - 1)
    j = a.join(b, ["student_id", "c"])
    assert j.filter(F.col("_rank") != F.col("rb")).count() == 0


def slow_neighbors(rows, k, metric, p):
    out = set()
    for i, x in rows:
        d = [(float((np.abs(np.asarray(x) - np.asarray(y)) ** p).sum() ** (1 / p)) if metric == "minkowski" else
              float(np.abs(np.asarray(x) - np.asarray(y)).sum()) if metric == "manhattan" else
              float(np.sqrt(((np.asarray(x) - np.asarray(y)) ** 2).sum())), j) for j, y in rows if j != i]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 2.0), ("minkowski", 3.0)])
def test_pruned_neighbors_are_all_neighbors(spark, metric, p):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 9, (7, 4))
    rows = [(i, (centres[i % 7] + rng.normal(0, 0.5, 4)).tolist()) for i in range(420)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one point many times: ties
    v = spark.createDataFrame([(i, x, i % 3) for i, x in rows], "vec_id long, embedding array<double>, label int").repartition(4)
    want = slow_neighbors(rows, 4, metric, p)
    for kw in ({"cell_rows": 20, "small_values": 0}, {"cell_rows": 50, "block_rows": 16, "small_values": 0}, {}):
        got = knn.nearest_neighbors(v, v, 4, metric=metric, p=p, **kw)
        assert {(r["query_id"], r["rank"], r["neighbor_id"]) for r in got.collect()} == want


def test_cells_that_cannot_hold_a_neighbor_never_meet(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 50, (12, 3))
    c = spark.createDataFrame([(i, (centres[i % 12] + rng.normal(0, 0.3, 3)).tolist(), 0) for i in range(1200)],
                              "cid long, cvec array<double>, clabel int")
    q = c.select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"))
    met, dealt, cells = knn.meeting_cells(q, c, 6, "euclidean", 2.0, 25)
    assert dealt.count() == 1200 and cells == 48
    assert met.count() < 1200 * 14  # of 48 cells: those of its own centre, about 4, and few more


def test_queries_travel_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 16).tolist(), 0) for i in range(600)]  # no structure: every query meets every cell
    c = spark.createDataFrame(rows, "cid long, cvec array<double>, clabel int")
    q = c.select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"))
    met, dealt, cells = knn.meeting_cells(q, c, 6, "euclidean", 2.0, 25)
    assert cells == 24 and met.count() == 600 and dealt.count() == 600


def test_tiles_of_far_cells_are_not_read(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 50, (12, 3))
    x = np.concatenate([c + rng.normal(0, 0.3, (100, 3)) for c in centres])
    far = np.sqrt(((x - np.repeat(centres, 100, axis=0)) ** 2).sum(axis=1))
    cells = pd.DataFrame({"cell": range(12), "radius": far.reshape(12, 100).max(axis=1)})
    read = []

    def tiles(folder, cell, rows):
        read.append(cell)
        s = slice(100 * cell, 100 * cell + 100)
        yield np.arange(1200)[s], np.zeros(100), x[s], far[s]

    monkeypatch.setattr(knn, "_cell_tiles", tiles)
    run = knn._group_search("", centres, cells, 5, "euclidean", 2.0, True, 64)
    out = pd.concat(run(iter([pd.DataFrame({"qid": np.arange(300, 400), "qvec": list(x[300:400])})])))
    assert read == [3] and len(out) == 500


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski"])
@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e8, 1e35, 1e200])
def test_screened_tiles_lose_no_neighbor(metric, scale):
    rng = np.random.default_rng(7)
    x = (rng.normal(0, 1, (300, 5)) + 40) * scale
    x[100:140] = x[7]                      # equal distances: smaller id first
    ids = rng.permutation(300)
    ids[250:260] = ids[:10]                # ids that repeat are the query's own rows
    found = knn._Nearest(ids, x, 4, metric, 3.0, True)
    for s in range(0, 300, 37):
        found.meet(np.arange(300), ids[s:s + 37], np.full(len(ids[s:s + 37]), np.nan), x[s:s + 37])
    got = found.table()
    assert got["neighbor_label"].isna().all() and len(got) == 1200
    with np.errstate(all="ignore"):
        d = knn._distances(x, x, metric, 3.0)
    d[ids[:, None] == ids[None, :]] = np.nan
    want = np.concatenate([ids[np.lexsort((ids, d[i]))[:4]] for i in range(300)])
    assert got["neighbor_id"].tolist() == want.tolist()


def test_knn_model_is_a_model(spark, data, tmp_path):
    from cohortlens.sources.io import batch_score, load_model, save_model
    train = data.df.filter("split = 'train'")
    for params in ({}, {"weights": "distance", "metric": "manhattan", "n_neighbors": 3}):
        m = ml.create_model("knn", len(data.feature_names), n_classes=4, **params).fit(train)
        pred = ml.predictions(m, data.df)
        assert pred.count() == data.df.count()
        assert pred.filter("abs(aggregate(probability, 0D, (a, x) -> a + x) - 1) > 1e-9 OR size(probability) <> 4").count() == 0
    own = pred.filter("split = 'train'")  # by distance a training row is its own nearest
    assert own.filter("y_true <> y_pred").count() <= 0.02 * own.count()
    save_model(m, str(tmp_path / "knn"))
    m2, _ = load_model(str(tmp_path / "knn"))
    a, b = ({tuple(r) for r in ml.predictions(x, data.df).select("id", "y_pred").collect()} for x in (m, m2))
    assert a == b
    scored = batch_score(spark, data.df, {"KNN": str(tmp_path / "knn")}, data.classes)
    assert scored.filter("error IS NULL").count() == data.df.count()


def test_stored_folds_give_the_report(spark):
    d = ml.prepare_training_data(spark, SF_SMALL)
    held = ml.out_of_fold("dt", d, 5)
    train = d.df.filter("split = 'train'")
    assert held.count() == train.count() and held.join(train.select("id", "fold"), ["id", "fold"]).count() == train.count()
    r = ml.train_single_model("decision_tree", d, do_tune=False)
    cv = {x["metric"]: x["value"] for x in r["metrics"].filter("split = 'cv'").collect()}
    per_fold = [x["a"] for x in r["out_of_fold"].groupBy("fold").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a")).collect()]
    assert cv["accuracy"] == pytest.approx(np.mean(per_fold)) and cv["accuracy_std"] == pytest.approx(np.std(per_fold))
    with_cv = ml.RiskModel("dt")
    assert with_cv.train(d).filter("split = 'cv'").count() == 5


def test_auc_matches_spark_evaluator(spark):
    s = fx.view(spark, SF_ORACLE, "scores")
    ours = metrics.auc(s).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="yd", metricName="areaUnderROC")
    theirs = ev.evaluate(s.withColumn("yd", F.col("y").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_running_totals_multi_bucket(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).cast("double").alias("s"), F.lit(1).alias("one"))
    rt = metrics.running_totals(df, "s", ["one"], descending=True, rows_per_bucket=300)
    bad = rt.filter(F.col("cum_one") != (5000 - F.col("s"))).count()
    assert bad == 0


def test_model_registry():
    assert "decision_tree" in ml.available_models()
    assert ml.model_params("dt")["max_depth"] == 5
    with pytest.raises(ValueError):
        ml.create_model("nope", 3)


def test_probabilities_sum_to_one(spark, data):
    train = data.df.filter(F.col("split") == "train")
    for name in ("gradient_boosting", "svm", "logistic_regression"):
        m = ml.create_model(name, len(data.feature_names), n_rows=train.count()).fit(train)
        p = ml.predictions(m, data.df)
        s = p.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert s.filter(F.abs(F.col("s") - 1) > 1e-6).count() == 0


def test_shapley_additivity(spark, data):
    train = data.df.filter(F.col("split") == "train")
    model = ml.create_model("logistic_regression", len(data.feature_names), n_rows=train.count()).fit(train)
    attr = sh.shapley_values(model, data.df, data.feature_names, data.classes,
                             n_explain=5, n_background=10, n_perm=2)
    tot = attr.groupBy("id", "class_name").agg(F.sum("shap").alias("phi"))
    base = sh.base_values(model, data.df, data.classes, n_background=10)
    from pyspark.ml.functions import vector_to_array
    cls = F.array(*[F.lit(c) for c in data.classes])
    fx_ = (model.transform(data.df.join(attr.select("id").distinct(), "id"))
           .select("id", F.posexplode(vector_to_array("probability")).alias("k", "p"))
           .select("id", F.element_at(cls, F.col("k") + 1).alias("class_name"), "p"))
    j = tot.join(base, "class_name").join(fx_, ["id", "class_name"])
    assert j.count() == 5 * len(data.classes)
    assert j.filter(F.abs(F.col("phi") - (F.col("p") - F.col("base_value"))) > 1e-9).count() == 0


def test_save_load_and_batch_scoring(spark, data, tmp_path):
    from cohortlens.sources.io import batch_score, load_model, save_model
    train = data.df.filter(F.col("split") == "train")
    m = ml.create_model("decision_tree", len(data.feature_names)).fit(train)
    save_model(m, str(tmp_path / "dt"), info={"accuracy": 0.5})
    m2, meta = load_model(str(tmp_path / "dt"))
    assert meta["accuracy"] == 0.5
    a = ml.predictions(m, data.df).select("id", "y_pred")
    b = ml.predictions(m2, data.df).select("id", "y_pred")
    assert a.exceptAll(b).count() == 0
    out = batch_score(spark, data.df, {"DT": str(tmp_path / "dt"), "gone": str(tmp_path / "none")}, data.classes)
    assert out.filter(F.col("error").isNotNull()).count() == 1
    assert out.filter(F.col("model") == "DT").count() == data.df.count()


def test_ensemble_and_cv(spark, data):
    from cohortlens.operators.metrics import summary_metrics
    train = data.df.filter(F.col("split") == "train")
    preds = [ml.predictions(ml.create_model(n, len(data.feature_names), n_rows=train.count()).fit(train), data.df)
             for n in ("decision_tree", "logistic_regression")]
    e = ml.soft_vote(preds)
    assert e.count() == data.df.count()
    acc = summary_metrics(e, by=["split"]).collect()
    assert all(0 <= r["accuracy"] <= 1 for r in acc)


def test_tree_rules_text(spark, data):
    train = data.df.filter(F.col("split") == "train")
    m = ml.create_model("decision_tree", len(data.feature_names)).fit(train)
    txt = ml.tree_rules(m, data.feature_names)
    assert "If (" in txt and "feature 0 " not in txt
    leaves = ml.tree_leaves(m, data.df, data.feature_names).collect()
    assert sum(r["support"] for r in leaves) == data.df.count() and len(leaves) > 3
    # a leaf's rule, taken as a filter over the named features, finds its rows and no others
    from pyspark.ml.functions import vector_to_array
    wide = data.df.select("class_name", vector_to_array("features").alias("x")).select(
        "class_name", *[F.col("x")[i].alias(c) for i, c in enumerate(data.feature_names)])
    counts = wide.agg(*[F.count_if(F.expr(r["rule"])).alias(f"n{r['leaf']}") for r in leaves],
                      *[F.count_if(F.expr(r["rule"]) & (F.col("class_name") == "High")).alias(f"h{r['leaf']}") for r in leaves]).first()
    assert all(counts[f"n{r['leaf']}"] == r["support"] and counts[f"h{r['leaf']}"] == r["n_High"] for r in leaves)


def test_small_sf_training_data(spark):
    d = ml.prepare_training_data(spark, SF_SMALL)
    assert d.df.count() > 0 and len(d.feature_names) == 46


def test_model_contract_requires_training(spark, data):
    m = ml.RiskModel("dt")
    with pytest.raises(ValueError):
        m.predict(data.df)
    m.train(data)
    assert m.info()["is_trained"]
    p = m.predict_proba(data.df)
    assert p.count() == data.df.count()


def test_balanced_weights(spark, data):
    w = data.df.filter(F.col("split") == "train").groupBy("class_name").agg(
        F.count("*").alias("n"), F.first("weight").alias("w")).collect()
    n = sum(r["n"] for r in w)
    for r in w:
        assert r["w"] == pytest.approx(n / (len(w) * r["n"]))


def test_folds_from_split_rank_equal_separate_ranking(spark):
    r = fx.roster(spark, SF_ORACLE).select("student_id", (F.col("student_id") % 4).alias("c"))
    a = split.stratified_split(r, "c", "student_id", k_folds=5).filter(F.col("split") == "train")
    b = split.stratified_folds(a.drop("fold", "split"), "c", "student_id", 5)
    j = a.select("student_id", F.col("fold").alias("fa")).join(b.select("student_id", "fold"), "student_id")
    assert j.count() == a.count() and j.filter(F.col("fa") != F.col("fold")).count() == 0


def test_custom_pipelines_save_and_reload(spark, data, tmp_path):
    from cohortlens.sources.io import load_model, save_model
    train = data.df.filter(F.col("split") == "train")
    for name in ("gradient_boosting", "svm"):
        m = ml.create_model(name, len(data.feature_names), n_rows=train.count()).fit(train)
        save_model(m, str(tmp_path / name))
        m2, _ = load_model(str(tmp_path / name))
        a = ml.predictions(m, data.df).select("id", "y_pred", F.round(F.array_max("probability"), 9).alias("p"))
        b = ml.predictions(m2, data.df).select("id", "y_pred", F.round(F.array_max("probability"), 9).alias("p"))
        assert a.exceptAll(b).count() == 0


def test_running_totals_grouped_multi_bucket(spark):
    df = spark.range(0, 6000).select((F.col("id") % 3).alias("g"),
                                     (F.col("id") / 3).cast("long").cast("double").alias("s"),
                                     F.lit(1).alias("one"))
    rt = metrics.running_totals(df, "s", ["one"], descending=True, rows_per_bucket=500, by=["g"])
    assert rt.filter(F.col("cum_one") != (2000 - F.col("s"))).count() == 0


def test_per_class_auc_matches_evaluator(spark):
    s = fx.view(spark, SF_ORACLE, "scores").withColumn("g", F.lit("a"))
    ours = metrics.auc(s, by=["g"]).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="yd", metricName="areaUnderROC")
    assert ours == pytest.approx(ev.evaluate(s.withColumn("yd", F.col("y").cast("double"))), abs=1e-9)


def test_grouped_roc_points_equal_ungrouped(spark):
    s = fx.view(spark, SF_ORACLE, "scores")
    a = metrics.roc_points(s).select("threshold", F.round("fpr", 9).alias("f"), F.round("tpr", 9).alias("t"))
    b = metrics.roc_points(s.withColumn("g", F.lit(1)), by=["g"]).select(
        "threshold", F.round("fpr", 9).alias("f"), F.round("tpr", 9).alias("t"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_wrapped_estimators_tune_with_cross_validator(spark):
    d = ml.prepare_training_data(spark, SF_SMALL)
    for name, grid in (("gradient_boosting", {"maxIter": [3, 5]}), ("svm", {"C": [0.5, 1.0]})):
        model, scores = ml.tune(name, d, grid=grid)
        assert len(scores) == 2 and all(0 <= s <= 1 for _, s in scores)
        assert ml.predictions(model, d.df).count() == d.df.count()


def test_attributions_of_every_model_add_up(spark):
    """X11 with all six models, really run; the waterfall ends at the model's own output."""
    from pyspark.ml.functions import vector_to_array

    from cohortlens.plans import q_models

    d = q_models.training_data(spark, SF_SMALL)
    models = {m: q_models._fitted(spark, SF_SMALL, m) for m in q_models.ALL_MODELS}
    attr = sh.attribute_models(models, d.df, d.feature_names, d.classes, n_explain=4, n_background=6, n_perm=1)
    assert attr.filter("error IS NOT NULL").count() == 0
    assert {r["model"]: r["n"] for r in attr.groupBy("model").agg(F.count("*").alias("n")).collect()} == {
        m: 4 * len(d.classes) * len(d.feature_names) for m in models}
    for name, model in models.items():
        own = attr.filter(F.col("model") == name).drop("model", "error")
        bars = sh.waterfall(own, sh.base_values(model, d.df, d.classes, n_background=6), 5).collect()
        end = {(r["id"], r["class_name"]): r["end"] for r in bars if r["position"] == 6}
        ids = d.df.join(own.select("id").distinct(), "id", "left_semi")
        for r in model.transform(ids).select("id", vector_to_array("probability").alias("p")).collect():
            assert [end[r["id"], c] for c in d.classes] == pytest.approx(r["p"], abs=1e-9)


def test_one_feature_needs_no_hybrids(spark, data):
    from pyspark.ml.feature import VectorSlicer

    one = VectorSlicer(inputCol="features", outputCol="f", indices=[0]).transform(data.df).drop("features") \
        .withColumnRenamed("f", "features")
    model = ml.create_model("logistic_regression", 1, n_rows=100).fit(one.filter("split = 'train'"))
    attr = sh.shapley_values(model, one, data.feature_names[:1], data.classes, n_explain=3, n_background=4, n_perm=2)
    assert attr.count() == 3 * len(data.classes)
    total = attr.groupBy("id").agg(F.sum("shap").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-9 for r in total)  # the classes' contributions cancel out


def test_svm_solver_has_no_more_tasks_than_its_rows_need(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(i % 7), float(i % 5)], float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double") \
        .select("id", array_to_vector("x").alias("features"), "label").repartition(8)
    fit, parts, found = ml.OneVsRest.fit, [], []
    monkeypatch.setattr(ml.OneVsRest, "fit", lambda self, d: (parts.append(d.rdd.getNumPartitions()), fit(self, d))[1])
    for most in (ml.SOLVER_ROWS, 100, 1):  # 1, 3 and all 8 tasks
        monkeypatch.setattr(ml, "SOLVER_ROWS", most)
        model = ml.CalibratedSVM(kernel="rbf", n_features=2, dim=4, max_iter=10).fit(df)
        found.append({r["id"]: r["p"] for r in model.transform(df).selectExpr("id", "probability AS p").collect()})
    assert parts == [1, 3, 8]
    for other in found[1:]:
        assert all(other[i].toArray() == pytest.approx(p.toArray(), abs=1e-6) for i, p in found[0].items())


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e12])
def test_marked_screen_is_never_more_than_the_distance_and_leaves_few(scale, monkeypatch):
    rng = np.random.default_rng(3)
    q, tiles = rng.normal(0, scale, (300, 32)), rng.normal(0, scale, (12, 400, 32))
    q[:3], tiles[5, :40], tiles[6, 7] = 0, tiles[4, 0], q[9]
    tiles[8, 3] = q[5] + np.where(np.arange(32) == 2, 50 * scale, 0)
    found, checked = knn._Nearest(np.arange(300), q, 4, "manhattan", 2.0, False), []
    lengths = knn._lengths
    monkeypatch.setattr(knn, "_lengths", lambda diff, *a: checked.append(diff.shape[0]) or lengths(diff, *a))
    for t, c in enumerate(tiles):
        found.meet(np.arange(300), np.arange(400 * t, 400 * t + 400), np.zeros(400), c)
        screened = found._marked(c)[1](np.arange(300))
        assert (screened <= knn._distances(q, c, "manhattan", 2.0) + 1e-4 * scale).all()
    got = {(r.query_id, r.neighbor_id): r.distance for r in found.table().itertuples()}
    every = lengths(q[:, None] - tiles.reshape(1, -1, 32), "manhattan", 2.0)
    want = {(i, int(j)): every[i, j] for i in range(300) for j in np.lexsort((np.arange(4800), every[i]))[:4]}
    assert got == want
    assert sum(checked) < 0.05 * every.size


def test_tree_grid_is_whole_and_its_scores_are_those_of_separate_fits(spark, data):
    grid = ml.GRIDS["decision_tree"]
    assert np.prod([len(v) for v in grid.values()]) == 160
    small = {"maxDepth": [2, 30], "minSamplesSplit": [2, 120], "minInstancesPerNode": [5, 30], "impurity": ["entropy"]}
    model, scores = ml.tune("decision_tree", data, grid=small)
    assert len(scores) == 8 and len({s for _, s in scores}) > 2
    train = data.df.filter("split = 'train'")
    for p, score in scores[1::2]:
        settings = {ml._SETTINGS[k]: v for k, v in p.items()}
        parts = []
        for fold in range(5):
            one = ml.create_model("decision_tree", len(data.feature_names), **settings).fit(train.filter(F.col("fold") != fold))
            got = one.transform(train.filter(F.col("fold") == fold))
            parts.append(got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert abs(np.mean(parts) - score) < 1e-9
    assert model.numNodes >= 1


def test_nodes_of_too_few_rows_are_not_split(spark, data, tmp_path):
    train = data.df.filter("split = 'train'")
    sizes = {}
    for least in (10, 100):
        model = ml.create_model("decision_tree", len(data.feature_names), max_depth=30, min_samples_leaf=5, min_samples_split=least).fit(train)
        model.write().save(f"{tmp_path}/{least}")
        nodes = spark.read.parquet(f"{tmp_path}/{least}/data").toPandas().sort_values("id")
        assert (nodes["rawCount"][nodes["leftChild"] >= 0] >= least).all()
        sizes[least] = len(nodes)
        assert len(nodes) == model.numNodes
        assert ml.predictions(model, train).filter("y_pred IS NULL").count() == 0
    assert sizes[100] < sizes[10]


def test_grid_search_query_gives_every_point(spark):
    from cohortlens.plans.catalog import QUERIES
    got = QUERIES["m03_grid_search"](spark, SF_SMALL).collect()
    assert len(got) == len({r["params"] for r in got}) == 160
    assert all(0 < r["cv_accuracy"] < 1 for r in got)
