"""The three end-to-end flows write their tables (small settings)."""

from conftest import SF_SMALL

from cohortlens.plans import workflows as wf


def test_flows(spark, tmp_path):
    out = str(tmp_path)
    s = wf.train_and_explain(spark, SF_SMALL, f"{out}/train", models=("decision_tree", "logistic_regression"),
                             n_explain=5, n_background=5, n_perm=1)
    assert s["best_model"] in ("decision_tree", "logistic_regression")
    for sub in ("report", "attributions", "explanations", "predictions", "shap_importance", "runs"):
        assert spark.read.format("json" if sub in ("explanations", "runs") else
                                 "csv" if sub == "shap_importance" else "parquet").load(f"{out}/train/{sub}").count() > 0
    t = wf.dashboard_tables(spark, SF_SMALL, f"{out}/dash")
    assert t["total_students"] == t["high_risk_count"] + t["medium_risk_count"] + t["low_risk_count"]
    v = wf.validate_saved_models(spark, SF_SMALL, {"DT": f"{out}/train/models/decision_tree",
                                                   "missing": f"{out}/nope"}, f"{out}/val", f"{out}/train/preparation")
    rows = {r["model"]: r for r in v.collect()}
    assert rows["missing"]["error"] and rows["DT"]["accuracy_pct"] is not None


def test_flows_on_a_file_with_shuffled_columns(spark, tmp_path):
    from cohortlens import fixtures as fx

    roster = fx.roster(spark, SF_SMALL).drop("student_id").toPandas()
    plain, shuffled, out = str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path)
    roster.to_csv(plain, sep=";", index=False)
    roster[roster.columns[::-1]].sample(frac=1, random_state=1).to_csv(shuffled, sep=";", index=False)
    a, b = wf.roster_of(spark, plain, ";"), wf.roster_of(spark, shuffled, ";")
    cols = sorted(a.columns)
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and a.count() == b.count() == len(roster)
    assert a.select("student_id").distinct().count() == len(roster)
    s = wf.train_and_explain(spark, plain, f"{out}/t", models=("decision_tree",), n_explain=4, n_background=4, n_perm=1,
                             sep=";", fit_on="train")
    assert s["best_model"] == "decision_tree"
    p = spark.read.parquet(f"{out}/t/predictions")
    assert {"factors", "explanation", "intervention_recommendations"} <= set(p.columns)
    assert p.filter("explanation IS NOT NULL AND size(intervention_recommendations) > 0").count() == 4
    # the same statistics whatever the order of columns and rows: equal scores from the saved preparation
    found = [{tuple(r) for r in wf.validate_saved_models(spark, path, {"DT": f"{out}/t/models/decision_tree"}, f"{out}/v{i}",
                                                         f"{out}/t/preparation", ";").collect()}
             for i, path in enumerate((plain, shuffled))]
    assert found[0] == found[1] and len(found[0]) == 1
    assert wf.dashboard_tables(spark, shuffled, f"{out}/d", ";") == wf.dashboard_tables(spark, plain, f"{out}/d2", ";")
