from conftest import SF_SMALL

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["risk_level", "n_students", "avg_risk_composite", "avg_grade"]


def test_fast_queries_run_on_smallest_data(spark):
    qs = entry.queries()
    for name in ["p10_clean", "j01_activity_features", "v01_summary_metrics", "j06_nearest_neighbors"]:
        assert qs[name](spark, SF_SMALL).count() >= 0
