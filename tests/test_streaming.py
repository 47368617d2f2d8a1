"""The streaming activity aggregates equal the batch ones after several micro-batches."""

from pyspark.sql import functions as F

from conftest import SF_ORACLE

from cohortlens import fixtures as fx
from cohortlens.operators.activity import activity_features
from cohortlens.streaming.activity_stream import start_activity_stream


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    ev = fx.table(spark, SF_ORACLE, "events")
    # the given events table, cut into 4 files that arrive one per trigger
    for i in range(4):
        ev.filter(F.col("event_id") % 4 == i).coalesce(1).write.parquet(str(src / f"part{i}"))
    for i in range(4):
        for f in (src / f"part{i}").glob("*.parquet"):
            f.rename(src / f"events_{i}.parquet")
    q, out = start_activity_stream(spark, str(src), "2024-01-31 00:00:00", 7,
                                   file_glob="events_*.parquet", max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 4
    streamed = spark.read.parquet(out)
    batch = activity_features(fx.activity(spark, SF_ORACLE), "2024-01-31 00:00:00", 7, with_trend=False)
    cols = sorted(c for c in batch.columns)
    r = lambda df: df.select(*[F.round(c, 9).alias(c) if c != "student_id" else F.col(c) for c in cols])
    assert streamed.count() == batch.count()
    assert r(streamed).exceptAll(r(batch)).count() == 0
