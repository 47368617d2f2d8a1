"""Incremental per-learner activity features with Structured Streaming.

The same aggregates as the batch job (A1-A10; ``activity_features``) kept up
to date while event files arrive: a file-source stream over the event table,
the activity projection, then one stateful ``groupBy(student)`` aggregation.
State is one aggregation buffer per student (bounded by the number of
students, not events). Output mode is ``complete``; each micro-batch result
is written by ``foreachBatch`` as a parquet table in the shared checkpoint
folder (overwrite per batch), so readers always see a whole, consistent table.
The grade trend (W2) needs per-student event order and is batch only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.fixtures import ACTIVITY_EXPRS
from cohortlens.operators.activity import activity_features
from cohortlens.session import checkpoint_dir

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def _activity_projection(events: DataFrame) -> DataFrame:
    """The activity view (same expressions as the batch fixture) over a stream."""
    return events.selectExpr(*ACTIVITY_EXPRS)


def start_activity_stream(spark: SparkSession, source_dir: str, as_of, days: int = 30,
                          file_glob: str = "events*.parquet", out_dir: str | None = None,
                          available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns (StreamingQuery, output path)."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    out = out_dir or f"{base}/table"
    reader = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source_dir)
    feats = activity_features(_activity_projection(events), as_of, days, with_trend=False)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    w = (feats.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(), out


def run_activity_stream(spark: SparkSession, source_dir: str, as_of, days: int = 30,
                        file_glob: str = "events*.parquet") -> DataFrame:
    """Process every available event file, then return the resulting table."""
    q, out = start_activity_stream(spark, source_dir, as_of, days, file_glob)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)
