"""Student to its 1:N record tables.

Each child table is aggregated to one row per student BEFORE joining, so the
joins are 1:1 on the integer foreign key (no N x M fan-out), and every
aggregate is a partial (map-side) aggregation. The lineitem -> orders hop is
the only join of two large tables; it is an equi-join on the order key that
Spark plans as a shuffle (sort-merge) join, or broadcast when AQE sees a
small side at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def student_records_summary(students: DataFrame, records: DataFrame, submissions: DataFrame,
                            events: DataFrame) -> DataFrame:
    """Per student: academic records (orders), submissions (lineitem via its
    order), activity events; students without children get 0 counts."""
    rec = (records.groupBy(F.col("o_custkey").alias("student_id"))
           .agg(F.count(F.lit(1)).alias("n_records"), F.avg("o_totalprice").alias("avg_record_value")))
    # pre-aggregate submissions per record key first: the join then sees one
    # row per record (not per submission), so a hot record cannot skew it
    per_record = (submissions.groupBy("l_orderkey")
                  .agg(F.count(F.lit(1)).alias("_n"),
                       F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_r")))
    sub = (per_record.join(records.select("o_orderkey", "o_custkey"),
                           F.col("l_orderkey") == F.col("o_orderkey"))
           .groupBy(F.col("o_custkey").alias("student_id"))
           .agg(F.sum("_n").alias("n_submissions"), F.sum("_r").alias("_returned"))
           .select("student_id", "n_submissions",
                   (F.col("_returned") / F.col("n_submissions")).alias("returned_share")))
    ev = events.groupBy(F.col("user_id").alias("student_id")).agg(F.count(F.lit(1)).alias("n_events"))
    base = students.select(F.col("c_custkey").alias("student_id"))
    out = base.join(rec, "student_id", "left").join(sub, "student_id", "left").join(ev, "student_id", "left")
    return out.select("student_id", F.coalesce("n_records", F.lit(0)).alias("n_records"),
                      "avg_record_value", F.coalesce("n_submissions", F.lit(0)).alias("n_submissions"),
                      "returned_share", F.coalesce("n_events", F.lit(0)).alias("n_events"))
