"""Per-learner activity features over an event table.

All scalar features come from ONE ``groupBy(student).agg(...)`` with
conditional aggregates (partial aggregation map-side, so a student holding a
third of all events is pre-combined in every map task, not sent whole to one
reducer). Ratios of two per-student series (J2) are conditional sums that
are null when a side has no qualifying row, which reproduces index alignment.

The grade trend (W2) needs the last three events per student in time order.
``row_number() <= 3`` is planned by Spark as a WindowGroupLimit that keeps
at most three rows per student per map task before the shuffle, so hot
students stay cheap. Only students whose last three rows hold a null grade
need the full rolling window (W1), and only those rows are windowed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.features import engagement_tenths, weekend_flag
from cohortlens.session import written

ORDER = ("date", "event_id")


def _ts_lit(ts) -> Column:
    if isinstance(ts, str):
        ts = _dt.datetime.fromisoformat(ts)
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _order_cols(df: DataFrame):
    return [c for c in ORDER if c in df.columns]


#: events of a student up to which they are sorted as one group, and rows of a block beyond
BLOCK_ROWS = 200_000


def _positions(df: DataFrame, id_col: str, unit: str) -> DataFrame:
    """``df`` with ``_pos``, each row's place (from 0) among its student's rows in time order.

    Rows are ranked inside one (student, ``unit`` of time); the offset of a unit
    comes from the table of their counts, so no task sorts a whole student."""
    order = _order_cols(df)
    cut = df.withColumn("_unit", F.date_trunc(unit, F.col(order[0])))
    counts = cut.groupBy(id_col, "_unit").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(id_col).orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(F.col(id_col).alias("_id"), F.col("_unit").alias("_u"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(id_col, "_unit").orderBy(*order)) - 1
    ranked = cut.withColumn("_place", place)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_unit").eqNullSafe(F.col("_u"))
    return ranked.join(starts, same).withColumn("_pos", F.col("_before") + F.col("_place")).drop(
        "_unit", "_place", "_id", "_u", "_before")


def rolling_mean(df: DataFrame, value: str = "grade", window: int = 3, id_col: str = "student_id",
                 block_rows: int = BLOCK_ROWS, unit: str = "hour") -> DataFrame:
    """Mean of the last ``window`` rows per student in time order, null
    unless all ``window`` values are present (``rolling(window).mean()``).

    Where a student has more than ``block_rows`` events, every student's rows are
    cut into blocks of that many consecutive ones and each block gets a copy of
    the ``window - 1`` rows before it, so a hot student is many tasks."""
    out, order = f"rolling_{value}", _order_cols(df)

    def rolled(d: DataFrame, w) -> DataFrame:
        return d.withColumn(out, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))

    most = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= block_rows or not order or dict(df.dtypes)[order[0]] not in ("timestamp", "timestamp_ntz", "date"):
        return rolled(df, Window.partitionBy(id_col).orderBy(*order).rowsBetween(-(window - 1), Window.currentRow))
    size = max(block_rows, window)
    block = F.floor(F.col("_pos") / size)
    # the last rows of a full block are also the head start of the next one
    blocks = F.when(F.col("_pos") % size >= size - (window - 1), F.array(block, block + 1)).otherwise(F.array(block))
    dealt = _positions(df, id_col, unit).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(id_col, "_block").orderBy("_pos").rowsBetween(-(window - 1), Window.currentRow)
    return rolled(dealt, w).filter(F.col("_block") == block).drop("_pos", "_block")


def grade_trend(df: DataFrame, value: str = "grade", window: int = 3,
                id_col: str = "student_id") -> DataFrame:
    """Last non-null rolling mean per student (columns: id, grade_trend).

    One pass keeps the last ``window`` rows per student (WindowGroupLimit)
    and averages them when all are present. The result, a row a student, is
    written once: it is read again to find the rare students whose last rows
    hold a null grade, and only for those (if any) the rolling window runs on
    their events alone."""
    order = _order_cols(df)
    w_desc = Window.partitionBy(id_col).orderBy(*[F.desc(c) for c in order])
    last = (df.select(id_col, value, *order)
            .withColumn("_rn", F.row_number().over(w_desc))
            .filter(F.col("_rn") <= window))
    n, nn = F.count(F.lit(1)), F.count(value)
    tail = written(last.groupBy(id_col).agg(F.when((n == window) & (nn == window), F.avg(value)).alias("grade_trend"),
                                            ((n == window) & (nn < window)).alias("_slow")), "grade-trend")
    slow_ids = tail.filter("_slow").select(id_col)
    if slow_ids.isEmpty():
        return tail.select(id_col, "grade_trend")
    slow_rows = df.select(id_col, value, *order).join(slow_ids, id_col, "left_semi")
    rolled = rolling_mean(slow_rows, value, window, id_col)
    slow = (rolled.filter(F.col(f"rolling_{value}").isNotNull())
            .groupBy(id_col)
            .agg(F.max_by(f"rolling_{value}", F.struct(*order)).alias("_slow_trend")))
    return (tail.join(slow, id_col, "left")
            .select(id_col, F.when(F.col("_slow"), F.col("_slow_trend"))
                    .otherwise(F.col("grade_trend")).alias("grade_trend")))


def activity_features(df: DataFrame, as_of, days: int = 30, id_col: str = "student_id",
                      with_trend: bool = True) -> DataFrame:
    """A1-A10 + W2 aligned per student (J1). Features appear only when their
    source columns exist, as in the reference's presence checks."""
    cols = set(df.columns)
    aggs: list[Column] = []
    if "grade" in cols:
        aggs += [F.avg("grade").alias("avg_grade"),
                 F.stddev_samp("grade").alias("grade_volatility")]
    if "attendance_rate" in cols:
        cutoff = _ts_lit((_dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of)
                         - _dt.timedelta(days=days))
        aggs += [F.avg("attendance_rate").alias("attendance_rate"),
                 F.stddev_samp("attendance_rate").alias("attendance_consistency"),
                 F.avg(F.when(F.col("date") >= cutoff, F.col("attendance_rate"))).alias("recent_attendance")]
    if "lms_logins" in cols:
        df = weekend_flag(df)
        wk, logins, tenths = F.col("is_weekend"), F.col("lms_logins"), engagement_tenths()
        aggs += [F.avg("lms_logins").alias("avg_lms_logins"),
                 # one division of two whole numbers: no order of summation shows
                 F.when(F.count(tenths) > 0, F.sum(tenths) / (F.count(tenths) * 10)).alias("lms_engagement_score"),
                 F.when((F.count_if(wk) > 0) & (F.count_if(~wk) > 0),
                        F.sum(F.when(wk, logins)) / (F.sum(F.when(~wk, logins)) + 1))
                 .alias("weekend_activity_ratio")]
    if "assignment_completion_rate" in cols:
        aggs.append(F.avg("assignment_completion_rate").alias("assignment_completion_avg"))
        if "submission_status" in cols:
            late = F.count_if(F.col("submission_status") == "late")
            aggs.append(F.when(late > 0, late / F.count(F.lit(1))).alias("late_submission_rate"))
        else:
            aggs.append(F.lit(None).cast("double").alias("late_submission_rate"))
    out = df.groupBy(id_col).agg(*aggs)
    if with_trend and "grade" in cols:
        out = out.join(grade_trend(df, id_col=id_col), id_col, "left")
    return out
