"""Registered queries over the activity (event) view and the relational tables."""

from __future__ import annotations


from cohortlens import fixtures as fx
from cohortlens.operators import activity as act
from cohortlens.operators import relational as rel
from cohortlens.plans.registry import register, rounded

W = fx.with_views
AS_OF = "2024-01-31 00:00:00"
RECENT_DAYS = 7

_ROLL = """roll AS (
  SELECT student_id, date, event_id,
    CASE WHEN count(grade) OVER w = 3 THEN avg(grade) OVER w END AS rolling_grade
  FROM activity
  WINDOW w AS (PARTITION BY student_id ORDER BY date, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
trend AS (
  SELECT s.student_id, t.rolling_grade AS grade_trend
  FROM (SELECT DISTINCT student_id FROM activity) s
  LEFT JOIN (SELECT student_id, rolling_grade, row_number() OVER (PARTITION BY student_id
               ORDER BY date DESC, event_id DESC) AS rn
             FROM roll WHERE rolling_grade IS NOT NULL) t ON s.student_id = t.student_id AND t.rn = 1)"""

_FEATS = f"""feats AS (
  SELECT student_id,
    avg(grade) AS avg_grade, stddev_samp(grade) AS grade_volatility,
    avg(attendance_rate) AS attendance_rate, stddev_samp(attendance_rate) AS attendance_consistency,
    avg(CASE WHEN date >= TIMESTAMP '{AS_OF}' - INTERVAL {RECENT_DAYS} DAY THEN attendance_rate END) AS recent_attendance,
    avg(lms_logins) AS avg_lms_logins,
    avg(lms_logins * 0.3 + page_views * 0.2 + resource_downloads * 0.3 + discussion_posts * 0.2) AS lms_engagement_score,
    CASE WHEN count(*) FILTER (WHERE isodow(date) >= 6) > 0 AND count(*) FILTER (WHERE isodow(date) < 6) > 0
         THEN sum(lms_logins) FILTER (WHERE isodow(date) >= 6) / (sum(lms_logins) FILTER (WHERE isodow(date) < 6) + 1)
    END AS weekend_activity_ratio,
    avg(assignment_completion_rate) AS assignment_completion_avg,
    CASE WHEN count(*) FILTER (WHERE submission_status = 'late') > 0
         THEN count(*) FILTER (WHERE submission_status = 'late') / count(*) END AS late_submission_rate
  FROM activity GROUP BY student_id)"""

FEATURE_COLS = ["avg_grade", "grade_volatility", "attendance_rate", "attendance_consistency",
                "recent_attendance", "avg_lms_logins", "lms_engagement_score",
                "weekend_activity_ratio", "assignment_completion_avg", "late_submission_rate",
                "grade_trend"]


def _rnd(cols, src=""):
    return ", ".join(f"round({src}{c}, 6) AS {c}" for c in cols)


def _j01(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return rounded(act.activity_features(a, AS_OF, RECENT_DAYS))


register("j01_activity_features", W(
    f"SELECT f.student_id, {_rnd(FEATURE_COLS[:-1], 'f.')}, round(t.grade_trend, 6) AS grade_trend "
    f"FROM feats f LEFT JOIN trend t ON f.student_id = t.student_id",
    "activity", ctes=f"{_FEATS},\n{_ROLL}"))(_j01)


def _feature_subset(cols):
    def q(spark, sf_dir):
        a = fx.activity(spark, sf_dir)
        return rounded(act.activity_features(a, AS_OF, RECENT_DAYS, with_trend=False)
                       .select("student_id", *cols))
    return q


for _name, _cols in [("a01_a07_student_means", ["avg_grade", "grade_volatility", "attendance_rate",
                                                "attendance_consistency", "avg_lms_logins",
                                                "assignment_completion_avg"]),
                     ("a03_attendance_rate", ["attendance_rate"]),
                     ("a04_attendance_consistency", ["attendance_consistency"]),
                     ("a05_recent_attendance", ["recent_attendance"]),
                     ("a08_late_submission_rate", ["late_submission_rate"]),
                     ("a09_lms_engagement", ["lms_engagement_score"]),
                     ("a10_weekend_activity_ratio", ["weekend_activity_ratio"])]:
    register(_name, W(f"SELECT student_id, {_rnd(_cols)} FROM feats", "activity",
                      ctes=_FEATS))(_feature_subset(_cols))


def _w01(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return rounded(act.rolling_mean(a).select("event_id", "student_id", "rolling_grade"))


register("w01_rolling_grade", W("""
SELECT event_id, student_id, round(CASE WHEN count(grade) OVER w = 3 THEN avg(grade) OVER w END, 6) AS rolling_grade
FROM activity
WINDOW w AS (PARTITION BY student_id ORDER BY date, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "activity"))(_w01)


def _w02(spark, sf_dir):
    return rounded(act.grade_trend(fx.activity(spark, sf_dir)))


register("w02_grade_trend", W("SELECT student_id, round(grade_trend, 6) AS grade_trend FROM trend",
                              "activity", ctes=_ROLL))(_w02)


def _f18(spark, sf_dir):
    from cohortlens.operators.features import engagement, weekend_flag
    a = weekend_flag(engagement(fx.activity(spark, sf_dir)))
    return rounded(a.select("event_id", "is_weekend", "engagement"))


register("f17_f18_event_features", W("""
SELECT event_id, isodow(date) >= 6 AS is_weekend,
  round(CAST(lms_logins AS DOUBLE) * 0.3 + page_views * 0.2 + resource_downloads * 0.3 + discussion_posts * 0.2, 6) AS engagement
FROM activity""", "activity"))(_f18)


# ---------------------------------------------------------------- relational
def _j05(spark, sf_dir):
    t = {n: fx.table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "events")}
    return rounded(rel.student_records_summary(t["customer"], t["orders"], t["lineitem"], t["events"]))


register("j05_student_records", """
WITH o AS (SELECT o_custkey AS student_id, count(*) AS n_records, avg(o_totalprice) AS avg_record_value
           FROM orders GROUP BY o_custkey),
l AS (SELECT o.o_custkey AS student_id, count(*) AS n_submissions,
             avg(CASE WHEN l.l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned_share
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
e AS (SELECT user_id AS student_id, count(*) AS n_events FROM events GROUP BY user_id)
SELECT c.c_custkey AS student_id, coalesce(o.n_records, 0) AS n_records,
  round(o.avg_record_value, 6) AS avg_record_value, coalesce(l.n_submissions, 0) AS n_submissions,
  round(l.returned_share, 6) AS returned_share, coalesce(e.n_events, 0) AS n_events
FROM customer c LEFT JOIN o ON c.c_custkey = o.student_id
LEFT JOIN l ON c.c_custkey = l.student_id LEFT JOIN e ON c.c_custkey = e.student_id""")(_j05)


# ---------------------------------------------------------------- streaming (same aggregates, incremental)
def _st01(spark, sf_dir):
    from cohortlens.streaming.activity_stream import run_activity_stream
    out = run_activity_stream(spark, sf_dir, AS_OF, RECENT_DAYS, file_glob="events.parquet")
    return rounded(out.select("student_id", *FEATURE_COLS[:-1]))


register("st01_streaming_activity_features", W(
    f"SELECT student_id, {_rnd(FEATURE_COLS[:-1])} FROM feats", "activity", ctes=_FEATS))(_st01)
