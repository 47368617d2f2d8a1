"""Test views over the driver's tables, shared by the Spark queries and the
DuckDB oracle so that both sides start from identical rows.

``roster`` stands in for the one-row-per-student CSV, ``activity`` for the
per-event fact table; the smaller derived views (``preds``, ``votes``,
``scores``, ``vectors``) feed evaluation, consensus, ROC and kNN.
The SQL is written once; ``dialect()`` swaps the two array functions whose
names differ between Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

ROSTER_SQL = """
SELECT c_custkey AS student_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'MS' ELSE 'GP' END AS school,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CAST(15 + (c_custkey * 5) % 8 AS INT) AS age,
  CASE WHEN c_nationkey % 4 = 0 THEN 'R' ELSE 'U' END AS address,
  CASE WHEN c_custkey % 5 < 2 THEN 'LE3' ELSE 'GT3' END AS famsize,
  CASE WHEN c_custkey % 9 = 0 THEN 'A' ELSE 'T' END AS Pstatus,
  CAST(c_custkey % 5 AS INT) AS Medu,
  CAST((c_custkey * 7 + c_nationkey) % 5 AS INT) AS Fedu,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'at_home' WHEN 'BUILDING' THEN 'health'
       WHEN 'FURNITURE' THEN 'other' WHEN 'HOUSEHOLD' THEN 'services' ELSE 'teacher' END AS Mjob,
  CASE c_nationkey % 5 WHEN 0 THEN 'at_home' WHEN 1 THEN 'health' WHEN 2 THEN 'other'
       WHEN 3 THEN 'services' ELSE 'teacher' END AS Fjob,
  CASE c_nationkey % 4 WHEN 0 THEN 'course' WHEN 1 THEN 'home' WHEN 2 THEN 'other'
       ELSE 'reputation' END AS reason,
  CASE c_custkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'father' WHEN 2 THEN 'father'
       ELSE 'mother' END AS guardian,
  CAST(1 + c_nationkey % 4 AS INT) AS traveltime,
  CAST(1 + (c_custkey * 3 + 1) % 4 AS INT) AS studytime,
  CAST(CASE WHEN c_custkey % 10 < 7 THEN 0 ELSE c_custkey % 10 - 6 END AS INT) AS failures,
  CASE WHEN c_custkey % 8 = 0 THEN 'yes' ELSE 'no' END AS schoolsup,
  CASE WHEN c_custkey % 5 < 3 THEN 'yes' ELSE 'no' END AS famsup,
  CASE WHEN c_custkey % 13 = 0 THEN 'yes' ELSE 'no' END AS paid,
  CASE WHEN c_custkey % 4 < 2 THEN 'yes' ELSE 'no' END AS activities,
  CASE WHEN c_custkey % 6 > 0 THEN 'yes' ELSE 'no' END AS nursery,
  CASE WHEN c_custkey % 10 < 9 THEN 'yes' ELSE 'no' END AS higher,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'no' ELSE 'yes' END AS internet,
  CASE WHEN c_custkey % 3 = 1 THEN 'yes' ELSE 'no' END AS romantic,
  CAST(1 + (c_custkey * 11) % 5 AS INT) AS famrel,
  CAST(1 + (c_custkey * 3 + c_nationkey) % 5 AS INT) AS freetime,
  CAST(1 + (c_custkey + c_nationkey * 2) % 5 AS INT) AS goout,
  CAST(1 + (c_custkey * c_custkey) % 5 AS INT) AS Dalc,
  CAST(1 + (c_custkey * c_custkey + c_nationkey) % 5 AS INT) AS Walc,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(1 + (c_custkey * 2) % 5 AS INT) END AS health,
  CAST(CASE WHEN c_custkey % 11 = 0 THEN (c_custkey * 37) % 94 ELSE (c_custkey * 13) % 12 END AS INT) AS absences,
  CAST(floor((c_acctbal + 1000) / 11000 * 21) AS INT) AS G3,
  CAST(floor((c_acctbal + 1000) / 11000 * 19) AS INT) AS G2,
  CAST(floor((c_acctbal + 1000) / 11000 * 16) AS INT) + CAST(c_custkey % 4 AS INT) AS G1
FROM customer
"""

ACTIVITY_EXPRS = [
    "event_id",
    # every event counts; one student in 25 keeps few of them, the neighbour gets the others
    "CASE WHEN user_id % 25 <> 3 OR event_id % 40 = 7 THEN user_id ELSE user_id + 1 END AS student_id",
    "ts AS date",
    "CAST((event_id * 7) % 101 AS DOUBLE) AS grade",
    "CAST(event_id % 101 AS DOUBLE) / 100 AS attendance_rate",
    "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS lms_logins",
    "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS page_views",
    "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS resource_downloads",
    "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS discussion_posts",
    "CAST(event_id % 11 AS DOUBLE) / 10 AS assignment_completion_rate",
    "CASE WHEN event_type = 'error' AND user_id % 10 <> 0 THEN 'late' ELSE 'on_time' END AS submission_status",
]
ACTIVITY_SQL = "SELECT " + ",\n  ".join(ACTIVITY_EXPRS) + "\nFROM events\n"

# Loader bands (-1,9] (9,11] (11,14] (14,20] as SQL, right-closed like the roster rule.
def _loader_band_sql(col: str) -> str:
    return (f"CASE WHEN {col} > -1 AND {col} <= 9 THEN 'Critical' "
            f"WHEN {col} > 9 AND {col} <= 11 THEN 'High' "
            f"WHEN {col} > 11 AND {col} <= 14 THEN 'Medium' "
            f"WHEN {col} > 14 AND {col} <= 20 THEN 'Low' END")


PREDS_SQL = f"""
SELECT student_id, {_loader_band_sql('G3')} AS y_true, {_loader_band_sql('G2')} AS y_pred
FROM roster
"""


def _vote_branch(model: str, grade: str, error_rule: str, zero_rule: str) -> str:
    band = _loader_band_sql(grade)
    main = f"(CAST(0.4 AS DOUBLE) + CAST({grade} % 5 AS DOUBLE) / 10)"
    other = f"((1 - {main}) / 3)"
    probs = ", ".join(
        f"CASE WHEN {zero_rule} THEN CAST(0 AS DOUBLE) WHEN b = '{c}' THEN {main} ELSE {other} END"
        for c in ("Critical", "High", "Low", "Medium"))
    return f"""
SELECT student_id, '{model}' AS model,
  CASE WHEN {error_rule} THEN NULL ELSE b END AS prediction,
  CASE WHEN {error_rule} THEN NULL ELSE {{array}}({probs}) END AS probability,
  CASE WHEN {error_rule} THEN 'model failed' END AS error
FROM (SELECT student_id, {grade}, {band} AS b FROM roster) t"""


VOTES_SQL = " UNION ALL ".join([
    _vote_branch("m1", "G1", "1 = 0", "1 = 0"),
    _vote_branch("m2", "G2", "1 = 0", "student_id % 31 = 0"),
    _vote_branch("m3", "G3", "student_id % 23 = 0", "1 = 0"),
])

SCORES_SQL = """
SELECT l.doc_id, CAST(l.quality AS INT) AS y, CAST(d.n_chars AS DOUBLE) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

VECTORS_SQL = """
SELECT vec_id, embedding, CAST(label AS INT) AS label FROM embeddings
"""

VIEWS = {
    "roster": ROSTER_SQL,
    "activity": ACTIVITY_SQL,
    "preds": PREDS_SQL,
    "votes": VOTES_SQL,
    "scores": SCORES_SQL,
    "vectors": VECTORS_SQL,
}
# views that other views read
VIEW_DEPS = {"preds": ["roster"], "votes": ["roster"]}

_DIALECT = {
    "spark": {"array": "array", "array_join": "array_join"},
    "duckdb": {"array": "list_value", "array_join": "array_to_string"},
}


def dialect(sql: str, name: str) -> str:
    """Substitute ``{array}`` / ``{array_join}`` placeholders for one engine."""
    out = sql
    for k, v in _DIALECT[name].items():
        out = out.replace("{" + k + "}", v)
    return out


def with_views(body: str, *views: str, ctes: str = "", engine: str = "duckdb") -> str:
    """Prefix ``body`` with the CTEs of the listed fixture views (and their
    deps), followed by the extra ``ctes`` text."""
    order: list[str] = []
    for v in views:
        for d in VIEW_DEPS.get(v, []):
            if d not in order:
                order.append(d)
        if v not in order:
            order.append(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order]
    if ctes:
        parts.append(ctes)
    return dialect("WITH " + ",\n".join(parts) + "\n" + body, engine)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture view over the parquet tables of ``sf_dir``."""
    base = {"roster": ["customer"], "activity": ["events"], "preds": ["customer"],
            "votes": ["customer"], "scores": ["labels", "documents"],
            "vectors": ["embeddings"]}[name]
    register_tables(spark, sf_dir, base)
    for d in VIEW_DEPS.get(name, []):
        spark.sql(dialect(VIEWS[d], "spark")).createOrReplaceTempView(d)
    return spark.sql(dialect(VIEWS[name], "spark"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "roster")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "activity")
