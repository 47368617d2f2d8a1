"""Schemas, column-type selection, target check and the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The roster data dictionary (column -> description), in the
# dataset's column order.
FEATURE_DESCRIPTIONS = {
    "school": "student's school (binary: \"GP\" or \"MS\")",
    "sex": "student's sex (binary: \"F\" - female or \"M\" - male)",
    "age": "student's age (numeric: from 15 to 22)",
    "address": "student's home address type (binary: \"U\" - urban or \"R\" - rural)",
    "famsize": "family size (binary: \"LE3\" - less or equal to 3 or \"GT3\" - greater than 3)",
    "Pstatus": "parent's cohabitation status (binary: \"T\" - living together or \"A\" - apart)",
    "Medu": "mother's education (numeric: 0-4)",
    "Fedu": "father's education (numeric: 0-4)",
    "Mjob": "mother's job (nominal)",
    "Fjob": "father's job (nominal)",
    "reason": "reason to choose this school (nominal)",
    "guardian": "student's guardian (nominal)",
    "traveltime": "home to school travel time (numeric: 1-4)",
    "studytime": "weekly study time (numeric: 1-4)",
    "failures": "number of past class failures (numeric: n if 1<=n<3, else 4)",
    "schoolsup": "extra educational support (binary: yes or no)",
    "famsup": "family educational support (binary: yes or no)",
    "paid": "extra paid classes (binary: yes or no)",
    "activities": "extra-curricular activities (binary: yes or no)",
    "nursery": "attended nursery school (binary: yes or no)",
    "higher": "wants to take higher education (binary: yes or no)",
    "internet": "Internet access at home (binary: yes or no)",
    "romantic": "with a romantic relationship (binary: yes or no)",
    "famrel": "quality of family relationships (numeric: from 1 - very bad to 5 - excellent)",
    "freetime": "free time after school (numeric: from 1 - very low to 5 - very high)",
    "goout": "going out with friends (numeric: from 1 - very low to 5 - very high)",
    "Dalc": "workday alcohol consumption (numeric: from 1 - very low to 5 - very high)",
    "Walc": "weekend alcohol consumption (numeric: from 1 - very low to 5 - very high)",
    "health": "current health status (numeric: from 1 - very bad to 5 - very good)",
    "absences": "number of school absences (numeric: from 0 to 93)",
    "G1": "first period grade (numeric: from 0 to 20)",
    "G2": "second period grade (numeric: from 0 to 20)",
    "G3": "final grade (numeric: from 0 to 20, output target)",
}

_INT_COLS = {"age", "Medu", "Fedu", "traveltime", "studytime", "failures", "famrel",
             "freetime", "goout", "Dalc", "Walc", "health", "absences", "G1", "G2", "G3"}

ROSTER_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c in _INT_COLS else T.StringType(), True,
                  metadata={"comment": d})
    for c, d in FEATURE_DESCRIPTIONS.items()
])

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("student_id", T.LongType(), True),
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("grade", T.DoubleType(), True),
    T.StructField("attendance_rate", T.DoubleType(), True),
    T.StructField("lms_logins", T.IntegerType(), True),
    T.StructField("page_views", T.IntegerType(), True),
    T.StructField("resource_downloads", T.IntegerType(), True),
    T.StructField("discussion_posts", T.IntegerType(), True),
    T.StructField("assignment_completion_rate", T.DoubleType(), True),
    T.StructField("submission_status", T.StringType(), True),
])

# Relational schema of the records store: students and their 1:N record tables.
# The foreign key is the integer ``student.id``.
RELATIONAL_SCHEMAS = {
    "student": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("student_id", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("enrollment_date", T.DateType()),
        T.StructField("program", T.StringType()),
    ]),
    "academic_record": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("student_id", T.LongType(), False),
        T.StructField("course_id", T.StringType()),
        T.StructField("course_name", T.StringType()),
        T.StructField("semester", T.StringType()),
        T.StructField("grade", T.DoubleType()),
        T.StructField("credits", T.IntegerType()),
        T.StructField("assignment_completion_rate", T.DoubleType()),
        T.StructField("quiz_average", T.DoubleType()),
        T.StructField("midterm_score", T.DoubleType()),
    ]),
    "attendance_record": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("student_id", T.LongType(), False),
        T.StructField("course_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_minutes", T.IntegerType()),
    ]),
    "lms_activity": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("student_id", T.LongType(), False),
        T.StructField("course_id", T.StringType()),
        T.StructField("activity_date", T.TimestampType()),
        T.StructField("activity_type", T.StringType()),
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("page_views", T.IntegerType()),
    ]),
    "risk_prediction": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("student_id", T.LongType(), False),
        T.StructField("prediction_date", T.TimestampType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("intervention_recommendations", T.StringType()),
    ]),
}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns by schema (booleans are not numeric). No job runs."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def require_column(df: DataFrame, name: str) -> None:
    """Raise before any job when the target column is missing."""
    if name not in df.columns:
        raise ValueError(f"Target column '{name}' not found in data")


def feature_info() -> dict[str, str]:
    return dict(FEATURE_DESCRIPTIONS)


def dictionary_comments(df: DataFrame) -> dict[str, str]:
    """Descriptions carried in the schema metadata of ``df``."""
    return {f.name: f.metadata.get("comment") for f in df.schema.fields
            if f.metadata and "comment" in f.metadata}
