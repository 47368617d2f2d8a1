"""Dashboard risk levels and factors (R1-R3), model-vote consensus (R5-R7),
row validation (P15).

Everything is a projection or a per-key aggregate: the row loop of a
dashboard becomes array expressions, and the vote consensus is one
``max_by`` aggregate per student (partial aggregation, so a hot student
does not land in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import to_number, word_caps
from cohortlens.operators.bands import dashboard_level
from cohortlens.operators.clean import with_default

# Dashboard risk factors in display order with the defaults used
# when a column is absent.
FACTOR_DEFAULTS = {"failures": 0, "absences": 0, "studytime": 2, "goout": 0,
                   "Dalc": 0, "Walc": 0, "schoolsup": "yes", "famsup": "yes"}
STRONG_PERFORMANCE = "Strong Performance"
MAX_FACTORS = 3


def factor_array(df: DataFrame) -> Column:
    """Ordered list of matching factors; a null value never matches."""
    g = lambda c: with_default(df, c, FACTOR_DEFAULTS[c])
    # fixed values: the factor texts and their order
    rules = [
        ("Past Failures", g("failures") > 0),
        ("Frequent Absences", g("absences") > 5),
        ("Low Study Time", g("studytime") <= 1),
        ("High Social Activity", g("goout") >= 4),
        ("Alcohol Consumption", (g("Dalc") >= 3) | (g("Walc") >= 3)),
        ("No School Support", g("schoolsup") == "no"),
        ("No Family Support", g("famsup") == "no"),
    ]
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def dashboard(df: DataFrame, grade: str = "G3", id_col: str = "student_id") -> DataFrame:
    """R1-R3 + B6: one row per student with a grade: level, display id, first 3 factors.

    The grade is read as a number first (P5). Students without one (null, NaN,
    text) are dropped from the lists (they still count in the totals, A17).
    """
    g = to_number(grade)
    factors = F.slice(factor_array(df), 1, MAX_FACTORS)
    level = dashboard_level(g)
    factors = F.when((level == "low") & (F.size(factors) == 0),
                     F.array(F.lit(STRONG_PERFORMANCE))).otherwise(factors)
    return (df.select(F.col(id_col), level.alias("level"),
                      F.concat(F.lit("Student #"), F.col(id_col).cast("string")).alias("display_id"),
                      factors.alias("factors"))
            .filter(F.col("level").isNotNull()))


def dashboard_totals(df: DataFrame, grade: str = "G3") -> DataFrame:
    """Total rows and per-level counts in one aggregate (list rule for levels)."""
    g = to_number(grade)
    lvl = dashboard_level(g)
    return df.agg(F.count(F.lit(1)).alias("total_students"),
                  F.count_if(lvl == "high").alias("high_risk_count"),
                  F.count_if(lvl == "medium").alias("medium_risk_count"),
                  F.count_if(lvl == "low").alias("low_risk_count"))


def consensus(votes: DataFrame, id_col: str = "student_id", model_order=None) -> DataFrame:
    """R5 + R6 per id over valid (error-free) votes.

    Consensus = most frequent prediction; on a tie the label whose first vote
    comes latest in model order wins. Confidence = mean of max probability
    over votes whose max probability is > 0, else 0.
    """
    if model_order:
        pos = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    else:
        pos = F.col("model")
    valid = votes.filter(F.col("error").isNull() & F.col("prediction").isNotNull()) \
        if "error" in votes.columns else votes.filter(F.col("prediction").isNotNull())
    per_label = (valid.groupBy(id_col, "prediction")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_seen")))
    cons = per_label.groupBy(id_col).agg(
        F.max_by("prediction", F.struct("n", "first_seen")).alias("consensus"))
    pmax = F.array_max(F.col("probability"))
    conf = valid.groupBy(id_col).agg(
        F.coalesce(F.avg(F.when(pmax > 0, pmax)), F.lit(0.0)).alias("confidence"),
        F.count(F.lit(1)).alias("n_valid"))
    return cons.join(conf, id_col, "inner")


def vote_lines(votes: DataFrame) -> DataFrame:
    """Per-model display line: name, prediction or 'Error', confidence x 100 or 0."""
    pmax = F.array_max(F.col("probability"))
    return votes.select(
        "student_id", "model",
        word_caps("model").alias("model_name"),
        F.coalesce(F.col("prediction"), F.lit("Error")).alias("prediction"),
        F.coalesce(pmax * 100, F.lit(0.0)).alias("confidence"),
        F.col("error") if "error" in votes.columns else F.lit(None).cast("string").alias("error"))


REQUIRED_FIELDS = ["age", "sex", "school", "address"]


def validate_rows(df: DataFrame, min_age: int = 15, max_age: int = 22) -> DataFrame:
    """Add ``valid`` and ``message`` (first failing rule) per row.

    A field is missing when it is null, empty text or 0, as a form check treats it.
    """
    types = dict(df.dtypes)

    def missing(c):
        if c not in types:            # an absent field is missing on every row
            return F.lit(True)
        x = F.col(c)
        if types[c] == "string":
            return x.isNull() | (x == "")
        return x.isNull() | (x == 0)

    names = F.concat_ws(", ", *[F.when(missing(c), F.lit(c)) for c in REQUIRED_FIELDS])
    any_missing = F.lit(False)
    for c in REQUIRED_FIELDS:
        any_missing = any_missing | missing(c)
    age = F.col("age") if "age" in types else F.lit(None)
    msg = (F.when(any_missing, F.concat(F.lit("Missing required fields: "), names))
           .when((age < min_age) | (age > max_age), F.lit(f"Age must be between {min_age} and {max_age}")))
    return df.withColumns({"valid": msg.isNull(), "message": msg})
