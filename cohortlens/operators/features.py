"""Derived row features (F1-F20): pure projections over the cleaned roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import clip, right_closed_cut, yes_no
from cohortlens.operators.clean import ID_COLS, clean

EPS = 1e-8

# Bin edges and labels of the two categorical features.
AGE_EDGES = [14, 16, 18, 22]
AGE_LABELS = ["young", "middle", "old"]
ABSENCE_EDGES = [-1, 0, 5, 15, 100]
ABSENCE_LABELS = ["none", "low", "medium", "high"]

FEATURE_COLUMNS = [
    "parent_education_avg", "parent_education_diff", "parent_education_max",
    "alcohol_total", "alcohol_ratio", "high_alcohol", "social_time",
    "study_social_ratio", "academic_support", "family_stability",
    "motivation_score", "risk_composite", "study_efficiency", "home_advantage",
    "age_group", "absence_level",
]


def row_features(df: DataFrame) -> DataFrame:
    """F1-F16 as one projection (no cleaning). Out-of-range bins give the text 'nan'."""
    c = F.col
    academic_support = yes_no("schoolsup") + yes_no("famsup")
    motivation = yes_no("higher") * 2 + yes_no("activities")
    pstatus = F.when(c("Pstatus") == "T", 1).when(c("Pstatus") == "A", 0).otherwise(0)
    risk = (c("failures") * 2 + (5 - c("health")) * 0.5 + c("absences") * 0.1
            - academic_support - motivation)
    return df.withColumns({
        "parent_education_avg": (c("Medu") + c("Fedu")) / 2,
        "parent_education_diff": F.abs(c("Medu") - c("Fedu")),
        "parent_education_max": F.greatest(c("Medu"), c("Fedu")),
        "alcohol_total": c("Dalc") + c("Walc"),
        "alcohol_ratio": clip(c("Walc") / F.greatest(c("Dalc"), F.lit(EPS)), 0, 10),
        "high_alcohol": ((c("Dalc") + c("Walc")) > 6).cast("int"),
        "social_time": c("goout") + c("freetime"),
        "study_social_ratio": clip(c("studytime") / F.greatest(c("goout"), F.lit(EPS)), 0, 10),
        "academic_support": academic_support,
        "family_stability": clip(c("famrel") * (2 - pstatus), 0, 10),
        "motivation_score": motivation,
        "risk_composite": clip(risk, -10, 20),
        "study_efficiency": clip(c("studytime") * c("health") / F.greatest(c("absences"), F.lit(1)), 0, 50),
        "home_advantage": yes_no("internet") + yes_no("famsup") + (c("famrel") > 3).cast("int"),
        "age_group": right_closed_cut("age", AGE_EDGES, AGE_LABELS, other="nan"),
        "absence_level": right_closed_cut("absences", ABSENCE_EDGES, ABSENCE_LABELS, other="nan"),
    })


def advanced_features(df: DataFrame, exclude=ID_COLS) -> DataFrame:
    """Clean, derive F1-F16, clean again (the second pass also clips the new columns).

    Two passes fit the statistics; the result is one narrow projection of the
    source with those statistics as literals, so nothing is written in between.
    """
    return clean(row_features(clean(df, exclude=exclude)), exclude=exclude)


def pass_fail_and_score(df: DataFrame, target: str = "G3") -> DataFrame:
    """F19 pass_fail = 1 if grade >= 10; F20 risk_score = 1 - grade / 20."""
    g = F.col(target)
    return df.withColumns({"pass_fail": (g >= 10).cast("int"),
                           "risk_score": 1 - g / 20})


def engagement(df: DataFrame) -> DataFrame:
    """F17 per-event engagement score."""
    return df.withColumn("engagement", engagement_tenths() / 10)


def engagement_tenths() -> Column:
    """Ten times F17: whole weights, so sums of counts are exact in any order."""
    c = F.col
    return c("lms_logins") * 3 + c("page_views") * 2 + c("resource_downloads") * 3 + c("discussion_posts") * 2


def weekend_flag(df: DataFrame, date_col: str = "date") -> DataFrame:
    """F18 Saturday or Sunday (``weekday`` counts Monday as 0)."""
    return df.withColumn("is_weekend", F.weekday(F.col(date_col)) >= 5)
