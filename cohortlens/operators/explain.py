"""Attribution tables, factors and recommendations.

Attributions are a long table (id, class, feature, value, shap): one row per
explained row and feature. Everything downstream is keyed aggregation or a
``row_number() <= n`` per id (WindowGroupLimit: partial top-n map-side), and
per-id lists are at most n long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The recommendation rules in priority order
# (feature substring, value test, recommendation text).
RECOMMENDATION_RULES = [
    ("failures", "gt", 0, "Provide additional academic support to address past failures"),
    ("absences", "gt", 5, "Monitor and address attendance issues"),
    ("studytime", "lt", 2, "Encourage increased study time and provide study skills training"),
    ("schoolsup", "eq", 0, "Consider enrolling in extra educational support programs"),
    ("higher", "eq", 0, "Discuss higher education aspirations and career planning"),
    ("goout", "gt", 3, "Balance social activities with academic responsibilities"),
    ("health", "lt", 3, "Address health concerns that may impact academic performance"),
    ("famrel", "lt", 3, "Consider family counseling to improve home support"),
]
# Generic recommendations appended when fewer than three matched.
GENERIC_RECOMMENDATIONS = [
    "Schedule regular check-ins with academic advisor",
    "Connect with peer tutoring services",
    "Develop a personalized study plan",
]
MAX_RECOMMENDATIONS = 5
TOP_NEGATIVE = 5


def linear_attribution(df: DataFrame, weights: dict, id_col: str, means: dict | None = None,
                       class_name: str = "score") -> DataFrame:
    """Exact Shapley values of a linear score, w_j * (x_j - mean_j).

    ``means`` are the background means (one aggregate when not given); a
    missing value takes the mean, i.e. contributes 0."""
    feats = list(weights)
    if means is None:
        means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first().asDict()
    vals = {f: F.coalesce(F.col(f).cast("double"), F.lit(means[f])) for f in feats}
    wide = df.select(F.col(id_col), *[F.struct(F.lit(f).alias("feature"), vals[f].alias("value"),
                                               (F.lit(weights[f]) * (vals[f] - F.lit(means[f]))).alias("shap")
                                               ).alias(f) for f in feats])
    long = wide.select(id_col, F.explode(F.array(*[F.col(f) for f in feats])).alias("a"))
    return long.select(id_col, F.lit(class_name).alias("class_name"), "a.feature", "a.value", "a.shap")


def global_importance(attr: DataFrame, by=()) -> DataFrame:
    """Mean |shap| per (class, feature), then the mean over classes."""
    by = list(by)
    per_class = attr.groupBy(*by, "class_name", "feature").agg(F.avg(F.abs("shap")).alias("imp"))
    return per_class.groupBy(*by, "feature").agg(F.avg("imp").alias("importance"))


def aggregate_importance(imp: DataFrame) -> DataFrame:
    """Importance summed over models per feature (L1: order by it, descending)."""
    return imp.groupBy("feature").agg(F.sum("importance").alias("importance"))


def _ranked(attr: DataFrame, id_col: str, sign: str, n: int) -> DataFrame:
    cond = F.col("shap") > 0 if sign == "positive" else F.col("shap") < 0
    w = Window.partitionBy(id_col, "class_name").orderBy(F.desc(F.abs("shap")), "feature")
    return attr.filter(cond).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def top_factors(attr: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """X8 (with L3, P18): per row the n strongest positive and n strongest
    negative contributions, by |shap| descending, as ordered arrays of
    structs (feature, value, impact)."""
    out = None
    for sign in ("positive", "negative"):
        r = _ranked(attr, id_col, sign, n)
        lists = r.groupBy(id_col, "class_name").agg(
            F.array_sort(F.collect_list(F.struct("rn", "feature", "value", F.col("shap").alias("impact"))))
            .alias(f"{sign}_factors"))
        lists = lists.withColumn(f"{sign}_factors", F.transform(
            f"{sign}_factors", lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"),
                                                  s["impact"].alias("impact"))))
        out = lists if out is None else out.join(lists, [id_col, "class_name"], "full")
    ids = attr.select(id_col, "class_name").distinct()
    return ids.join(out, [id_col, "class_name"], "left")


def _rule_text(feature: Column, value: Column) -> Column:
    expr = None
    for key, op, thr, text in RECOMMENDATION_RULES:
        test = {"gt": value > thr, "lt": value < thr, "eq": value == thr}[op]
        cond = feature.contains(key) & test
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr


def with_raw_values(attr: DataFrame, roster: DataFrame, id_col: str, roster_id: str = "student_id") -> DataFrame:
    """``attr`` with ``value`` from the roster before scaling (yes / no as 1 / 0), joined by id and feature.

    The rules of R4 are written for raw values; features that the roster does
    not hold keep the value they have."""
    nums = [c for c, t in roster.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") and c != roster_id]
    texts = [c for c, t in roster.dtypes if t == "string"]
    flag = lambda c: F.when(F.col(c) == "yes", 1.0).when(F.col(c) == "no", 0.0)
    wide = roster.join(attr.select(F.col(id_col).alias(roster_id)).distinct(), roster_id, "left_semi").select(
        F.col(roster_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in nums], *[flag(c).alias(c) for c in texts])
    raw = wide.unpivot(["_id"], nums + texts, "_feature", "_raw").filter(F.col("_raw").isNotNull())
    a, r = attr.alias("a"), raw.alias("r")
    j = a.join(r, (F.col(f"a.{id_col}") == F.col("r._id")) & (F.col("a.feature") == F.col("r._feature")), "left")
    return j.select(*[F.coalesce("r._raw", "a.value").alias("value") if c == "value" else F.col(f"a.{c}") for c in attr.columns])


def recommendations(attr: DataFrame, id_col: str) -> DataFrame:
    """Texts from the strongest negative contributions (first matching
    rule per feature, in contribution order); fewer than three -> the three
    generic texts are appended; at most five are kept."""
    r = _ranked(attr, id_col, "negative", TOP_NEGATIVE).withColumn(
        "text", _rule_text(F.col("feature"), F.col("value")))
    lists = r.filter(F.col("text").isNotNull()).groupBy(id_col, "class_name").agg(
        F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("_l"))
    ids = attr.select(id_col, "class_name").distinct()
    j = ids.join(lists, [id_col, "class_name"], "left")
    specific = F.coalesce(F.transform("_l", lambda s: s["text"]), F.array().cast("array<string>"))
    generic = F.array(*[F.lit(t) for t in GENERIC_RECOMMENDATIONS])
    recs = F.when(F.size(specific) < 3, F.concat(specific, generic)).otherwise(specific)
    return j.select(id_col, "class_name", F.slice(recs, 1, MAX_RECOMMENDATIONS).alias("recommendations"))
