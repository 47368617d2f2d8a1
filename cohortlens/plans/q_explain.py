"""Registered queries: attribution tables over the roster with fixed linear
weights (so every value is deterministic and SQL-checkable), global
importance, factors and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.functions.exprs import yes_no
from cohortlens.operators import explain as ex
from cohortlens.operators import profile
from cohortlens.plans.registry import register, rounded

W = fx.with_views

# Fixture weights of two linear risk scores (test inputs, not reference values).
WEIGHTS = {
    "linear_a": {"age": -0.05, "Medu": 0.1, "Fedu": 0.05, "traveltime": -0.1, "studytime": 0.3,
                 "failures": -0.8, "famrel": 0.2, "freetime": -0.05, "goout": -0.15, "Dalc": -0.1,
                 "Walc": -0.1, "health": 0.1, "absences": -0.05, "schoolsup": 0.25, "higher": 0.6,
                 "famsup": 0.15},
    "linear_b": {"age": 0.02, "Medu": 0.2, "Fedu": 0.2, "traveltime": -0.2, "studytime": 0.5,
                 "failures": -1.0, "famrel": 0.1, "freetime": 0.1, "goout": -0.3, "Dalc": -0.2,
                 "Walc": -0.05, "health": 0.3, "absences": -0.02, "schoolsup": -0.4, "higher": 0.9,
                 "famsup": 0.05},
}
YN = ("schoolsup", "higher", "famsup")
FEATS = list(WEIGHTS["linear_a"])


def _features(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    return r.select("student_id", *[yes_no(f).alias(f) if f in YN else F.col(f) for f in FEATS])


def attribution(spark, sf_dir, model="linear_a"):
    return ex.linear_attribution(_features(spark, sf_dir), WEIGHTS[model], "student_id")


_FEAT_SQL = "feat AS (SELECT student_id, " + ", ".join(
    f"CASE WHEN {f} = 'yes' THEN 1 ELSE 0 END AS {f}" if f in YN else f for f in FEATS) + " FROM roster),\n" \
    "means AS (SELECT " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in FEATS) + " FROM feat)"


def _attr_sql(model):
    w = WEIGHTS[model]
    return f"attr_{model} AS (" + " UNION ALL ".join(
        f"SELECT f.student_id, 'score' AS class_name, '{c}' AS feature, "
        f"coalesce(CAST(f.{c} AS DOUBLE), m.{c}) AS value, "
        f"{w[c]} * (coalesce(CAST(f.{c} AS DOUBLE), m.{c}) - m.{c}) AS shap "
        f"FROM feat f CROSS JOIN means m" for c in FEATS) + ")"


_CTES = _FEAT_SQL + ",\n" + _attr_sql("linear_a") + ",\n" + _attr_sql("linear_b")


def _x04(spark, sf_dir):
    return rounded(attribution(spark, sf_dir).select("student_id", "feature", "value", "shap"))


register("x04_linear_attribution", W(
    "SELECT student_id, feature, round(value, 6) AS value, round(shap, 6) AS shap FROM attr_linear_a",
    "roster", ctes=_CTES))(_x04)


def _importance(spark, sf_dir):
    parts = [ex.global_importance(attribution(spark, sf_dir, m)).withColumn("model", F.lit(m))
             for m in WEIGHTS]
    return parts[0].unionByName(parts[1])


def _x06(spark, sf_dir):
    return rounded(_importance(spark, sf_dir).select("model", "feature", "importance"))


_IMP = "imp AS (SELECT 'linear_a' AS model, feature, avg(abs(shap)) AS importance FROM attr_linear_a GROUP BY feature " \
       "UNION ALL SELECT 'linear_b', feature, avg(abs(shap)) FROM attr_linear_b GROUP BY feature)"
register("x06_global_importance", W(
    "SELECT model, feature, round(importance, 6) AS importance FROM imp", "roster",
    ctes=_CTES + ",\n" + _IMP))(_x06)


def _a20(spark, sf_dir):
    return rounded(ex.aggregate_importance(_importance(spark, sf_dir)))


register("a20_aggregate_importance", W(
    "SELECT feature, round(sum(importance), 6) AS importance FROM imp GROUP BY feature", "roster",
    ctes=_CTES + ",\n" + _IMP))(_a20)


def _l02(spark, sf_dir):
    agg = ex.aggregate_importance(_importance(spark, sf_dir))
    return rounded(profile.top_n(agg, "importance", 10, tie_col="feature"))


register("l01_l02_top_features", W("""
SELECT feature, round(importance, 6) AS importance FROM (
  SELECT feature, sum(importance) AS importance FROM imp GROUP BY feature) t
ORDER BY importance DESC, feature LIMIT 10""", "roster", ctes=_CTES + ",\n" + _IMP))(_l02)


def _names(col):
    return F.coalesce(F.array_join(F.transform(col, lambda s: s["feature"]), "|"), F.lit(""))


def _x08(spark, sf_dir):
    t = ex.top_factors(attribution(spark, sf_dir), "student_id", 5)
    return t.select("student_id", _names(F.col("positive_factors")).alias("positive_factors"),
                    _names(F.col("negative_factors")).alias("negative_factors"))


_RANK = """rk AS (SELECT *, row_number() OVER (PARTITION BY student_id, sgn ORDER BY abs(shap) DESC, feature) AS rn
  FROM (SELECT *, CASE WHEN shap > 0 THEN 'pos' WHEN shap < 0 THEN 'neg' END AS sgn FROM attr_linear_a) s
  WHERE sgn IS NOT NULL)"""
register("x08_top_factors", W("""
SELECT i.student_id,
  coalesce((SELECT string_agg(feature, '|' ORDER BY rn) FROM rk WHERE rk.student_id = i.student_id AND sgn = 'pos' AND rn <= 5), '') AS positive_factors,
  coalesce((SELECT string_agg(feature, '|' ORDER BY rn) FROM rk WHERE rk.student_id = i.student_id AND sgn = 'neg' AND rn <= 5), '') AS negative_factors
FROM (SELECT DISTINCT student_id FROM attr_linear_a) i""", "roster", ctes=_CTES + ",\n" + _RANK))(_x08)


def _r04(spark, sf_dir):
    r = ex.recommendations(attribution(spark, sf_dir), "student_id")
    return r.select("student_id", F.array_join("recommendations", "|").alias("recommendations"))


def _rule_sql():
    parts = []
    for key, op, thr, text in ex.RECOMMENDATION_RULES:
        sym = {"gt": ">", "lt": "<", "eq": "="}[op]
        parts.append(f"WHEN contains(feature, '{key}') AND value {sym} {thr} THEN '{text}'")
    return "CASE " + " ".join(parts) + " END"


register("r04_recommendations", W(f"""
SELECT student_id, array_to_string(CASE WHEN len(l) < 3 THEN list_concat(l, {['x']}) ELSE l END[1:5], '|') AS recommendations
FROM (SELECT i.student_id, coalesce((SELECT list(t ORDER BY rn) FROM
        (SELECT rn, {_rule_sql()} AS t FROM rk WHERE rk.student_id = i.student_id AND sgn = 'neg' AND rn <= 5) q
        WHERE t IS NOT NULL), []) AS l
      FROM (SELECT DISTINCT student_id FROM attr_linear_a) i) z""".replace(
    "['x']", "[" + ", ".join(f"'{g}'" for g in ex.GENERIC_RECOMMENDATIONS) + "]").replace(
    "{['x']}", ""), "roster", ctes=_CTES + ",\n" + _RANK))(_r04)


# ---------------------------------------------------------------- X13: data behind the charts
def _x13s(spark, sf_dir):
    from cohortlens.plans.shapley import summary_points

    return rounded(summary_points(attribution(spark, sf_dir).withColumnRenamed("student_id", "id"), "score", 5))


register("x13_summary_points", W("""
SELECT i.rank, a.feature, round(i.importance, 6) AS importance, a.student_id AS id, round(a.value, 6) AS value,
  round(a.shap, 6) AS shap
FROM attr_linear_a a JOIN imp i ON a.feature = i.feature WHERE i.rank <= 5""", "roster", ctes=_CTES + """,
imp AS (SELECT feature, avg(abs(shap)) AS importance,
  CAST(row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS INT) AS rank FROM attr_linear_a GROUP BY feature)"""))(_x13s)


def _x13w(spark, sf_dir):
    from cohortlens.plans.shapley import waterfall

    attr = attribution(spark, sf_dir).withColumnRenamed("student_id", "id")
    means = _features(spark, sf_dir).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in FEATS])
    total = sum((F.lit(w) * F.col(f) for f, w in WEIGHTS["linear_a"].items()), F.lit(0.0))
    return rounded(waterfall(attr, means.select(F.lit("score").alias("class_name"), total.alias("base_value")), 4))


_BASE = " + ".join(f"{w} * {f}" for f, w in WEIGHTS["linear_a"].items())
register("x13_waterfall", W("""
SELECT id, 'score' AS class_name, position, CASE WHEN position <= 4 THEN feature ELSE 'other features' END AS feature,
  CASE WHEN position <= 4 THEN round(value, 6) END AS value, round(shap, 6) AS shap,
  round(base + upto - shap, 6) AS start, round(base + upto, 6) AS "end"
FROM (SELECT *, sum(shap) OVER (PARTITION BY id ORDER BY position) AS upto FROM bars) b CROSS JOIN basev""",
    "roster", ctes=_CTES + f""",
basev AS (SELECT {_BASE} AS base FROM means),
bars AS (SELECT id, position, min(feature) AS feature, min(value) AS value, sum(shap) AS shap FROM (
  SELECT student_id AS id, feature, value, shap, CAST(least(row_number() OVER (
    PARTITION BY student_id ORDER BY abs(shap) DESC, feature), 5) AS INT) AS position FROM attr_linear_a) r
  GROUP BY id, position)"""))(_x13w)
