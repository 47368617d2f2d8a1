"""Registered queries over the roster: cleaning, features, bands, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import bands, clean, features, risk
from cohortlens.plans import sqlgen as sg
from cohortlens.plans.registry import register, rounded

W = fx.with_views
LOADER = ([-1, 9, 11, 14, 20], ["Critical", "High", "Medium", "Low"])
_AF_CTES, _AF, _AF_NUM = sg.advanced_features_ctes()


# ---------------------------------------------------------------- flagship
def risk_summary(spark, sf_dir):
    """Slice 0: roster -> clean -> features -> clean -> loader band -> per-level summary."""
    df = features.advanced_features(fx.roster(spark, sf_dir))
    banded = df.withColumn("risk_level", bands.loader_band("G3"))
    return rounded(banded.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n_students"),
        F.avg("risk_composite").alias("avg_risk_composite"),
        F.avg("G3").alias("avg_grade")))


register("s00_risk_summary", W(f"""
SELECT {sg.cut_sql('G3', *LOADER)} AS risk_level,
  count(*) AS n_students, round(avg(risk_composite), 6) AS avg_risk_composite,
  round(avg(G3), 6) AS avg_grade
FROM {_AF} GROUP BY 1""", "roster", ctes=_AF_CTES))(risk_summary)


# ---------------------------------------------------------------- cleaning
def _p10(spark, sf_dir):
    df = clean.clean(fx.roster(spark, sf_dir))
    return rounded(df.select("student_id", *sg.ROSTER_NUMERIC))


_c, _n = sg.clean_ctes("roster", sg.ROSTER_NUMERIC, ["student_id"], "c1")
register("p10_clean", W(f"SELECT student_id, {sg.rounded(sg.ROSTER_NUMERIC)} FROM {_n}",
                        "roster", ctes=_c))(_p10)


def _f16(spark, sf_dir):
    df = features.advanced_features(fx.roster(spark, sf_dir))
    return rounded(df)


register("f16_advanced_features", W(
    f"SELECT student_id, {', '.join(sg.q(c) for c in sg.ROSTER_STRING + sg.FEATURE_STRING)}, "
    f"{sg.rounded(_AF_NUM)} FROM {_AF}", "roster", ctes=_AF_CTES))(_f16)


# ---------------------------------------------------------------- dashboard
def _b06(spark, sf_dir):
    d = risk.dashboard(fx.roster(spark, sf_dir))
    return d.select("student_id", "level", "display_id",
                    F.array_join("factors", "|").alias("factors"))


_FACTORS = """list_filter(list_value(
    CASE WHEN failures > 0 THEN 'Past Failures' END,
    CASE WHEN absences > 5 THEN 'Frequent Absences' END,
    CASE WHEN studytime <= 1 THEN 'Low Study Time' END,
    CASE WHEN goout >= 4 THEN 'High Social Activity' END,
    CASE WHEN Dalc >= 3 OR Walc >= 3 THEN 'Alcohol Consumption' END,
    CASE WHEN schoolsup = 'no' THEN 'No School Support' END,
    CASE WHEN famsup = 'no' THEN 'No Family Support' END), lambda x: x IS NOT NULL)[1:3]"""

register("b06_dashboard", W(f"""
SELECT student_id, level, 'Student #' || CAST(student_id AS VARCHAR) AS display_id,
  array_to_string(CASE WHEN level = 'low' AND len(f) = 0 THEN ['Strong Performance'] ELSE f END, '|') AS factors
FROM (SELECT *, CASE WHEN TRY_CAST(G3 AS DOUBLE) <= 9 THEN 'high'
                     WHEN TRY_CAST(G3 AS DOUBLE) <= 14 THEN 'medium'
                     WHEN G3 IS NOT NULL THEN 'low' END AS level,
             {_FACTORS} AS f FROM roster) t
WHERE level IS NOT NULL""", "roster"))(_b06)


def _a17(spark, sf_dir):
    return risk.dashboard_totals(fx.roster(spark, sf_dir))


register("a17_dashboard_totals", W("""
SELECT count(*) AS total_students,
  count(*) FILTER (WHERE G3 <= 9) AS high_risk_count,
  count(*) FILTER (WHERE G3 > 9 AND G3 <= 14) AS medium_risk_count,
  count(*) FILTER (WHERE G3 > 14) AS low_risk_count
FROM roster""", "roster"))(_a17)


# ---------------------------------------------------------------- projections and cleaning steps
def _p01(spark, sf_dir):
    return fx.roster(spark, sf_dir).drop("G1", "G2", "not_a_column")


register("p01_drop_columns", W("SELECT * EXCLUDE (G1, G2) FROM roster", "roster"))(_p01)


def _p04(spark, sf_dir):
    from cohortlens.schema import require_column
    df = fx.roster(spark, sf_dir).drop("G1", "G2")
    require_column(df, "G3")
    feats = [c for c in df.columns if c not in ("student_id", "G3")]
    return df.select("student_id", *feats, F.col("G3").cast("double").alias("label"))


register("p04_split_target", W(
    "SELECT * EXCLUDE (G1, G2, G3), CAST(G3 AS DOUBLE) AS label FROM roster", "roster"))(_p04)


def _p05(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    raw = F.concat(F.col("G3").cast("string"),
                   F.when(F.col("student_id") % 50 == 0, F.lit("x")).otherwise(F.lit("")))
    return clean.to_numeric(r.select("student_id", raw.alias("g3_text")), "g3_text")


register("p05_to_numeric", W("""
SELECT student_id, TRY_CAST(CAST(G3 AS VARCHAR) || CASE WHEN student_id % 50 = 0 THEN 'x' ELSE '' END
  AS DOUBLE) AS g3_text FROM roster""", "roster"))(_p05)


_SCORES_NONFINITE = """CASE WHEN doc_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE)
  WHEN doc_id % 11 = 0 THEN CAST('-Infinity' AS DOUBLE)
  WHEN doc_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE score END"""


def _p07(spark, sf_dir):
    s = fx.view(spark, sf_dir, "scores").select("doc_id", F.expr(_SCORES_NONFINITE).alias("x"))
    return rounded(clean.nonfinite_to_null(s, ["x"]))


register("p07_nonfinite_to_null", W(f"""
SELECT doc_id, round(CASE WHEN isinf(x) OR isnan(x) THEN NULL ELSE x END, 6) AS x
FROM (SELECT doc_id, {_SCORES_NONFINITE} AS x FROM scores) t""", "scores"))(_p07)


def _p08(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    cols = ["health", "absences", "age"]
    med = clean.fit_median_fill(r, cols)
    return rounded(clean.apply_median_fill(r, med).select("student_id", *cols))


register("p08_median_fill", W("""
SELECT student_id, round(coalesce(CAST(health AS DOUBLE), (SELECT median(health) FROM roster), 0), 6) AS health,
  round(coalesce(CAST(absences AS DOUBLE), (SELECT median(absences) FROM roster), 0), 6) AS absences,
  round(coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM roster), 0), 6) AS age
FROM roster""", "roster"))(_p08)


def _p09(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    cols = ["absences", "health", "G3", "failures"]
    return rounded(clean.apply_clip(r, clean.fit_clip_bounds(r, cols)).select(
        "student_id", *[F.col(c).cast("double").alias(c) for c in cols]))


def _clip_sql(c):
    lo = f"(SELECT quantile_cont({c}, 0.01) FROM roster)"
    hi = f"(SELECT quantile_cont({c}, 0.99) FROM roster)"
    return (f"round(CASE WHEN {c} IS NULL THEN NULL WHEN {hi} > {lo} THEN least(greatest(CAST({c} AS DOUBLE), {lo}), {hi}) "
            f"ELSE CAST({c} AS DOUBLE) END, 6) AS {c}")


register("p09_clip_quantiles", W(
    f"SELECT student_id, {', '.join(_clip_sql(c) for c in ['absences', 'health', 'G3', 'failures'])} FROM roster",
    "roster"))(_p09)


def _p11(spark, sf_dir):
    r = fx.roster(spark, sf_dir).select("student_id", "health", "absences")
    return rounded(clean.fill_mean(r))


register("p11_mean_fill", W("""
SELECT student_id, round(coalesce(CAST(health AS DOUBLE), (SELECT avg(health) FROM roster)), 6) AS health,
  round(coalesce(CAST(absences AS DOUBLE), (SELECT avg(absences) FROM roster)), 6) AS absences
FROM roster""", "roster"))(_p11)


def _p12(spark, sf_dir):
    r = fx.roster(spark, sf_dir).select("student_id", "internet", "Mjob", "guardian")
    return clean.fill_mode(r)


def _mode_sql(c):
    return (f"coalesce({c}, (SELECT {c} FROM roster WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1), 'Unknown') AS {c}")


register("p12_mode_fill", W(
    f"SELECT student_id, {', '.join(_mode_sql(c) for c in ['internet', 'Mjob', 'guardian'])} FROM roster",
    "roster"))(_p12)


def _p13(spark, sf_dir):
    return clean.remove_outliers(fx.roster(spark, sf_dir)).select("student_id")


def _z_sql(c):
    m, s = f"(SELECT avg({c}) FROM roster)", f"(SELECT stddev_samp({c}) FROM roster)"
    return f"(NOT ({s} > 1e-8) OR {c} IS NULL OR abs(({c} - {m}) / {s}) < 3)"


register("p13_remove_outliers", W(
    f"SELECT student_id FROM roster WHERE {' AND '.join(_z_sql(c) for c in sg.ROSTER_NUMERIC)}",
    "roster"))(_p13)


def _p14(spark, sf_dir):
    s = fx.view(spark, sf_dir, "scores").select("doc_id", F.expr(_SCORES_NONFINITE).alias("x"),
                                                  F.when(F.col("y") == 0, None).otherwise(F.col("score")).alias("z"))
    return rounded(clean.final_safety(s, ["x", "z"]))


register("p14_final_safety", W(f"""
SELECT doc_id, round(CASE WHEN x IS NULL OR isinf(x) OR isnan(x) THEN 0 ELSE x END, 6) AS x,
  round(coalesce(z, 0), 6) AS z
FROM (SELECT doc_id, {_SCORES_NONFINITE} AS x, CASE WHEN y = 0 THEN NULL ELSE score END AS z FROM scores) t""",
    "scores"))(_p14)


def _p15(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    # exercise the rules on the real rows: blank out some fields, shift some ages
    r = r.withColumns({
        "sex": F.when(F.col("student_id") % 37 == 0, F.lit(None)).otherwise(F.col("sex")),
        "address": F.when(F.col("student_id") % 41 == 0, F.lit("")).otherwise(F.col("address")),
        "age": F.when(F.col("student_id") % 29 == 0, F.col("age") + 8).otherwise(F.col("age")),
    })
    return risk.validate_rows(r).select("student_id", "valid", "message")


register("p15_validate_rows", W("""
SELECT student_id, msg IS NULL AS valid, msg AS message FROM (
  SELECT student_id,
    CASE WHEN sex IS NULL OR sex = '' OR address IS NULL OR address = '' OR age IS NULL OR age = 0
              OR school IS NULL OR school = ''
         THEN 'Missing required fields: ' || concat_ws(', ',
              CASE WHEN age IS NULL OR age = 0 THEN 'age' END,
              CASE WHEN sex IS NULL OR sex = '' THEN 'sex' END,
              CASE WHEN school IS NULL OR school = '' THEN 'school' END,
              CASE WHEN address IS NULL OR address = '' THEN 'address' END)
         WHEN age < 15 OR age > 22 THEN 'Age must be between 15 and 22' END AS msg
  FROM (SELECT student_id, school,
          CASE WHEN student_id % 37 = 0 THEN NULL ELSE sex END AS sex,
          CASE WHEN student_id % 41 = 0 THEN '' ELSE address END AS address,
          CASE WHEN student_id % 29 = 0 THEN age + 8 ELSE age END AS age FROM roster) a) b""",
    "roster"))(_p15)


def _p16(spark, sf_dir):
    from cohortlens.functions.exprs import format_metric
    s = fx.view(spark, sf_dir, "scores")
    v = F.when(F.col("y") == 1, F.col("score") / 7)
    return s.select("doc_id", format_metric(v / 1000, "percentage").alias("pct"),
                    format_metric(v, "decimal").alias("dec"),
                    format_metric(v, "integer").alias("int_text"))


register("p16_format_metric", W("""
SELECT doc_id,
  CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.1f', v / 1000 * 100) || '%' END AS pct,
  CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.3f', v) END AS dec,
  CASE WHEN v IS NULL THEN 'N/A' ELSE CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR) END AS int_text
FROM (SELECT doc_id, CASE WHEN y = 1 THEN score / 7 END AS v FROM scores) t""", "scores"))(_p16)


def _p17(spark, sf_dir):
    from cohortlens.functions.exprs import display_name
    r = fx.roster(spark, sf_dir).select("Mjob").distinct()
    return r.select("Mjob", display_name("Mjob").alias("title_name"),
                    display_name("Mjob", upper=True).alias("upper_name"))


register("p17_display_name", W("""
SELECT Mjob,
  array_to_string(list_transform(string_split(replace(Mjob, '_', ' '), ' '),
                  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title_name,
  upper(replace(Mjob, '_', ' ')) AS upper_name
FROM (SELECT DISTINCT Mjob FROM roster) t""", "roster"))(_p17)


# ---------------------------------------------------------------- bands
def _b01(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    df = features.pass_fail_and_score(bands.risk_bands(r.drop("G1", "G2"), "G3", "loader"))
    return rounded(df.select("student_id", "risk_level", "pass_fail", "risk_score"))


register("b01_loader_bands", W(f"""
SELECT student_id, {sg.cut_sql('G3', *LOADER)} AS risk_level,
  CAST(G3 >= 10 AS INT) AS pass_fail, round(1 - G3 / 20, 6) AS risk_score FROM roster""",
    "roster"))(_b01)


def _b02(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return bands.risk_bands(a, "grade", "percent").select("event_id", "grade", "risk_level")


register("b02_percent_bands", W(f"""
SELECT event_id, grade, {sg.cut_sql('grade', [0, 50, 65, 80, 100], LOADER[1])} AS risk_level
FROM activity""", "activity"))(_b02)


def _b03(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    return bands.risk_bands(r, "G3", "threshold").select("student_id", "risk_level")


register("b03_threshold_bands", W(f"""
SELECT student_id, {sg.cut_sql('G3', [0, 8, 12, 15, 20], LOADER[1], "'Medium'")} AS risk_level
FROM roster""", "roster"))(_b03)


def _b04(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    return bands.risk_bands(r, "G3", "quantile").select("student_id", "risk_level")


_QE = [f"(SELECT quantile_cont(G3, {p}) FROM roster)" for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
register("b04_quantile_bands", W(f"""
SELECT student_id, CASE
  WHEN G3 >= {_QE[0]} AND G3 <= {_QE[1]} THEN 'Critical'
  WHEN G3 > {_QE[1]} AND G3 <= {_QE[2]} THEN 'High'
  WHEN G3 > {_QE[2]} AND G3 <= {_QE[3]} THEN 'Medium'
  WHEN G3 > {_QE[3]} AND G3 <= {_QE[4]} THEN 'Low' ELSE 'Medium' END AS risk_level
FROM roster""", "roster"))(_b04)


def _b05(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    return bands.risk_bands(r, "G3", "equal_width").select("student_id", "risk_level")


register("b05_equal_width_bands", W("""
SELECT student_id, CASE
  WHEN g > e0 - (e4 - e0) * 0.001 AND g <= e0 + 1 * ((e4 - e0) / 4) THEN 'Critical'
  WHEN g > e0 + 1 * ((e4 - e0) / 4) AND g <= e0 + 2 * ((e4 - e0) / 4) THEN 'High'
  WHEN g > e0 + 2 * ((e4 - e0) / 4) AND g <= e0 + 3 * ((e4 - e0) / 4) THEN 'Medium'
  WHEN g > e0 + 3 * ((e4 - e0) / 4) AND g <= e4 THEN 'Low' END AS risk_level
FROM (SELECT student_id, coalesce(CAST(G3 AS DOUBLE), (SELECT median(G3) FROM roster)) AS g,
        (SELECT CAST(min(G3) AS DOUBLE) FROM roster) AS e0,
        (SELECT CAST(max(G3) AS DOUBLE) FROM roster) AS e4 FROM roster) t""", "roster"))(_b05)


# ---------------------------------------------------------------- profile
from cohortlens.operators import profile as pf  # noqa: E402


def _a11(spark, sf_dir):
    return pf.shape_and_missing(fx.roster(spark, sf_dir))


register("a11_shape_missing", W(f"""
SELECT count(*) AS n_rows, 34 AS n_columns,
  CAST({' + '.join(f'count(*) FILTER (WHERE {sg.q(c)} IS NULL)' for c in ['student_id'] + sg.ROSTER_STRING + sg.ROSTER_NUMERIC)} AS BIGINT) AS n_missing
FROM roster""", "roster"))(_a11)


def _a12(spark, sf_dir):
    return rounded(pf.describe(fx.roster(spark, sf_dir), "G3"))


register("a12_describe_target", W("""
SELECT count(G3) AS n, round(avg(G3), 6) AS mean, round(stddev_samp(G3), 6) AS std,
  round(CAST(min(G3) AS DOUBLE), 6) AS min, round(quantile_cont(G3, 0.25), 6) AS p25,
  round(quantile_cont(G3, 0.5), 6) AS p50, round(quantile_cont(G3, 0.75), 6) AS p75,
  round(CAST(max(G3) AS DOUBLE), 6) AS max FROM roster""", "roster"))(_a12)


def _a13(spark, sf_dir):
    r = features.pass_fail_and_score(bands.risk_bands(fx.roster(spark, sf_dir), "G3", "loader"))
    a = pf.value_counts(r, "risk_level").select(F.lit("risk_level").alias("kind"),
                                                F.col("risk_level").alias("value"), "n")
    b = pf.value_counts(r, "pass_fail").select(F.lit("pass_fail").alias("kind"),
                                               F.col("pass_fail").cast("string").alias("value"), "n")
    return a.unionByName(b)


register("a13_value_counts", W(f"""
SELECT 'risk_level' AS kind, v AS value, count(*) AS n
FROM (SELECT {sg.cut_sql('G3', *LOADER)} AS v FROM roster) t WHERE v IS NOT NULL GROUP BY v
UNION ALL
SELECT 'pass_fail', CAST(CAST(G3 >= 10 AS INT) AS VARCHAR), count(*) FROM roster
WHERE G3 IS NOT NULL GROUP BY 2""", "roster"))(_a13)


def _a14(spark, sf_dir):
    return rounded(pf.histogram(fx.roster(spark, sf_dir), "G3", 20))


register("a14_histogram", W("""
SELECT b.bin, round(s.mn + b.bin * s.w, 6) AS lower, round(s.mn + (b.bin + 1) * s.w, 6) AS upper,
  coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INT) AS bin FROM range(20)) b
CROSS JOIN (SELECT CAST(min(G3) AS DOUBLE) AS mn, (CAST(max(G3) AS DOUBLE) - min(G3)) / 20 AS w FROM roster) s
LEFT JOIN (SELECT CAST(least(floor((G3 - s2.mn) / s2.w), 19) AS INT) AS bin, count(*) AS n
           FROM roster CROSS JOIN (SELECT CAST(min(G3) AS DOUBLE) AS mn,
                 (CAST(max(G3) AS DOUBLE) - min(G3)) / 20 AS w FROM roster) s2
           WHERE G3 IS NOT NULL GROUP BY 1) c ON b.bin = c.bin""", "roster"))(_a14)

CORR_FEATURES = ["age", "absences", "studytime", "failures", "famrel", "freetime", "goout", "health"]


def _a15(spark, sf_dir):
    return rounded(pf.correlations(fx.roster(spark, sf_dir), CORR_FEATURES, "G3"))


register("a15_correlations", W(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, G3), 6) AS corr FROM roster" for c in CORR_FEATURES),
    "roster"))(_a15)


def _a16(spark, sf_dir):
    return rounded(pf.group_mean(fx.roster(spark, sf_dir), "sex", "G3"))


register("a16_group_mean", W("SELECT sex, round(avg(G3), 6) AS mean_G3 FROM roster GROUP BY sex",
                             "roster"))(_a16)


def _a18(spark, sf_dir):
    r = fx.roster(spark, sf_dir).drop("student_id")
    return pf.distinct_counts(r)


register("a18_distinct_counts", W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {sg.q(c)}) AS n_distinct FROM roster"
    for c in sg.ROSTER_STRING + sg.ROSTER_NUMERIC), "roster"))(_a18)


def _a19(spark, sf_dir):
    d = risk.dashboard(fx.roster(spark, sf_dir))
    dist = pf.distribution(d, "level")
    from cohortlens.functions.exprs import display_name
    return rounded(dist.select("level", display_name("level", upper=True).alias("label"), "n", "pct"))


register("a19_risk_distribution", W("""
SELECT level, upper(replace(level, '_', ' ')) AS label, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS pct
FROM (SELECT CASE WHEN G3 <= 9 THEN 'high' WHEN G3 <= 14 THEN 'medium' WHEN G3 IS NOT NULL THEN 'low' END AS level
      FROM roster) t WHERE level IS NOT NULL GROUP BY level""", "roster"))(_a19)
