"""Registered queries: encoding, scaling, full preparation, splits, folds, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import bands, encode, prepare, profile, split
from cohortlens.plans import sqlgen as sg
from cohortlens.plans.registry import register, rounded
from cohortlens.session import spread

W = fx.with_views
LOADER = ([-1, 9, 11, 14, 20], ["Critical", "High", "Medium", "Low"])
STR = sg.ROSTER_STRING
NUM = sg.ROSTER_NUMERIC


def _codes_sql(src, cols, where=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code "
        f"FROM (SELECT DISTINCT coalesce({sg.q(c)}, 'unknown') AS v FROM {src} {where} "
        f"UNION SELECT 'unknown') t" for c in cols)


def _e01(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    return encode.fit_label_codes(r, STR)


register("e01_fit_label_codes", W(_codes_sql("roster", STR), "roster"))(_e01)


def _e02(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    train = r.filter(F.col("student_id") % 5 != 0)
    mapping = encode.fit_label_codes(train, STR)
    return encode.apply_label_codes(r, mapping, STR).select("student_id", *STR)


register("e02_apply_label_codes", W(
    "SELECT r.student_id, " + ", ".join(
        f"coalesce(m_{c}.code, (SELECT code FROM maps WHERE \"column\" = '{c}' AND value = 'unknown')) AS {sg.q(c)}"
        for c in STR) + " FROM roster r " + " ".join(
        f"LEFT JOIN (SELECT value, code FROM maps WHERE \"column\" = '{c}') m_{c} ON r.{sg.q(c)} = m_{c}.value"
        for c in STR),
    "roster", ctes=f"maps AS ({_codes_sql('roster', STR, 'WHERE student_id % 5 <> 0')})"))(_e02)


def _e03(spark, sf_dir):
    r = fx.roster(spark, sf_dir).select("student_id", *STR)
    return encode.plain_label_encode(r, STR)


register("e03_plain_label_encode", W(
    "SELECT student_id, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({sg.q(c)}, 'nan')) - 1 AS INT) AS {sg.q(c)}" for c in STR)
    + " FROM roster", "roster"))(_e03)


_ONEHOT = {"Mjob": ["at_home", "health", "other", "services", "teacher"],
           "Fjob": ["at_home", "health", "other", "services", "teacher"],
           "reason": ["course", "home", "other", "reputation"],
           "guardian": ["father", "mother", "other"]}


def _e04(spark, sf_dir):
    r = bands.risk_bands(fx.roster(spark, sf_dir).drop("G1", "G2"), "G3", "loader")
    return encode.prepare_features(r, "risk_level")


def _e04_sql():
    binary = [c for c in STR if c not in _ONEHOT]
    parts = ["student_id"]
    for c in binary:
        parts.append(
            f"CASE WHEN {sg.q(c)} IS NULL THEN -1 ELSE CAST((SELECT count(DISTINCT {sg.q(c)}) FROM roster x "
            f"WHERE x.{sg.q(c)} < roster.{sg.q(c)}) AS INT) END AS {sg.q(c)}")
    for c, vals in _ONEHOT.items():
        for v in vals:
            parts.append(f"coalesce({sg.q(c)} = '{v}', false) AS {sg.q(c + '_' + v)}")
    parts += [sg.q(c) for c in NUM if c not in ("G1", "G2", "G3")]
    parts.append(f"{sg.cut_sql('G3', *LOADER)} AS risk_level")
    return W(f"SELECT {', '.join(parts)} FROM roster", "roster")


register("e04_e05_prepare_features", _e04_sql())(_e04)


def _e07(spark, sf_dir):
    r = fx.roster(spark, sf_dir).select("student_id", *NUM)
    return rounded(encode.smart_scaling(r))


def _scale_sql(all_cols: bool):
    def one(c):
        if all_cols:
            e = (f"(CAST({sg.q(c)} AS DOUBLE) - st.{sg.q(c + '__m')}) / CASE WHEN st.{sg.q(c + '__p')} > 0 "
                 f"THEN st.{sg.q(c + '__p')} ELSE 1 END")
            return f"round({e}, 6) AS {sg.q(c)}"
        e = (f"CASE WHEN st.{sg.q(c + '__s')} > 1e-8 THEN (CAST({sg.q(c)} AS DOUBLE) - st.{sg.q(c + '__m')}) "
             f"/ st.{sg.q(c + '__p')} ELSE CAST({sg.q(c)} AS DOUBLE) END")
        return f"round(coalesce({e}, 0), 6) AS {sg.q(c)}"
    stats = ", ".join(f"avg({sg.q(c)}) AS {sg.q(c + '__m')}, stddev_samp({sg.q(c)}) AS {sg.q(c + '__s')}, "
                      f"stddev_pop({sg.q(c)}) AS {sg.q(c + '__p')}" for c in NUM)
    return W(f"SELECT student_id, {', '.join(one(c) for c in NUM)} FROM roster CROSS JOIN st",
             "roster", ctes=f"st AS (SELECT {stats} FROM roster)")


register("e07_smart_scaling", _scale_sql(False))(_e07)


def _e09(spark, sf_dir):
    from cohortlens.operators.clean import fill_mean
    r = fill_mean(fx.roster(spark, sf_dir).select("student_id", *NUM))
    return rounded(encode.scale_features(r))


def _e09_sql():
    filled = "filled AS (SELECT student_id, " + ", ".join(
        f"coalesce(CAST({sg.q(c)} AS DOUBLE), (SELECT avg({sg.q(c)}) FROM roster)) AS {sg.q(c)}"
        for c in NUM) + " FROM roster)"
    stats = ", ".join(f"avg({sg.q(c)}) AS {sg.q(c + '__m')}, stddev_pop({sg.q(c)}) AS {sg.q(c + '__p')}"
                      for c in NUM)
    cols = ", ".join(
        f"round((f.{sg.q(c)} - st.{sg.q(c + '__m')}) / CASE WHEN st.{sg.q(c + '__p')} > 0 "
        f"THEN st.{sg.q(c + '__p')} ELSE 1 END, 6) AS {sg.q(c)}" for c in NUM)
    return W(f"SELECT f.student_id, {cols} FROM filled f CROSS JOIN st", "roster",
             ctes=f"{filled},\nst AS (SELECT {stats} FROM filled)")


register("e09_scale_features", _e09_sql())(_e09)


def _e11(spark, sf_dir):
    return rounded(prepare.preprocess(fx.roster(spark, sf_dir)))


_P_CTES, _P, _P_FEATS = sg.preprocess_ctes()
register("e11_preprocess", W(
    f"SELECT student_id, round(label, 6) AS label, {sg.rounded(_P_FEATS)} FROM {_P}",
    "roster", ctes=_P_CTES))(_e11)


def _a21(spark, sf_dir):
    prep = prepare.preprocess(fx.roster(spark, sf_dir))
    lab = bands.risk_bands(prep, "label", "quantile", out="risk_class")
    return rounded(profile.distribution(lab, "risk_class"))


_QE = [f"(SELECT quantile_cont(label, {p}) FROM {_P})" for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
register("a21_class_distribution", W(f"""
SELECT risk_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM (
  SELECT CASE WHEN label >= {_QE[0]} AND label <= {_QE[1]} THEN 'Critical'
    WHEN label > {_QE[1]} AND label <= {_QE[2]} THEN 'High'
    WHEN label > {_QE[2]} AND label <= {_QE[3]} THEN 'Medium'
    WHEN label > {_QE[3]} AND label <= {_QE[4]} THEN 'Low' ELSE 'Medium' END AS risk_class
  FROM {_P}) t GROUP BY risk_class""", "roster", ctes=_P_CTES))(_a21)


# ---------------------------------------------------------------- splits, folds, weights
def _banded(spark, sf_dir):
    return bands.risk_bands(fx.roster(spark, sf_dir), "G3", "loader").select("student_id", "risk_level")


_RANKED = f"""ranked AS (
  SELECT student_id, risk_level,
    row_number() OVER (PARTITION BY risk_level ORDER BY md5('42:' || CAST(student_id AS VARCHAR)), student_id) - 1 AS r,
    count(*) OVER (PARTITION BY risk_level) AS n
  FROM (SELECT student_id, {sg.cut_sql('G3', *LOADER)} AS risk_level FROM roster) b)"""


def _m01(spark, sf_dir):
    return split.stratified_split(_banded(spark, sf_dir), "risk_level", "student_id")


register("m01_stratified_split", W("""
SELECT student_id, risk_level, CASE WHEN r < n * 0.7 THEN 'train' WHEN r < n * 0.8 THEN 'val' ELSE 'test' END AS split
FROM ranked""", "roster", ctes=_RANKED))(_m01)


def _m02(spark, sf_dir):
    return split.stratified_folds(_banded(spark, sf_dir), "risk_level", "student_id", k=5)


register("m02_stratified_folds", W(
    "SELECT student_id, risk_level, CAST(r % 5 AS INT) AS fold FROM ranked", "roster", ctes=_RANKED))(_m02)


def _m05(spark, sf_dir):
    return rounded(split.class_weights(_banded(spark, sf_dir), "risk_level"))


register("m05_class_weights", W(f"""
SELECT risk_level, count(*) AS n_c,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM (SELECT {sg.cut_sql('G3', *LOADER)} AS risk_level FROM roster) b GROUP BY risk_level""", "roster"))(_m05)


# ---------------------------------------------------------------- E10: statistics of the training split only
def _e10(spark, sf_dir):
    r = fx.roster(spark, sf_dir)
    dealt = r.join(split.stratified_split(_banded(spark, sf_dir), "risk_level", "student_id").drop("risk_level"), "student_id")
    dealt = spread(dealt, "split-roster")
    model = prepare.RosterPreparation(fit_on="train").fit(dealt)
    out = model.prepare(dealt)
    return rounded(out.withColumn("class_name", model.class_name()))


_T_CTES, _T, _T_FEATS = sg.preprocess_ctes("dealt", split=True)
_TE = [f"(SELECT quantile_cont(label, {p}) FROM {_T} WHERE split = 'train')" for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
register("e10_train_fitted_preparation", W(f"""
SELECT student_id, split, round(label, 6) AS label, {sg.rounded(_T_FEATS)},
  CASE WHEN label >= {_TE[0]} AND label <= {_TE[1]} THEN 'Critical'
    WHEN label > {_TE[1]} AND label <= {_TE[2]} THEN 'High'
    WHEN label > {_TE[2]} AND label <= {_TE[3]} THEN 'Medium'
    WHEN label > {_TE[3]} AND label <= {_TE[4]} THEN 'Low' ELSE 'Medium' END AS class_name
FROM {_T}""", "roster", ctes=_RANKED + """,
dealt AS (SELECT r.*, CASE WHEN k.r < k.n * 0.7 THEN 'train' WHEN k.r < k.n * 0.8 THEN 'val' ELSE 'test' END AS split
  FROM roster r JOIN ranked k ON r.student_id = k.student_id),
""" + _T_CTES))(_e10)
