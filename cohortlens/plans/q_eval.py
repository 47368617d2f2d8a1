"""Registered queries: evaluation metrics, ROC / AUC, model votes and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import metrics as mt
from cohortlens.operators import risk
from cohortlens.operators import split
from cohortlens.operators.bands import loader_band
from cohortlens.plans import sqlgen as sg
from cohortlens.plans.registry import register, rounded

W = fx.with_views
CLASSES = ["Critical", "High", "Low", "Medium"]   # label codes 0..3 (alphabetical)

_PC = """labs AS (SELECT y_true AS l FROM preds WHERE y_true IS NOT NULL
              UNION SELECT y_pred FROM preds WHERE y_pred IS NOT NULL),
pc AS (SELECT l AS label,
  (SELECT count(*) FROM preds WHERE y_true = l) AS support,
  (SELECT count(*) FROM preds WHERE y_true = l AND y_pred = l) AS tp,
  (SELECT count(*) FROM preds WHERE y_pred = l) AS predicted FROM labs),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0 END AS f1 FROM pm)"""


def _preds(spark, sf_dir):
    return fx.view(spark, sf_dir, "preds")


def _votes(spark, sf_dir):
    return fx.view(spark, sf_dir, "votes")


def _v01(spark, sf_dir):
    return rounded(mt.summary_metrics(_preds(spark, sf_dir)))


register("v01_summary_metrics", W("""
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1 FROM pf""", "preds", ctes=_PC))(_v01)


def _v02(spark, sf_dir):
    return mt.confusion(_preds(spark, sf_dir))


register("v02_confusion_matrix", W("""
SELECT t.l AS true_label, p.l AS pred_label,
  (SELECT count(*) FROM preds WHERE y_true = t.l AND y_pred = p.l) AS n
FROM labs t CROSS JOIN labs p""", "preds", ctes=_PC))(_v02)


def _v03(spark, sf_dir):
    return rounded(mt.classification_report(_preds(spark, sf_dir)))


register("v03_classification_report", W("""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf""",
    "preds", ctes=_PC))(_v03)


def _scored(spark, sf_dir):
    v, p = _votes(spark, sf_dir), _preds(spark, sf_dir).select("student_id", "y_true")
    return v.join(p, "student_id")


_SCORED = "scored AS (SELECT v.*, p.y_true FROM votes v JOIN preds p ON v.student_id = p.student_id)"


def _v04(spark, sf_dir):
    return mt.accuracy_percent(_scored(spark, sf_dir), "y_true", "prediction")


register("v04_accuracy_percent", W("""
SELECT model, round(avg(CASE WHEN coalesce(y_true = prediction, false) THEN 1.0 ELSE 0.0 END) * 100, 1) AS accuracy_pct,
  count(*) AS n FROM scored GROUP BY model""", "votes", "preds", ctes=_SCORED))(_v04)


def _v05(spark, sf_dir):
    return mt.sample_comparisons(_scored(spark, sf_dir), "student_id", "y_true", "prediction", 10)


register("v05_sample_comparisons", W("""
SELECT model, student_id, y_true AS actual, prediction AS predicted,
  CASE WHEN y_true = prediction THEN 'Correct' ELSE 'Wrong' END AS result
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY student_id) AS rn FROM scored) t
WHERE rn <= 10""", "votes", "preds", ctes=_SCORED))(_v05)


def _v06(spark, sf_dir):
    return rounded(mt.roc_points(fx.view(spark, sf_dir, "scores")))


_ROC = """per AS (SELECT score AS th, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY score),
tot AS (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM per),
cum AS (SELECT th, sum(pos) OVER (ORDER BY th DESC) AS cp, sum(neg) OVER (ORDER BY th DESC) AS cn FROM per),
pts AS (SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
        UNION ALL SELECT th, cn / N, cp / P FROM cum CROSS JOIN tot)"""

register("v06_roc_points", W(
    "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts", "scores",
    ctes=_ROC.format(src="scores")))(_v06)


def _v06b(spark, sf_dir):
    return rounded(mt.auc(fx.view(spark, sf_dir, "scores")))


_TRAP = """SELECT round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, (SELECT P FROM tot) AS P,
  (SELECT N FROM tot) AS N
FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC) AS lf,
             lag(tpr) OVER (ORDER BY threshold DESC) AS lt FROM pts) t WHERE lf IS NOT NULL"""
register("v06_auc", W(_TRAP, "scores", ctes=_ROC.format(src="scores")))(_v06b)


def _stacked(spark, sf_dir):
    """One row per model, student and class: whether it is the true class, and its score."""
    s = _scored(spark, sf_dir).filter(F.col("probability").isNotNull())
    cls = F.array(*[F.lit(c) for c in CLASSES])
    e = s.select("model", "student_id", "y_true", F.posexplode("probability").alias("k", "score"))
    class_name = F.element_at(cls, F.col("k") + 1)
    return e.select("model", class_name.alias("class_name"), (class_name == F.col("y_true")).cast("int").alias("y"), "score")


_STACKED = _SCORED + """,
stacked AS (SELECT model, list_extract(['Critical', 'High', 'Low', 'Medium'], k) AS class_name,
    CAST(list_extract(['Critical', 'High', 'Low', 'Medium'], k) = y_true AS INT) AS y, p AS score
  FROM (SELECT model, y_true, unnest(probability) AS p, unnest(range(1, len(probability) + 1)) AS k
        FROM scored WHERE probability IS NOT NULL) u)"""


def _grouped_auc_sql(keys: str) -> tuple[str, str]:
    """(body, CTEs) of the trapezoid area under the ROC points per group of ``keys``."""
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    of_c = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    body = f"""
SELECT {keys}, round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, max(P) AS P, max(N) AS N
FROM (SELECT {keys}, fpr, tpr, P, N, lag(fpr) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS lf,
        lag(tpr) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS lt FROM pts) t
WHERE lf IS NOT NULL GROUP BY {keys}"""
    ctes = f"""per AS (SELECT {keys}, score AS th, sum(y) AS pos, sum(1 - y) AS neg FROM stacked GROUP BY {keys}, score),
tot AS (SELECT {keys}, CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM per GROUP BY {keys}),
cum AS (SELECT {keys}, th, sum(pos) OVER (PARTITION BY {keys} ORDER BY th DESC) AS cp,
               sum(neg) OVER (PARTITION BY {keys} ORDER BY th DESC) AS cn FROM per),
pts AS (SELECT {keys}, CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr, P, N FROM tot
        UNION ALL SELECT {of_c}, th, cn / N, cp / P, P, N FROM cum c JOIN tot t ON {on})"""
    return body, _STACKED + ",\n" + ctes


def _v07(spark, sf_dir):
    return rounded(mt.auc(_stacked(spark, sf_dir), by=["model"]))


_BODY, _CTES = _grouped_auc_sql("model")
register("v07_micro_auc", W(_BODY, "votes", "preds", ctes=_CTES))(_v07)


_SPLIT = f"""ranked AS (
  SELECT student_id, row_number() OVER (PARTITION BY risk_level ORDER BY md5('42:' || CAST(student_id AS VARCHAR)), student_id) - 1 AS r,
    count(*) OVER (PARTITION BY risk_level) AS n
  FROM (SELECT student_id, {sg.cut_sql('G3', [-1, 9, 11, 14, 20], ['Critical', 'High', 'Medium', 'Low'])} AS risk_level FROM roster) b),
splits AS (SELECT student_id, CASE WHEN r < n * 0.7 THEN 'train' WHEN r < n * 0.8 THEN 'val' ELSE 'test' END AS split FROM ranked),
acc AS (SELECT s.model, sp.split, avg(CASE WHEN coalesce(s.y_true = s.prediction, false) THEN 1.0 ELSE 0.0 END) AS a
        FROM scored s JOIN splits sp ON s.student_id = sp.student_id GROUP BY s.model, sp.split)"""


def _with_split(spark, sf_dir):
    """Scored votes with the split of each student."""
    r = fx.roster(spark, sf_dir)
    sp = split.stratified_split(r.select("student_id", loader_band("G3").alias("risk_level")),
                                "risk_level", "student_id").select("student_id", "split")
    return _scored(spark, sf_dir).join(sp, "student_id")


def _folded(spark, sf_dir):
    """The training rows' stored predictions with their fold: (model, fold, y_true, y_pred)."""
    r = fx.roster(spark, sf_dir)
    sp = split.stratified_split(r.select("student_id", loader_band("G3").alias("risk_level")),
                                "risk_level", "student_id", k_folds=5).select("student_id", "split", "fold")
    held = _scored(spark, sf_dir).join(sp.filter("split = 'train'"), "student_id")
    return held.select("model", "fold", "y_true", F.col("prediction").alias("y_pred"))


def _m04s(spark, sf_dir):
    from cohortlens.plans.models import cv_summary

    return rounded(cv_summary(_folded(spark, sf_dir)))


_CV = """held AS (SELECT s.model, CAST(k.r % 5 AS INT) AS fold, s.y_true, s.prediction
  FROM scored s JOIN ranked k ON s.student_id = k.student_id WHERE k.r < k.n * 0.7),
labels AS (SELECT DISTINCT model, fold, l FROM (SELECT model, fold, y_true AS l FROM held UNION ALL SELECT model, fold, prediction FROM held)),
cls AS (SELECT b.model, b.fold, b.l,
  (SELECT count(*) FROM held h WHERE h.model = b.model AND h.fold = b.fold AND h.y_true IS NOT DISTINCT FROM b.l) AS support,
  (SELECT count(*) FROM held h WHERE h.model = b.model AND h.fold = b.fold AND h.prediction IS NOT DISTINCT FROM b.l) AS predicted,
  (SELECT count(*) FROM held h WHERE h.model = b.model AND h.fold = b.fold AND h.prediction = b.l AND h.y_true = b.l) AS tp
  FROM labels b),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r
  FROM cls WHERE l IS NOT NULL OR support > 0),
folds AS (SELECT model, fold, sum(tp) / sum(support) AS a, sum(p * support) / sum(support) AS p, sum(r * support) / sum(support) AS r,
  sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support) AS f1 FROM pr GROUP BY model, fold)"""

register("m04_cv_summary", W("""
SELECT model, round(avg(a), 6) AS cv_mean, round(stddev_pop(a), 6) AS cv_std, round(avg(p), 6) AS cv_precision,
  round(avg(r), 6) AS cv_recall, round(avg(f1), 6) AS cv_f1 FROM folds GROUP BY model""",
    "votes", "preds", ctes=_SCORED + ",\n" + _SPLIT + ",\n" + _CV))(_m04s)


def _m14s(spark, sf_dir):
    from cohortlens.plans.models import CLASSES, soft_vote

    v = fx.view(spark, sf_dir, "votes").join(fx.view(spark, sf_dir, "preds").select("student_id", "y_true"), "student_id")
    members = [v.filter(F.col("model") == m).select(F.col("student_id").alias("id"), F.lit("all").alias("split"), "y_true",
                                                    "probability") for m in ("m1", "m2", "m3")]
    e = soft_vote(members, CLASSES)
    return rounded(e.select("id", "y_true", "y_pred", *[F.col("probability")[i].alias(f"p{i}") for i in range(4)]))


register("m14_soft_vote", W("""
SELECT id, y_true, ['Critical', 'High', 'Low', 'Medium'][list_position(l, list_max(l))] AS y_pred,
  round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3
FROM (SELECT *, [round(p0, 12), round(p1, 12), round(p2, 12), round(p3, 12)] AS l FROM (
  SELECT v.student_id AS id, p.y_true, avg(v.probability[1]) AS p0, avg(v.probability[2]) AS p1,
    avg(v.probability[3]) AS p2, avg(v.probability[4]) AS p3
  FROM votes v JOIN preds p ON v.student_id = p.student_id GROUP BY v.student_id, p.y_true) a) b""", "votes", "preds"))(_m14s)


def _v08(spark, sf_dir):
    from cohortlens.plans.models import cv_summary

    ok = F.coalesce(F.col("y_true") == F.col("prediction"), F.lit(False)).cast("double")
    wide = _with_split(spark, sf_dir).groupBy("model").pivot("split", ["train", "val", "test"]).agg(F.avg(ok))
    cv = cv_summary(_folded(spark, sf_dir)).select("model", F.col("cv_mean").alias("cv"), "cv_std")
    both = wide.join(cv, "model", "left")
    return rounded(both.select("model", *[F.coalesce(F.col(k), F.lit(0.0)).alias(f"{k}_accuracy")
                                          for k in ("train", "val", "test", "cv")],
                               F.coalesce("cv_std", F.lit(0.0)).alias("cv_std")))


register("v08_model_comparison", W("""
SELECT a.model, round(coalesce(max(a) FILTER (WHERE split = 'train'), 0), 6) AS train_accuracy,
  round(coalesce(max(a) FILTER (WHERE split = 'val'), 0), 6) AS val_accuracy,
  round(coalesce(max(a) FILTER (WHERE split = 'test'), 0), 6) AS test_accuracy,
  round(coalesce(any_value(c.m), 0), 6) AS cv_accuracy, round(coalesce(any_value(c.s), 0), 6) AS cv_std
FROM acc a LEFT JOIN (SELECT model, avg(a) AS m, stddev_pop(a) AS s FROM folds GROUP BY model) c ON a.model = c.model
GROUP BY a.model""", "votes", "preds", ctes=_SCORED + ",\n" + _SPLIT + ",\n" + _CV))(_v08)


def _v09(spark, sf_dir):
    a = mt.accuracy_percent(_scored(spark, sf_dir), "y_true", "prediction")
    g, pos = mt.grade_model()
    return a.select("model", "accuracy_pct", g, pos)


register("v09_model_grade", W("""
SELECT model, accuracy_pct, CASE WHEN accuracy_pct >= 80 THEN 'good' WHEN accuracy_pct >= 70 THEN 'warning'
  ELSE 'bad' END AS grade, accuracy_pct >= 75 AS positive
FROM (SELECT model, round(avg(CASE WHEN coalesce(y_true = prediction, false) THEN 1.0 ELSE 0.0 END) * 100, 1) AS accuracy_pct
      FROM scored GROUP BY model) t""", "votes", "preds", ctes=_SCORED))(_v09)


def _l04(spark, sf_dir):
    s = _with_split(spark, sf_dir).filter(F.col("split") == "test")
    ok = F.coalesce(F.col("y_true") == F.col("prediction"), F.lit(False)).cast("double")
    acc = s.groupBy("model").agg(F.avg(ok).alias("test_accuracy"))
    return rounded(acc.orderBy(F.desc("test_accuracy"), F.asc("model")).limit(1))


register("l04_best_model", W("""
SELECT model, round(a, 6) AS test_accuracy FROM acc WHERE split = 'test' ORDER BY a DESC, model LIMIT 1""",
    "votes", "preds", ctes=_SCORED + ",\n" + _SPLIT))(_l04)


# ---------------------------------------------------------------- votes
def _r05(spark, sf_dir):
    return rounded(risk.consensus(_votes(spark, sf_dir), model_order=["m1", "m2", "m3"]))


register("r05_r06_consensus", W("""
SELECT c.student_id, c.consensus, round(f.confidence, 6) AS confidence, f.n_valid FROM
  (SELECT student_id, prediction AS consensus FROM (
     SELECT student_id, prediction, row_number() OVER (PARTITION BY student_id
              ORDER BY count(*) DESC, min(CASE model WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 ELSE 3 END) DESC) AS rn
     FROM votes WHERE error IS NULL AND prediction IS NOT NULL GROUP BY student_id, prediction) t WHERE rn = 1) c
JOIN (SELECT student_id, coalesce(avg(CASE WHEN list_max(probability) > 0 THEN list_max(probability) END), 0) AS confidence,
        count(*) AS n_valid FROM votes WHERE error IS NULL AND prediction IS NOT NULL GROUP BY student_id) f
  ON c.student_id = f.student_id""", "votes"))(_r05)


def _r07(spark, sf_dir):
    return rounded(risk.vote_lines(_votes(spark, sf_dir)))


register("r07_vote_lines", W("""
SELECT student_id, model, upper(substr(model, 1, 1)) || substr(model, 2) AS model_name,
  coalesce(prediction, 'Error') AS prediction, round(coalesce(list_max(probability) * 100, 0), 6) AS confidence, error
FROM votes""", "votes"))(_r07)


def _x12(spark, sf_dir):
    v = _votes(spark, sf_dir).filter(F.col("probability").isNotNull())
    cls = F.array(*[F.lit(c) for c in CLASSES])
    e = v.select("student_id", "model", F.posexplode("probability").alias("k", "probability"))
    return rounded(e.select("student_id", "model", F.element_at(cls, F.col("k") + 1).alias("class_name"),
                            "probability"))


register("x12_class_probabilities", W("""
SELECT student_id, model, list_extract(['Critical', 'High', 'Low', 'Medium'], k) AS class_name, round(p, 6) AS probability
FROM (SELECT student_id, model, unnest(probability) AS p, unnest(range(1, len(probability) + 1)) AS k
      FROM votes WHERE probability IS NOT NULL) u""", "votes"))(_x12)


def _e06(spark, sf_dir):
    from cohortlens.operators.labels import decode, encode_labels
    p = _preds(spark, sf_dir)
    enc, classes = encode_labels(p, "y_true", "true_code")
    return enc.select("student_id", "y_true", "true_code",
                      decode("true_code", classes).alias("decoded"),
                      decode(F.col("true_code") + 2, classes).alias("shifted_decoded"))


_DEC = "coalesce(list_extract(['Critical', 'High', 'Low', 'Medium'], {c} + 1), 'Unknown')"
register("e06_label_encode_decode", W(f"""
SELECT student_id, y_true, true_code, {_DEC.format(c='true_code')} AS decoded,
  {_DEC.format(c='true_code + 2')} AS shifted_decoded
FROM (SELECT student_id, y_true, CAST(dense_rank() OVER (ORDER BY y_true) - 1 AS INT) AS true_code FROM preds) t""",
    "preds"))(_e06)


def _m17(spark, sf_dir):
    from cohortlens.operators.labels import encode_labels, one_hot_probability
    p = _preds(spark, sf_dir)
    enc, classes = encode_labels(p, "y_pred", "pred_code", classes=CLASSES)
    return enc.select("student_id", F.array_join(one_hot_probability("pred_code", len(classes)), "|")
                      .alias("probability"))


register("m17_probability_fallback", W("""
SELECT student_id, array_to_string(list_transform(range(4), lambda i: CASE WHEN i = code THEN 1.0 ELSE 0.0 END), '|') AS probability
FROM (SELECT student_id, list_position(['Critical', 'High', 'Low', 'Medium'], y_pred) - 1 AS code FROM preds) t""",
    "preds"))(_m17)


def _v06c(spark, sf_dir):
    return rounded(mt.auc(_stacked(spark, sf_dir), by=["model", "class_name"]))


_BODY, _CTES = _grouped_auc_sql("model, class_name")
register("v06_per_class_auc", W(_BODY, "votes", "preds", ctes=_CTES))(_v06c)
