"""Evaluation (V1-V9) as aggregates over (truth, prediction) tables.

The confusion table is a keyed count (partial aggregation), so every metric
afterwards works on at most k x k rows. ROC / AUC aggregate per distinct
score first and then need a running total in score order; that running
total is computed per quantile bucket of the score with bucket offsets from
a tiny table, so no step puts all distinct scores into one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 10_000


def class_labels(df: DataFrame, *cols: str) -> list:
    """Sorted union of the label values in ``cols`` (bounded: checked <= MAX_CLASSES)."""
    u = None
    for c in cols:
        s = df.select(F.col(c).alias("label")).filter(F.col("label").isNotNull())
        u = s if u is None else u.unionByName(s)
    vals = [r["label"] for r in u.distinct().limit(MAX_CLASSES + 1).collect()]
    if len(vals) > MAX_CLASSES:
        raise ValueError("too many classes")
    return sorted(vals)


def confusion(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
              labels=None, by=()) -> DataFrame:
    """V2: (true, pred, n) for every pair of labels, zeros included.

    A missing label is no class: its rows are counted under null (only where
    there are any), so a row without a prediction is wrong, never left out."""
    by = list(by)
    labels = labels if labels is not None else class_labels(df, true_col, pred_col)
    counts = (df.groupBy(*by, F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
              .agg(F.count(F.lit(1)).alias("n")))
    lab = F.array(*[F.lit(v) for v in labels])
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = (keys.select(*by, F.explode(lab).alias("true_label"))
            .select(*by, "true_label", F.explode(lab).alias("pred_label")))
    g, c = grid.alias("g"), counts.alias("c")
    same = (F.col("g.true_label") == F.col("c.true_label")) & (F.col("g.pred_label") == F.col("c.pred_label"))
    for b in by:
        same = same & F.col(f"g.{b}").eqNullSafe(F.col(f"c.{b}"))
    full = g.join(c, same, "left").select(*[f"g.{b}" for b in by], "g.true_label", "g.pred_label",
                                          F.coalesce("c.n", F.lit(0)).alias("n"))
    return full.unionByName(counts.filter(F.col("true_label").isNull() | F.col("pred_label").isNull()))


def per_class(conf: DataFrame, by=()) -> DataFrame:
    """Per label: support, tp, predicted count, precision, recall, f1 (0 on 0/0)."""
    by = list(by)
    t = conf.groupBy(*by, F.col("true_label").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"))
    p = conf.groupBy(*by, F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    # null-safe on every key; nulls are a label only where truths are missing
    j = (t.select(*by, "label", "support", "tp", F.lit(0).alias("predicted"))
         .unionByName(p.select(*by, "label", F.lit(0).alias("support"), F.lit(0).alias("tp"), "predicted"))
         .groupBy(*by, "label").agg(*[F.sum(x).alias(x) for x in ("support", "tp", "predicted")])
         .filter(F.col("label").isNotNull() | (F.col("support") > 0)))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return j.withColumn("f1", f1)


def summary_metrics(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                    by=()) -> DataFrame:
    """V1: accuracy, weighted precision / recall / F1 (division by zero -> 0)."""
    by = list(by)
    pc = per_class(confusion(df, true_col, pred_col, by=by), by)
    return pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def classification_report(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """V3: per-class precision / recall / f1 / support, plus macro and weighted averages."""
    pc = per_class(confusion(df, true_col, pred_col)).select(
        "label", "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").alias("support"))
    s = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"), s.alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def accuracy_percent(df: DataFrame, true_col: str, pred_col: str, by=("model",)) -> DataFrame:
    """V4: accuracy in percent to 1 decimal, per model (a missing prediction is wrong)."""
    ok = F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.round(F.avg(ok) * 100, 1).alias("accuracy_pct"),
                               F.count(F.lit(1)).alias("n"))


def sample_comparisons(df: DataFrame, id_col: str, true_col: str, pred_col: str,
                       n: int = 10, by=("model",)) -> DataFrame:
    """First n rows by id per model with Correct / Wrong.

    ``row_number() <= n`` becomes a WindowGroupLimit: at most n rows per model
    leave each map task."""
    w = Window.partitionBy(*by).orderBy(id_col)
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .select(*by, id_col, F.col(true_col).alias("actual"), F.col(pred_col).alias("predicted"),
                    F.when(F.col(true_col) == F.col(pred_col), "Correct").otherwise("Wrong").alias("result")))


def grade_model(acc_pct_col: str = "accuracy_pct"):
    """V9: >= 80 good, >= 70 warning, else bad; >= 75 positive."""
    a = F.col(acc_pct_col)
    return (F.when(a >= 80, "good").when(a >= 70, "warning").otherwise("bad").alias("grade"),
            (a >= 75).alias("positive"))


# ---------------------------------------------------------------- running totals, ROC, AUC
def running_totals(df: DataFrame, order_col: str, cols, descending: bool = True,
                   rows_per_bucket: int = 1_000_000, by=()) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order_col`` order, per group of
    ``by`` (one row per distinct (group, order value) expected).

    Up to ``rows_per_bucket`` rows this is one ordered window per group.
    Beyond that, rows are cut into global quantile buckets of ``order_col``
    (a bounded boundary list, binary-searched by ``Bucketizer``; null orders
    lowest and NaN highest, as Spark sorts them). A small
    (group, bucket) total table gives each bucket's offset, and rows are
    ordered only within their (group, bucket)."""
    cols, by = list(cols), list(by)
    n = df.count()
    n_buckets = max(1, min(100_000, -(-n // rows_per_bucket)))
    x = F.col(order_col).cast("double")
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        cuts = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), probs, 10_000).alias("c")).first()["c"] or []
        splits = sorted(set([float("-inf")] + [float(c) for c in cuts] + [float("inf")]))
        # null and NaN share the outer buckets; inside a bucket the true value orders
        x = F.when(x.isNull(), float("-inf")).when(F.isnan(x), float("inf")).otherwise(x)
        b = Bucketizer(splits=splits, inputCol="_x", outputCol="_b")
        keyed = b.transform(df.withColumn("_x", x)).drop("_x")
    else:
        keyed = df.withColumn("_b", F.lit(0.0))
    wi = (Window.partitionBy(*by, "_b").orderBy(F.desc(order_col) if descending else F.asc(order_col))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if n_buckets == 1:
        # at most rows_per_bucket rows: one ordered pass per group, no offsets needed
        return keyed.select(*df.columns, *[F.sum(c).over(wi).alias(f"cum_{c}") for c in cols])
    bucket_order = F.desc("_b") if descending else F.asc("_b")
    tot = keyed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                   for c in cols])
    # without groups the offset table has at most 100k rows: broadcast it;
    # with groups its size is groups x buckets, left to AQE's runtime check
    # sums first, so a null group key needs no care in the window's output names
    k = keyed.select("*", *[F.sum(c).over(wi).alias(f"_w_{c}") for c in cols]).alias("k")
    o = (F.broadcast(offs) if not by else offs).alias("o")
    same = F.col("k._b") == F.col("o._b")
    for b in by:
        same = same & F.col(f"k.{b}").eqNullSafe(F.col(f"o.{b}"))
    return k.join(o, same).select(*[f"k.{c}" for c in df.columns],
                                  *[(F.col(f"o._o_{c}") + F.col(f"k._w_{c}")).alias(f"cum_{c}") for c in cols])


def roc_points(df: DataFrame, y_col: str = "y", score_col: str = "score", by=()) -> DataFrame:
    """V6: one ROC point per distinct score (descending) plus the origin:
    threshold, fpr, tpr (per group of ``by``). Intermediate collinear points
    are kept."""
    by = list(by)
    per = df.groupBy(*by, F.col(score_col).alias("threshold")).agg(
        F.sum(F.when(F.col(y_col) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y_col) == 1, 0).otherwise(1)).alias("neg"))
    run = running_totals(per, "threshold", ["pos", "neg"], descending=True, by=by)
    tot = per.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        # one row per group: joined on the group key (AQE broadcasts it when small)
        r, t = run.alias("r"), tot.alias("t")
        same = F.lit(True)
        for b in by:
            same = same & F.col(f"r.{b}").eqNullSafe(F.col(f"t.{b}"))
        pts = r.join(t, same).select("r.*", "t.P", "t.N")
        origin = tot.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                            F.lit(0.0).alias("tpr"))
        fpr = F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N"))
        tpr = F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P"))
    else:
        totals = tot.first()
        P, N = (totals["P"] or 0, totals["N"] or 0) if totals else (0, 0)
        pts = run
        origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        fpr = F.col("cum_neg") / F.lit(N) if N else F.lit(None).cast("double")
        tpr = F.col("cum_pos") / F.lit(P) if P else F.lit(None).cast("double")
    return origin.unionByName(pts.select(*by, "threshold", fpr.alias("fpr"), tpr.alias("tpr")))


def auc(df: DataFrame, y_col: str = "y", score_col: str = "score", by=()) -> DataFrame:
    """V6 AUC (per group of ``by``, e.g. per class one-vs-rest) = sum over
    distinct scores of pos_s * (negatives below s + neg_s / 2) / (P * N), the
    Mann-Whitney form of the trapezoid area under the ROC points."""
    by = list(by)
    per = df.groupBy(*by, F.col(score_col).alias("threshold")).agg(
        F.sum(F.when(F.col(y_col) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y_col) == 1, 0).otherwise(1)).alias("neg"))
    run = running_totals(per, "threshold", ["neg"], descending=True, by=by)
    # negatives strictly below s = N - cum_neg(s)
    agg = run.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                               F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("above"))
    return agg.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  1.0 - F.col("above") / (F.col("P") * F.col("N"))).alias("auc"),
                      "P", "N")
