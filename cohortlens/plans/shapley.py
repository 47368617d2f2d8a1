"""Model-agnostic Shapley attributions by permutation sampling.

Re-aimed from per-machine tree / kernel explainers to one distributed job
(permutation sampling, Strumbelj & Kononenko 2014):

* explained rows (a seeded sample of the test split) are paired with every
  row of a seeded background sample (bounded by ``n_background``) and with
  ``n_perm`` seeded feature permutations each: a chain, dealt out by its key;
* the hybrid vectors between the two ends of a chain (step i takes the first i
  features of the permutation from the explained row) are scored by ONE
  ``Model.transform``; the ends are the rows themselves and are scored once a
  row, not once a chain;
* the score of step i counts for the feature added there and against the one
  added next, so contributions are signed sums of whole class vectors by
  feature: one aggregate with map-side combine, a column a class.

Each chain telescopes, so per row the attributions sum exactly to
f(x) - mean_background f(z) (additivity), whatever the sample sizes.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.profile import seeded_sample
from cohortlens.session import written


#: hybrid vectors that one task scores
HYBRIDS_PER_TASK = 50_000


def _sample_indexed(df: DataFrame, n: int, seed: int, name: str) -> DataFrame:
    s = seeded_sample(df, "id", n, seed)
    w = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    return s.withColumn(name, F.row_number().over(w) - 1)


def shapley_values(model, data: DataFrame, feature_names, classes, n_explain: int = 50,
                   n_background: int = 100, n_perm: int = 4, seed: int = 42,
                   link: str = "identity") -> DataFrame:
    """Long table: id, class_name, feature, value, shap (probability scale, or
    log-odds with ``link='logit'``). ``data`` has id, features, split."""
    p = len(feature_names)
    test = data.filter(F.col("split") == "test").select("id", vector_to_array("features").alias("x"))
    train = data.filter(F.col("split") == "train").select("id", vector_to_array("features").alias("z"))
    # both samples are bounded and read several times: written once
    ex = written(seeded_sample(test, "id", n_explain, seed), "explained")
    bg = written(_sample_indexed(train, n_background, seed + 1, "bi").select("bi", "z"), "background")
    nb = bg.count()
    n_hybrids = ex.count() * nb * n_perm * p
    # the background is a bounded sample (<= n_background rows): broadcast it
    pairs = (ex.select("id", "x").withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(max(nb, 1) - 1))))
             .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
             .repartition(max(1, n_hybrids // HYBRIDS_PER_TASK), "id", "bi", "perm")
             .join(F.broadcast(bg), "bi"))
    # permutation of feature indices, seeded per (row, background, perm)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda f: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("bi").cast("string"),
                          F.col("perm").cast("string"), f.cast("string"))).alias("k"), f.alias("f")))
    order = F.transform(F.array_sort(keyed), lambda s: s["f"])
    # inverse permutation (position of each feature), once per chain: sort
    # (feature, rank) pairs by feature -- O(p log p), not p lookups of O(p)
    pos = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.struct(
        F.element_at(F.col("order"), i + 1).alias("f"), i.alias("r")))), lambda s: s["r"])
    chains = pairs.withColumn("order", order)

    def scores(df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and the class scores s0, s1, ... of a table with features."""
        v = vector_to_array("probability")
        if link == "logit":
            v = F.transform(v, lambda q: F.log(F.greatest(q, F.lit(1e-12)) / F.greatest(1 - q, F.lit(1e-12))))
        scored = model.transform(df).select(*keep, v.alias("__s"))
        return scored.select(*keep, *[F.col("__s")[i].alias(f"s{i}") for i in range(k)])

    def signed(df: DataFrame, *uses: tuple[Column, int]) -> DataFrame:
        """Rows (id, feature_idx, class scores with sign, gained) of the features that a score counts for or against."""
        use = F.array(*[F.struct(f.alias("feature_idx"), F.lit(s).alias("sign")) for f, s in uses])
        return df.withColumn("u", F.explode(use)).select(
            "id", "u.feature_idx", *[(F.col(f"s{i}") * F.col("u.sign")).alias(f"s{i}") for i in range(k)],
            (F.col("u.sign") > 0).cast("int").alias("gained"))

    k = len(classes)
    first, last = F.element_at("order", 1), F.element_at("order", p)
    ends = chains.select("id", "bi", first.alias("first"), last.alias("last"))
    # scores of the ends: one a background row and one an explained row, joined to their chains
    at_start = ends.join(F.broadcast(scores(bg.select("bi", array_to_vector("z").alias("features")), "bi")), "bi")
    at_end = ends.join(F.broadcast(scores(ex.select("id", array_to_vector("x").alias("features")), "id")), "id")
    parts = [signed(at_start, (F.col("first"), -1)), signed(at_end, (F.col("last"), 1))]
    if p > 1:
        steps = chains.withColumn("pos", pos).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(p - 1))))
        mixed = F.transform("pos", lambda r, i: F.when(r < F.col("step"), F.get("x", i)).otherwise(F.get("z", i)))
        hybrids = steps.select("id", F.get("order", F.col("step") - 1).alias("added"), F.get("order", "step").alias("next"),
                               array_to_vector(mixed).alias("features"))
        parts.append(signed(scores(hybrids, "id", "added", "next"), (F.col("added"), 1), (F.col("next"), -1)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    phi = every.groupBy("id", "feature_idx").agg(
        *[(F.sum(f"s{i}") / F.sum("gained")).alias(f"s{i}") for i in range(k)])
    names = F.array(*[F.lit(n) for n in feature_names])
    per_class = F.explode(F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(f"s{i}").alias("shap"))
                                    for i, c in enumerate(classes)]))
    return (phi.join(ex.select("id", "x"), "id").withColumn("c", per_class)
            .select("id", "c.class_name", F.element_at(names, F.col("feature_idx") + 1).alias("feature"),
                    F.element_at("x", F.col("feature_idx") + 1).alias("value"), "c.shap"))


def base_values(model, data: DataFrame, classes, n_background: int = 100, seed: int = 42) -> DataFrame:
    """Expected model output over the background sample, per class."""
    train = data.filter(F.col("split") == "train").select("id", "features")
    bg = seeded_sample(train, "id", n_background, seed + 1)
    prob = model.transform(bg).select(vector_to_array("probability").alias("p"))
    cls = F.array(*[F.lit(c) for c in classes])
    return (prob.select(F.posexplode("p").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("base_value"))
            .select(F.element_at(cls, F.col("k") + 1).alias("class_name"), "base_value"))


def summary_points(attr: DataFrame, class_name: str, n: int = 20) -> DataFrame:
    """The points of a summary chart of one class: each row's value and
    contribution of the ``n`` features of largest mean |shap| (rank 1 first, ties by name)."""
    own = attr.filter(F.col("class_name") == class_name)
    imp = own.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance"))
    top = imp.orderBy(F.desc("importance"), "feature").limit(n)  # n rows
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return own.join(F.broadcast(top), "feature").select("rank", "feature", "importance", "id", "value", "shap")


def waterfall(attr: DataFrame, base: DataFrame, n: int = 9) -> DataFrame:
    """The bars of a waterfall chart of every (row, class): from the base
    value (``base``: class_name, base_value) through the ``n`` strongest
    contributions and the sum of the others to the model's output."""
    key = ["id", "class_name"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.abs("shap")), "feature"))
    ranked = attr.withColumn("position", F.least(rank, F.lit(n + 1)))
    bars = ranked.groupBy(*key, "position").agg(
        F.when(F.col("position") <= n, F.min("feature")).otherwise(F.lit("other features")).alias("feature"),
        F.when(F.col("position") <= n, F.min("value")).alias("value"), F.sum("shap").alias("shap"))
    upto = F.sum("shap").over(Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("upto", upto).join(F.broadcast(base), "class_name")  # one row a class
    return out.select(*key, "position", "feature", "value", "shap",
                      (F.col("base_value") + F.col("upto") - F.col("shap")).alias("start"),
                      (F.col("base_value") + F.col("upto")).alias("end"))


def explain_rows(model, data: DataFrame, attr: DataFrame, classes, n: int = 5) -> DataFrame:
    """X7 + X8: per explained row: predicted class, confidence (max
    probability), and the top-n positive / negative contributions of the
    predicted class."""
    from cohortlens.operators.explain import top_factors
    ids = attr.select("id").distinct()
    scored = model.transform(data.join(ids, "id", "left_semi"))
    cls = F.array(*[F.lit(c) for c in classes])
    pred = scored.select("id", F.col("class_name").alias("actual"),
                         F.element_at(cls, F.col("prediction").cast("int") + 1).alias("predicted"),
                         F.array_max(vector_to_array("probability")).alias("confidence"))
    own = attr.join(pred.select("id", F.col("predicted").alias("class_name")), ["id", "class_name"])
    tf = top_factors(own, "id", n).drop("class_name")
    return pred.join(tf, "id", "left")


def one_per_class(data: DataFrame, classes, per_class: int = 1, seed: int = 42) -> DataFrame:
    """The first row (seeded order) of each risk class, at most 3, in class order."""
    w = Window.partitionBy("class_name").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    picked = (data.filter(F.col("split") == "test").withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= per_class))
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_name"))
    return picked.withColumn("class_pos", pos).orderBy("class_pos").limit(3).drop("rn", "class_pos")


def sample_report(model, data: DataFrame, raw: DataFrame, classes, n: int = 5, seed: int = 42,
                  raw_cols=("age", "failures", "absences", "studytime", "G3")) -> DataFrame:
    """A seeded sample of test rows with actual and predicted class, the
    probability of each class and key raw features (joined by id)."""
    picked = seeded_sample(data.filter(F.col("split") == "test"), "id", n, seed)
    cls = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(picked).select(
        "id", F.col("class_name").alias("actual"),
        F.element_at(cls, F.col("prediction").cast("int") + 1).alias("predicted"),
        vector_to_array("probability").alias("probability"))
    keep = [c for c in raw_cols if c in raw.columns]
    return scored.join(raw.select(F.col("student_id").alias("id"), *keep), "id", "left")


def attribute_models(models: dict, data: DataFrame, feature_names, classes, **kw) -> DataFrame:
    """X11: Shapley tables of every model with a ``model`` column; a model
    that fails, at run time too, is recorded as an error row instead of stopping the run."""
    spark = data.sparkSession
    parts = []
    for name, m in models.items():
        try:
            a = shapley_values(m, data, feature_names, classes, **kw)
            a = written(a, "attributions")  # every failure surfaces here
            parts.append(a.select(F.lit(name).alias("model"), "*", F.lit(None).cast("string").alias("error")))
        except Exception as ex:  # noqa: BLE001 - reported as a row
            parts.append(spark.createDataFrame(
                [(name, None, None, None, None, None, f"{type(ex).__name__}: {ex}"[:300])],
                "model string, id long, class_name string, feature string, value double, shap double, "
                "error string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
