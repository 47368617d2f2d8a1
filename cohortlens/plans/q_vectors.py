"""Registered queries over the vector view: neighbours, kNN classification, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import fixtures as fx
from cohortlens.operators import knn, profile
from cohortlens.plans.registry import register, rounded

W = fx.with_views

_PAIRS = """pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label AS neighbor_label,
    {dist} AS distance
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank
                      FROM pairs) t WHERE rank <= 5)"""
_EUC = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_MAN = ("list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), "
        "lambda x: abs(x[1] - x[2])))")


def _j06(spark, sf_dir):
    v = fx.view(spark, sf_dir, "vectors")
    nb = knn.nearest_neighbors(v, v, k=5)
    return rounded(nb.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance"))


register("j06_nearest_neighbors", W(
    "SELECT query_id, CAST(rank AS INT) AS rank, neighbor_id, round(distance, 6) AS distance FROM nb",
    "vectors", ctes=_PAIRS.format(dist=_EUC)))(_j06)


def _j06m(spark, sf_dir):
    v = fx.view(spark, sf_dir, "vectors")
    nb = knn.nearest_neighbors(v, v, k=5, metric="manhattan")
    return rounded(nb.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance"))


register("j06_nearest_neighbors_manhattan", W(
    "SELECT query_id, CAST(rank AS INT) AS rank, neighbor_id, round(distance, 6) AS distance FROM nb",
    "vectors", ctes=_PAIRS.format(dist=_MAN)))(_j06m)


def _m07(weights):
    def q(spark, sf_dir):
        v = fx.view(spark, sf_dir, "vectors")
        p = knn.knn_classify(v, k=5, weights=weights)
        return rounded(p.select("vec_id", "prediction", "confidence"))
    return q


_VOTE = """SELECT vec_id, prediction, round(w / total, 6) AS confidence FROM (
  SELECT query_id AS vec_id, CAST(neighbor_label AS INT) AS prediction, w, sum(w) OVER (PARTITION BY query_id) AS total,
    row_number() OVER (PARTITION BY query_id ORDER BY w DESC, neighbor_label) AS r
  FROM (SELECT query_id, neighbor_label, sum({w}) AS w FROM nbw GROUP BY query_id, neighbor_label) g) t
WHERE r = 1"""

register("m07_knn_classify", W(_VOTE.format(w="1.0"), "vectors",
                               ctes=_PAIRS.format(dist=_EUC) + ",\nnbw AS (SELECT * FROM nb)"))(_m07("uniform"))
register("m07_knn_classify_distance", W(
    _VOTE.format(w="wt"), "vectors",
    ctes=_PAIRS.format(dist=_EUC) + """,
nbw AS (SELECT *, CASE WHEN max(CASE WHEN distance = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1
                       THEN CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / distance END AS wt FROM nb)"""))(
    _m07("distance"))


def _l06(spark, sf_dir):
    v = fx.view(spark, sf_dir, "vectors")
    return profile.seeded_sample(v.select("vec_id", "label"), "vec_id", 100, seed=42)


register("l06_seeded_sample", W("""
SELECT vec_id, label FROM vectors ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100""",
    "vectors"))(_l06)
