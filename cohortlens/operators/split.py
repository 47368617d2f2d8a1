"""Stratified splits, folds and class weights.

Assignment is deterministic: rows of each class are ranked by md5(seed:id)
and the rank decides train / val / test (or the fold). The rank is EXACT but
never needs one task per class: the hash space is cut into 16^d buckets by
its leading hex digits, a tiny (class, bucket) count table gives each
bucket's offset, and rows are ranked only within their (class, bucket)
group. Because the hash is uniform, a class holding most rows is spread over
all buckets. ``approximate=True`` skips the ranking and thresholds the hash
directly (no shuffle at all), for when exact per-class proportions are not
needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def hash_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_rank(df: DataFrame, class_col: str, id_col: str, seed: int = 42,
                    hex_digits: int = 3) -> DataFrame:
    """Add ``_rank`` (0-based position of the row in its class by hash, ties by
    id) and ``_n`` (class size). Rows without a class are a class of their own."""
    keyed = (df.withColumn("_h", hash_key(id_col, seed))
             .withColumn("_b", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int")))
    counts = keyed.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wc = Window.partitionBy(class_col).orderBy("_b")
    offsets = counts.select(
        class_col, "_b",
        (F.sum("_cnt").over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(class_col)).alias("_n"))
    # offsets has (classes x 16^d) rows at most; no hint: AQE measures the
    # materialised shuffle output and broadcasts it only when it is small
    k, o = keyed.alias("k"), offsets.alias("o")
    joined = k.join(o, F.col(f"k.{class_col}").eqNullSafe(F.col(f"o.{class_col}")) & (F.col("k._b") == F.col("o._b"))) \
        .select("k.*", "o._off", "o._n")
    wr = Window.partitionBy(class_col, "_b").orderBy("_h", id_col)
    return joined.withColumn("_rank", F.col("_off") + F.row_number().over(wr) - 1) \
        .drop("_h", "_b", "_off")


def stratified_split(df: DataFrame, class_col: str, id_col: str, val_size: float = 0.1,
                     test_size: float = 0.2, seed: int = 42, approximate: bool = False,
                     k_folds: int | None = None) -> DataFrame:
    """M1: add ``split`` in (train, val, test) with per-class shares
    1 - val - test / val / test (70/10/20 by default).

    With ``k_folds`` the training rows also get a stratified ``fold`` (M2) from
    the same ranking: training rows are the first ranks of their class, so a
    row's rank among the class's training rows IS its class rank."""
    train_end = 1.0 - val_size - test_size
    val_end = 1.0 - test_size
    if approximate:
        u = F.conv(F.substring(hash_key(id_col, seed), 1, 13), 16, 10).cast("double") / float(16 ** 13)
        return df.withColumn("split", F.when(u < train_end, "train").when(u < val_end, "val")
                             .otherwise("test"))
    r = stratified_rank(df, class_col, id_col, seed)
    rank, n = F.col("_rank"), F.col("_n")
    out = r.withColumn("split", F.when(rank < n * train_end, "train")
                       .when(rank < n * val_end, "val").otherwise("test"))
    if k_folds:
        out = out.withColumn("fold", F.when(F.col("split") == "train", (rank % k_folds).cast("int")))
    return out.drop("_rank", "_n")


def stratified_folds(df: DataFrame, class_col: str, id_col: str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """M2: ``fold`` in 0..k-1, classes dealt round-robin in hash order."""
    r = stratified_rank(df, class_col, id_col, seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def class_weights(df: DataFrame, class_col: str) -> DataFrame:
    """M5: balanced weight n / (k * n_c) per class (small table: one row per class)."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))

