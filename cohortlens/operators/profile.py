"""Table profiling (A11-A16, A18, A19, A21) and ordering helpers.

Global statistics are single aggregates; per-column statistics over many
columns use ``unpivot`` + a keyed aggregate so that partial aggregation
(map-side combine) dedups before the shuffle instead of an N-way Expand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.order_stats import quantiles


def shape_and_missing(df: DataFrame) -> DataFrame:
    """Rows, columns and the total number of missing cells, one pass."""
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  total.cast("long").alias("n_missing"))


def describe(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max (exact interpolated quartiles)."""
    x = F.col(c).cast("double")
    p25, p50, p75 = (F.lit(v).cast("double") for v in quantiles(df, {c: x}, [0.25, 0.5, 0.75])[c])
    return (df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                   F.min(x).alias("min"), F.max(x).alias("max"))
            .select("n", "mean", "std", "min", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "max"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Counts per value, most frequent first (nulls dropped, as value_counts does)."""
    return (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(c)))


def histogram(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max]; bins are [e_i, e_i+1), the last closed.

    Zero-count bins are kept (left join from the bin index range).
    """
    spark = df.sparkSession
    row = df.agg(F.min(c).alias("mn"), F.max(c).alias("mx")).first()
    mn, mx = row["mn"], row["mx"]
    if mn is None:
        return spark.range(0).select(F.col("id").cast("int").alias("bin"))
    mn, mx = float(mn), float(mx)
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    width = (mx - mn) / bins
    x = F.col(c).cast("double")
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    idx = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (idx.join(counts, "bin", "left")
            .select("bin",
                    (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def correlations(df: DataFrame, features, target: str) -> DataFrame:
    """Pearson correlation of each feature with the target (pairwise null removal)."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f)
                   for f in features])
    return row.unpivot([], list(features), "feature", "corr").orderBy("corr")


def group_mean(df: DataFrame, by: str, c: str) -> DataFrame:
    """Mean of ``c`` per group."""
    return df.groupBy(by).agg(F.avg(c).alias(f"mean_{c}"))


def distinct_counts(df: DataFrame, cols=None) -> DataFrame:
    """Number of distinct non-null values per column.

    unpivot to (column, value) then a keyed distinct count: the partial
    aggregate dedups (column, value) pairs map-side before the shuffle.
    """
    cols = list(cols or df.columns)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value")
    return long.groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


def distribution(df: DataFrame, c: str) -> DataFrame:
    """Count and share per value (share over all non-null rows)."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    # the total is one scalar: an unkeyed window over the grouped result,
    # whose size is the number of distinct values, not the number of rows
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_n(df: DataFrame, order_col: str, n: int = 10, tie_col: str | None = None,
          ascending: bool = False) -> DataFrame:
    """L1 / L2: order by a value (ties by ``tie_col``) and keep n rows (TakeOrderedAndProject)."""
    o = F.asc(order_col) if ascending else F.desc(order_col)
    orders = [o] + ([F.asc(tie_col)] if tie_col else [])
    return df.orderBy(*orders).limit(n)


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement, reproducible: the n smallest md5(seed:id)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
