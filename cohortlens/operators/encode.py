"""Encoding and scaling (E1-E9) with fitted, reusable state; E10 and E11 are in ``prepare``.

Label codes (E1-E3) live in a mapping DataFrame (column, value, code): distinct
pairs (deduplicated in every map task) numbered by ``order_stats.dictionary_codes``,
by range where they are many. A narrow column's codes are applied as a map
literal, a wide column's by a join, broadcast only up to a checked number of
bytes. Scaling statistics are one global aggregate collected as a single row
(bounded by the number of columns) and applied as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.exprs import sql_name, sql_number, sql_text
from cohortlens.operators import clean as cl
from cohortlens.operators.order_stats import dictionary_codes
from cohortlens.schema import numeric_columns, require_column, string_columns

UNKNOWN = "unknown"
BROADCAST_BYTES = 32 << 20   # size of a column's mapping up to which its join is broadcast
MIN_STD = 1e-8
FEW_CODES = 5_000        # rows of a whole mapping up to which it is looked at on the driver
MAP_LITERAL_ROWS = 300   # values of a column up to which its codes are a map literal (a linear scan per row)


# ---------------------------------------------------------------- E1 / E2 / E3
def _codes(df: DataFrame, cols, missing: str, always: bool) -> DataFrame:
    """Codes of the values of some columns, null as ``missing`` (which has a code of its own if ``always``)."""
    long = df.select(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in cols]).unpivot([], cols, "column", "value")
    if always:
        long = long.unionByName(df.sparkSession.createDataFrame([(c, missing) for c in cols], "column string, value string"))
    return dictionary_codes(long.distinct())


def fit_label_codes(df: DataFrame, cols=None, exclude=cl.ID_COLS) -> DataFrame:
    """E1 fit: code = position of the value among the sorted distinct values
    of the column plus 'unknown' (nulls count as 'unknown')."""
    cols = string_columns(df, exclude) if cols is None else list(cols)
    return _codes(df, cols, UNKNOWN, True)


def _apply_codes(df: DataFrame, mapping: DataFrame, cols, missing: str) -> DataFrame:
    """Replace values by codes; null and unseen values take the code of ``missing`` (null if it has none)."""
    codes: dict[str, dict] = {}
    rows = mapping.select("column", "value", "code").limit(FEW_CODES + 1).collect()
    if len(rows) > FEW_CODES:
        sizes = mapping.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes"),
            F.max(F.when(F.col("value") == missing, F.col("code"))).alias("default")).collect()  # one row a column
        size = {r["column"]: r.asDict() for r in sizes}
        narrow = [c for c in cols if c in size and size[c]["n"] <= MAP_LITERAL_ROWS]
        rows = mapping.filter(F.col("column").isin(narrow)).select("column", "value", "code").collect() if narrow else []
    else:
        size = {}
    for r in rows:
        codes.setdefault(r["column"], {})[r["value"]] = r["code"]
    for c, m in codes.items():
        size.setdefault(c, {"n": len(m), "default": m.get(missing), "bytes": sum(len(v.encode()) + 16 for v in m)})
    codes = {c: m for c, m in codes.items() if len(m) <= MAP_LITERAL_ROWS}
    proj = {}
    for c in cols:
        if c not in size:
            proj[c] = F.lit(0)
        elif c in codes:
            table = ", ".join(f"{sql_text(v)}, {k}" for v, k in sorted(codes[c].items()))
            other = "NULL" if size[c]["default"] is None else size[c]["default"]
            proj[c] = F.expr(f"CAST(coalesce(element_at(map({table}), coalesce({sql_name(c)}, {sql_text(missing)})), "
                             f"{other}) AS INT)")
    out = df.withColumns(proj) if proj else df
    for c in cols:
        if c in size and c not in codes:
            m = mapping.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            m = F.broadcast(m) if size[c]["bytes"] <= BROADCAST_BYTES else m
            out = out.join(m, F.coalesce(F.col(c), F.lit(missing)) == F.col("__value"), "left") \
                .withColumn(c, F.coalesce(F.col("__code"), F.lit(size[c]["default"])).cast("int")).drop("__value", "__code")
    return out


def apply_label_codes(df: DataFrame, mapping: DataFrame, cols=None, exclude=cl.ID_COLS) -> DataFrame:
    """E2 apply: null or unseen value -> code of 'unknown'; a string column
    without a stored mapping becomes 0."""
    cols = string_columns(df, exclude) if cols is None else list(cols)
    return _apply_codes(df, mapping, cols, UNKNOWN)


def plain_label_encode(df: DataFrame, cols=None, exclude=cl.ID_COLS) -> DataFrame:
    """Text form of the value (null -> 'nan'), coded by sorted position."""
    cols = string_columns(df, exclude) if cols is None else list(cols)
    return _apply_codes(df, _codes(df, cols, "nan", False), cols, "nan")


# ---------------------------------------------------------------- E4 / E5
MAX_ONE_HOT = 1000   # values of a column up to which each gets a column of its own


def _sparse_one_hot(df: DataFrame, c: str, mapping: DataFrame, n: int) -> DataFrame:
    """``c`` as a sparse vector column ``c_onehot`` of ``n`` places in sorted order, null all zero."""
    code = f"__code_{c}"
    coded = _apply_codes(df.withColumn(code, F.col(c)), mapping.withColumn("column", F.lit(code)), [code], "")
    # the place after the last value stands for null and is the one that the encoder leaves out
    place = F.when(F.col(c).isNull(), n).otherwise(F.col(code)).cast("double")
    coded = coded.withColumn(code, place.alias(code, metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1}}))
    enc = OneHotEncoder(inputCols=[code], outputCols=[f"{c}_onehot"], dropLast=True)
    return enc.fit(coded.limit(0)).transform(coded).drop(code)


def prepare_features(df: DataFrame, target: str = "risk_level",
                     drop=("G3", "risk_score", "pass_fail"), exclude=cl.ID_COLS) -> DataFrame:
    """E4 + E5: binary string columns (<= 2 distinct) -> sorted code 0/1 (null -1);
    wider ones -> one boolean column per value named ``col_value`` (null: all false).

    The output schema depends on the values, so they are collected: the number
    of each column's values first, then the values of columns with at most
    ``MAX_ONE_HOT``. A column with more becomes one sparse vector column
    ``col_onehot`` over its sorted values instead (null: all zero)."""
    require_column(df, target)
    x = df.drop(*[c for c in drop if c != target])
    cols = string_columns(x, tuple(exclude) + (target,))
    pairs = (x.select(*cols).unpivot([], cols, "column", "value")
             .filter(F.col("value").isNotNull()).distinct())
    # at most this many values of each column come back; a column that reaches the limit is wide
    some = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy("value"))) \
        .filter(F.col("nth") <= MAX_ONE_HOT + 1).select("column", "value").collect()
    values: dict[str, list[str]] = {c: [] for c in cols}
    for r in some:
        values[r["column"]].append(r["value"])
    wide = [c for c in cols if len(values[c]) > MAX_ONE_HOT]
    if wide:
        mapping = dictionary_codes(pairs.filter(F.col("column").isin(wide)))
        sizes = {r["column"]: r["n"] for r in mapping.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        for c in wide:
            x = _sparse_one_hot(x, c, mapping.filter(F.col("column") == c), sizes[c])
    proj = {}
    drop_cols = list(wide)
    for c in cols:
        vals = sorted(values[c])
        if c in wide:
            continue
        if len(vals) > 2:
            for v in vals:
                proj[f"{c}_{v}"] = F.coalesce(F.col(c) == F.lit(v), F.lit(False))
            drop_cols.append(c)
        else:
            code = F.lit(-1)
            for i, v in enumerate(vals):
                code = F.when(F.col(c) == F.lit(v), F.lit(i)).otherwise(code)
            proj[c] = code.cast("int")
    return x.withColumns(proj).drop(*drop_cols)


# ---------------------------------------------------------------- E7 / E8 / E9
@dataclass
class ScaleState:
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)   # population std used for division
    cols: list = field(default_factory=list)   # columns that get scaled


def fit_scaling(df: DataFrame, cols=None, exclude=cl.ID_COLS, all_columns: bool = False) -> ScaleState:
    """E7 / E9 fit. ``all_columns=False``: scale only columns whose sample std
    > 1e-8; ``True`` (E9): every column, a constant column divides by 1.
    One pass: mean, population std and count of each column; the sample std
    follows as pop * sqrt(n / (n - 1))."""
    cols = numeric_columns(df, exclude) if cols is None else list(cols)
    st = ScaleState()
    for c, (mean, p, n) in cl.moments(df, cols).items():
        s = cl.sample_deviation(p, n)
        if all_columns:
            st.cols.append(c)
            st.means[c] = mean
            st.stds[c] = p if (p is not None and p > 0) else 1.0
        elif s is not None and s > MIN_STD:
            st.cols.append(c)
            st.means[c] = mean
            st.stds[c] = p
    return st


def apply_scaling(df: DataFrame, st: ScaleState, safety: bool = True, exclude=cl.ID_COLS) -> DataFrame:
    """Standardise the fitted columns still present; then (P14) nulls and
    non-finite values to 0 on every numeric column. One projection."""
    numeric = set(numeric_columns(df, exclude)) if safety else set()
    scaled, out = set(st.cols), []
    for c in df.columns:
        x = sql_name(c)
        if c in scaled:
            x = f"(CAST({x} AS DOUBLE) - {sql_number(st.means[c])}) / {sql_number(st.stds[c])}"
        if c in numeric:
            x = f"CASE WHEN abs(CAST({x} AS DOUBLE)) < double('Infinity') THEN CAST({x} AS DOUBLE) ELSE 0.0D END"
        out.append(F.expr(x).alias(c) if c in scaled or c in numeric else F.col(c))
    return df.select(*out)


def smart_scaling(df: DataFrame, exclude=cl.ID_COLS) -> DataFrame:
    """E7 fit + apply."""
    return apply_scaling(df, fit_scaling(df, exclude=exclude))


def scale_features(df: DataFrame, exclude=cl.ID_COLS) -> DataFrame:
    """Standardise every numeric column (constant column: divide by 1)."""
    st = fit_scaling(df, exclude=exclude, all_columns=True)
    return apply_scaling(df, st, safety=False)
