"""Cleaning operators: casts, defaults, non-finite handling, imputation,
quantile clipping and z-score outlier filtering.

Each fitted step reads all columns in one scan: means and deviations as one
aggregate, quantiles and modes from value counts (``order_stats``: exact, no task
holds all values). Only the statistics come back (bounded by the number of
columns) and are applied as literals in a projection, so the apply step is a
narrow, codegen'd map with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import finite_or_null, finite_or_zero, missing_to_null, sql_name, sql_number, to_number
from cohortlens.operators.order_stats import OrderedCounts, modes, quantiles, value_counts
from cohortlens.schema import numeric_columns, string_columns

ID_COLS = ("student_id", "event_id", "vec_id", "doc_id")


def to_numeric(df: DataFrame, cols) -> DataFrame:
    """P5: numeric cast, a bad value or NaN becomes null (``pd.to_numeric(errors='coerce')``)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: to_number(c) for c in cols})


def with_default(df: DataFrame, name: str, default) -> Column:
    """The column when present (null stays null), else a literal default."""
    return F.col(name) if name in df.columns else F.lit(default)


def nonfinite_to_null(df: DataFrame, cols=None) -> DataFrame:
    """+/-inf and NaN to null."""
    cols = numeric_columns(df, ID_COLS) if cols is None else list(cols)
    return df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in cols})


def final_safety(df: DataFrame, cols=None) -> DataFrame:
    """Null / NaN / infinite to 0 on numeric columns."""
    cols = numeric_columns(df, ID_COLS) if cols is None else list(cols)
    return df.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in cols})


def _one_row(df: DataFrame, exprs: list[Column]):
    """Run one global aggregate and return its single row (bounded size)."""
    if not exprs:
        return {}
    return df.agg(*exprs).first().asDict()


@dataclass
class CleanState:
    """Fitted state of P10: medians for the fill, [p01, p99] bounds for the clip, and which columns had missing values."""
    medians: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    missing: list = field(default_factory=list)


def fit_median_fill(df: DataFrame, cols) -> dict:
    """P8 fit: median per column (interpolated), over non-null values."""
    found = quantiles(df, {c: missing_to_null(c) for c in cols}, [0.5])
    return {c: v[0] for c, v in found.items()}


def apply_median_fill(df: DataFrame, medians: dict) -> DataFrame:
    """P8 apply: null to the median, to 0 when the column had no value at all."""
    return df.withColumns({
        c: F.coalesce(missing_to_null(c), F.lit(m).cast("double"), F.lit(0.0))
        for c, m in medians.items() if c in df.columns})


def fit_clip_bounds(df: DataFrame, cols, lo: float = 0.01, hi: float = 0.99) -> dict:
    """P9 fit: interpolated ``lo``/``hi`` quantiles of every column in one pass."""
    return {c: tuple(v) for c, v in quantiles(df, {c: missing_to_null(c) for c in cols}, [lo, hi]).items()}


def apply_clip(df: DataFrame, bounds: dict, nullable: bool = True) -> DataFrame:
    """P9 apply: clip into [p_lo, p_hi] only where p_hi > p_lo; null stays null
    (Spark's ``greatest`` skips nulls, so the guard is needed unless the
    column is known to hold none)."""
    out = {}
    for c, (qlo, qhi) in bounds.items():
        if c not in df.columns or qlo is None or qhi is None or not (qhi > qlo):
            continue
        x = F.col(c).cast("double")
        clipped = F.least(F.greatest(x, F.lit(qlo)), F.lit(qhi))
        out[c] = F.when(x.isNull(), None).otherwise(clipped) if nullable else clipped
    return df.withColumns(out) if out else df


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def fit_clean(df: DataFrame, cols=None, exclude=ID_COLS, lo: float = 0.01, hi: float = 0.99) -> CleanState:
    """P10 fit from one pass of value counts.

    The clip quantiles are those of the filled column: its counts are the raw
    ones with the fill value's count raised by the number of missing values, so
    no second pass over the rows is needed."""
    cols = numeric_columns(df, exclude) if cols is None else list(cols)
    if not cols:
        return CleanState()
    types = dict(df.dtypes)
    finite = {c: F.col(c).cast("double") if types[c] in INTEGRAL else finite_or_null(F.col(c).cast("double")) for c in cols}
    with OrderedCounts(value_counts(df, finite)) as counts:
        medians = {c: v[0] for c, v in counts.quantiles({c: [0.5] for c in cols}).items()}
        fill = {c: (medians[c] if medians[c] is not None else 0.0, counts.missing.get(c, 0)) for c in cols}
        bounds = counts.quantiles({c: [lo, hi] for c in cols}, fill)
    return CleanState(medians, {c: tuple(v) for c, v in bounds.items()}, [c for c in cols if counts.missing.get(c)])


def apply_clean(df: DataFrame, state: CleanState, new_rows: bool = True) -> DataFrame:
    """P10 apply: non-finite to null, fill, clip, as one projection.

    Rows that were not fitted on can miss any value; without ``new_rows`` only
    columns that missed some when fitted get a fill (a shorter plan)."""
    proj, types = {}, dict(df.dtypes)
    for c, median in state.medians.items():
        if c not in types:
            continue
        x = f"CAST({sql_name(c)} AS DOUBLE)"
        if new_rows or c in state.missing:
            finite = x if types[c] in INTEGRAL else f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"
            x = f"coalesce({finite}, {sql_number(median if median is not None else 0.0)})"
        lo, hi = state.bounds.get(c, (None, None))
        if lo is not None and hi is not None and hi > lo:
            x = f"least(greatest({x}, {sql_number(lo)}), {sql_number(hi)})"
        proj[c] = F.expr(x)
    return df.withColumns(proj) if proj else df


def clean(df: DataFrame, cols=None, exclude=ID_COLS, return_state: bool = False):
    """P10: non-finite to null, median fill, then [1 %, 99 %] clip.

    All numeric columns (target included, ids excluded) come out as double."""
    state = fit_clean(df, cols, exclude)
    out = apply_clean(df, state, new_rows=False)
    return (out, state) if return_state else out


def fill_mean(df: DataFrame, cols=None, exclude=ID_COLS) -> DataFrame:
    """Numeric nulls and NaN to the column mean (``SimpleImputer(strategy='mean')``)."""
    cols = numeric_columns(df, exclude) if cols is None else list(cols)
    means = _one_row(df, [F.avg(missing_to_null(c)).alias(c) for c in cols])
    return df.withColumns({c: F.coalesce(missing_to_null(c), F.lit(means[c]).cast("double")) for c in cols})


def fill_mode(df: DataFrame, cols=None, exclude=ID_COLS, default: str = "Unknown") -> DataFrame:
    """String nulls to the most frequent value (smallest on ties), else ``default``."""
    cols = string_columns(df, exclude) if cols is None else list(cols)
    found = modes(df, {c: F.col(c) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c] if found[c] is not None else default)) for c in cols})


@dataclass
class OutlierState:
    means: dict
    stds: dict


def moments(df: DataFrame, cols) -> dict[str, tuple[float | None, float | None, int]]:
    """(mean, population deviation, count) of the non-null values of each numeric column, in one pass.

    One row a column, grouped by name: three aggregate buffers however many columns there are."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]) \
        .unpivot([], [f"v{i}" for i in range(len(cols))], "name", "value")
    rows = long.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("p"), F.count("value").alias("n"))
    found = {r["name"]: (r["m"], r["p"], r["n"]) for r in rows.collect()}
    return {c: found.get(f"v{i}", (None, None, 0)) for i, c in enumerate(cols)}


def sample_deviation(population: float | None, n: int) -> float | None:
    return population * (n / (n - 1)) ** 0.5 if population is not None and n > 1 else None


def fit_outliers(df: DataFrame, cols) -> OutlierState:
    found = moments(df, cols)
    return OutlierState({c: m for c, (m, _, _) in found.items()},
                        {c: sample_deviation(p, n) for c, (_, p, n) in found.items()})


def outlier_keep_condition(state: OutlierState, threshold: float = 3.0, min_std: float = 1e-8) -> Column:
    """AND over columns with sample std > ``min_std`` of ``|z| < threshold``;
    a non-finite z (null / NaN / inf value) passes."""
    cond = F.lit(True)
    for c, s in state.stds.items():
        if s is None or not (s > min_std):
            continue
        z = f"abs((CAST({sql_name(c)} AS DOUBLE) - {sql_number(state.means[c])}) / {sql_number(s)})"
        # NaN counts as larger than any number: it is not below infinity and passes
        cond = cond & F.expr(f"coalesce(NOT ({z} >= {sql_number(threshold)} AND {z} < double('Infinity')), true)")
    return cond


def outlier_flag(state: OutlierState, threshold: float = 3.0, min_std: float = 1e-8) -> Column:
    """The same condition as one column: every column's expression is written once, in an array."""
    z = [f"abs((CAST({sql_name(c)} AS DOUBLE) - {sql_number(state.means[c])}) / {sql_number(s)})"
         for c, s in state.stds.items() if s is not None and s > min_std]
    return F.expr(f"NOT coalesce(exists(array({', '.join(z)}), v -> v >= {sql_number(threshold)} "
                  "AND v < double('Infinity')), false)") if z else F.lit(True)


def remove_outliers(df: DataFrame, threshold: float = 3.0, cols=None, exclude=ID_COLS) -> DataFrame:
    """Drop a row when any numeric column has ``|z| >= threshold``.

    The statistics come from the unfiltered table (one aggregate), so the
    filter itself is a narrow predicate with no shuffle.
    """
    cols = numeric_columns(df, exclude) if cols is None else list(cols)
    return df.filter(outlier_keep_condition(fit_outliers(df, cols), threshold))
