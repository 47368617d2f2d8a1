"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_name(c: str) -> str:
    """A column name in an SQL expression (fitted steps write theirs as text: one call a column, not one an operator)."""
    return "`" + c.replace("`", "``") + "`"


def sql_number(x: float | None) -> str:
    if x is None:
        return "CAST(NULL AS DOUBLE)"
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clip(c, lo=None, hi=None) -> Column:
    """numpy-style clip; null stays null."""
    x = col(c)
    if lo is not None:
        x = F.when(x.isNull(), None).otherwise(F.greatest(x, F.lit(lo)))
    if hi is not None:
        x = F.when(x.isNull(), None).otherwise(F.least(x, F.lit(hi)))
    return x


def yes_no(c) -> Column:
    """1 for 'yes', 0 for 'no', 0 for anything else or null."""
    return F.when(col(c) == "yes", 1).otherwise(0)


def right_closed_cut(c, edges: Sequence[float], labels: Sequence[str], other=None,
                     include_lowest: bool = False) -> Column:
    """Label ``c`` by right-closed bins ``(e0,e1], (e1,e2], ...``.

    Values outside every bin (and null) get ``other``. ``include_lowest`` makes
    the first bin ``[e0, e1]`` as ``pd.qcut`` / ``pd.cut(include_lowest=True)``.
    ``ml.feature.Bucketizer`` is left-closed, so it is not used here.
    """
    x = col(c)
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= lo) if (include_lowest and i == 0) else (x > lo)
        cond = lower & (x <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(other))


#: fixed value: what a text must look like to be read as a number (no type suffixes such as "12d")
_NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_INF_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def missing_to_null(c) -> Column:
    """NaN to null: a missing value however it is written."""
    x = col(c).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def to_number(c) -> Column:
    """Text or number to double; text that is no number, and NaN, to null."""
    x = col(c)
    text = x.cast("string")
    ok = text.rlike(_NUMBER_TEXT) | text.rlike(_INF_TEXT)
    return missing_to_null(F.when(ok, F.trim(text).try_cast("double")))


def finite_or_null(c) -> Column:
    """Infinite and NaN to null (NaN counts as larger than any number in Spark)."""
    x = col(c)
    return F.when(F.abs(x) < F.lit(INF), x)


def finite_or_zero(c) -> Column:
    x = col(c)
    return F.when(F.abs(x) < F.lit(INF), x).otherwise(F.lit(0.0))


def display_name(c, upper: bool = False) -> Column:
    """'_' to space, then title case (first letter of each word up) or upper case."""
    spaced = F.regexp_replace(col(c), "_", " ")
    return F.upper(spaced) if upper else F.initcap(spaced)


def word_caps(c) -> Column:
    """'_' to space and upper-case the first letter of each word, rest unchanged."""
    spaced = F.regexp_replace(col(c), "_", " ")
    words = F.split(spaced, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                              F.substring(w, 2, 1 << 20))), " ")


def format_metric(c, kind: str = "percentage") -> Column:
    """'N/A' for null; percent with 1 decimal, 3 decimals, or rounded integer."""
    x = col(c)
    if kind == "percentage":
        body = F.concat(F.format_string("%.1f", x * 100), F.lit("%"))
    elif kind == "decimal":
        body = F.format_string("%.3f", x)
    elif kind == "integer":
        body = F.round(x, 0).cast("long").cast("string")
    else:
        body = x.cast("string")
    return F.when(x.isNull(), F.lit("N/A")).otherwise(body)
