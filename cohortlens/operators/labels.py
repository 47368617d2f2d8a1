"""Class labels: codes, decoding, one-hot probability fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.metrics import class_labels


def encode_labels(df: DataFrame, col: str, out: str, classes=None):
    """code = position among the sorted class names (a fitted label
    encoder); returns (DataFrame, classes). The class list is bounded."""
    classes = list(classes) if classes is not None else class_labels(df, col)
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(arr, F.col(col)) - 1).cast("int")), classes


def decode(code, classes, unknown: str = "Unknown") -> Column:
    """Code back to its name; an out-of-range code decodes to ``unknown``."""
    c = F.col(code) if isinstance(code, str) else code
    arr = F.array(*[F.lit(x) for x in classes])
    inside = (c >= 0) & (c < len(classes))
    return F.when(inside, F.element_at(arr, (c + 1).cast("int"))).otherwise(F.lit(unknown))


def one_hot_probability(code, n_classes: int) -> Column:
    """Probability row for a model without probabilities: 1.0 at the
    predicted code, sized by the full class count."""
    c = F.col(code) if isinstance(code, str) else code
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == c, F.lit(1.0)).otherwise(F.lit(0.0)))
