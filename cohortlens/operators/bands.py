"""Risk bands (B1-B6). Every scheme is right-closed; the scheme is a parameter.

B4/B5 need global statistics (quartile edges, min/max/median): value counts give
them exactly, and the labelling is then a projection with literal edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import right_closed_cut
from cohortlens.operators.order_stats import quantiles

# Band labels and edges of each scheme.
RISK_LABELS = ["Critical", "High", "Medium", "Low"]
LOADER_EDGES = [-1, 9, 11, 14, 20]
PERCENT_EDGES = [0, 50, 65, 80, 100]
THRESHOLD_EDGES = [0, 8, 12, 15, 20]
DASHBOARD_LEVELS = ["high", "medium", "low"]


def loader_band(c) -> Column:
    """B1: (-1,9] Critical, (9,11] High, (11,14] Medium, (14,20] Low, else null."""
    return right_closed_cut(c, LOADER_EDGES, RISK_LABELS)


def percent_band(c) -> Column:
    """B2: (0,50], (50,65], (65,80], (80,100]; 0 and out of range are null."""
    return right_closed_cut(c, PERCENT_EDGES, RISK_LABELS)


def threshold_band(c) -> Column:
    """(0,8], (8,12], (12,15], (15,20]; anything else (0, null) is Medium."""
    return right_closed_cut(c, THRESHOLD_EDGES, RISK_LABELS, other="Medium")


def dashboard_level(c) -> Column:
    """<= 9 high, <= 14 medium, else low; null grade has no level."""
    g = F.col(c) if isinstance(c, str) else c
    return F.when(g.isNull(), None).when(g <= 9, "high").when(g <= 14, "medium").otherwise("low")


def quartile_edges(df: DataFrame, c: str) -> list[float]:
    edges = quantiles(df, {c: F.col(c)}, [0.0, 0.25, 0.5, 0.75, 1.0])[c]
    if edges[0] is None:
        raise ValueError("No valid grades found")
    return [float(v) for v in edges]


def equal_width_edges(df: DataFrame, c: str) -> tuple[list[float], float | None]:
    """Edges of 4 equal-width right-closed bins over the median-filled column.

    Same construction as ``pd.cut(x, 4)``: linspace(min, max, 5) with the first
    edge lowered by 0.1 % of the range so the minimum falls in the first bin.
    """
    mn, med, mx = quantiles(df, {c: F.col(c)}, [0.0, 0.5, 1.0])[c]
    if mn is None:
        raise ValueError("No valid grades found")
    mn, mx = float(mn), float(mx)
    if mn == mx:
        d = 0.001 * abs(mn) if mn != 0 else 0.001
        mn, mx = mn - d, mx + d
        step = (mx - mn) / 4
        edges = [mn + k * step for k in range(4)] + [mx]
    else:
        step = (mx - mn) / 4
        edges = [mn + k * step for k in range(4)] + [mx]
        edges[0] -= (mx - mn) * 0.001
    return edges, med


@dataclass
class BandState:
    """Fitted B4 / B5: right-closed edges, and the grade a missing one is set to (None: labelled Medium)."""
    edges: list[float]
    fill: float | None = None
    quartiles: bool = True


def fit_quantile_band(df: DataFrame, c: str) -> BandState:
    """B4 fit: quartile edges; where they repeat they cannot give four bins, so
    the equal-width scheme (B5) takes over, as in the reference's fallback."""
    edges = quartile_edges(df, c)
    if len(set(edges)) == len(edges):
        return BandState(edges)
    edges, med = equal_width_edges(df, c)
    return BandState(edges, med, False)


def fitted_band(c: str, st: BandState) -> Column:
    """The label of ``c`` under fitted edges."""
    g = F.col(c).cast("double")
    if st.quartiles:
        return right_closed_cut(g, st.edges, RISK_LABELS, other="Medium", include_lowest=True)
    return right_closed_cut(F.coalesce(g, F.lit(st.fill).cast("double")), st.edges, RISK_LABELS)


def equal_width_band(df: DataFrame, c: str, out: str = "risk_level") -> DataFrame:
    """Null grade set to the median, then 4 equal-width bins."""
    edges, med = equal_width_edges(df, c)
    return df.withColumn(out, fitted_band(c, BandState(edges, med, False)))


def quantile_band(df: DataFrame, c: str, out: str = "risk_level") -> DataFrame:
    """Quartile bins (lowest edge included), null grade Medium."""
    return df.withColumn(out, fitted_band(c, fit_quantile_band(df, c)))


def risk_bands(df: DataFrame, c: str = "G3", scheme: str = "loader",
               out: str = "risk_level") -> DataFrame:
    """Dispatch on ``scheme``: loader, percent, threshold, quantile, equal_width, dashboard."""
    if scheme == "loader":
        return df.withColumn(out, loader_band(c))
    if scheme == "percent":
        return df.withColumn(out, percent_band(c))
    if scheme == "threshold":
        return df.withColumn(out, threshold_band(c))
    if scheme == "quantile":
        return quantile_band(df, c, out)
    if scheme == "equal_width":
        return equal_width_band(df, c, out)
    if scheme == "dashboard":
        return df.withColumn(out, dashboard_level(c))
    raise ValueError(f"Unknown band scheme: {scheme}")
