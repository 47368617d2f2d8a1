"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import settled

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge table (u, v): label is the least node of its component.

    Self loops and repeated edges do no harm; each round is written to the shared
    folder.  Raises if ``MAX_ROUNDS`` do not settle it.
    """
    state = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        state = settled(_stars(_stars(state, True), False), "edges")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            nodes = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        mark = now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
