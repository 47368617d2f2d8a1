"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated for up to
``max_epochs`` rounds.  A copy's virtual finish time is the tokens its source
has sent up to and with it, divided by the source's target.  All copies are
ordered by finish time (ties by source, key, round) and cut where their running
total would pass the total budget.  A source queues no copy that starts at time 1
or later, when its target is sent: a long document that the cut leaves out must
not fill the mix with other sources.  So of the copies that straddle time 1, one a
source, the cut takes those that end first and fit; each source ends within one
document of its target, and all sources within one document of the budget.

DataFrame functions only.  Running totals are sums over small cells plus a
window inside one cell, so a source with a third of all rows is spread over many
tasks, and the global order is a range sort by finish time buckets.  Documents
that send nothing are spread over buckets of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.words import WORD

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: rows of a cell (one window group) on average
CELL_ROWS = 4_000
#: finish times from this on share one bucket, which holds at most one copy a source
LAST_FINISH = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(id_col: Column, text: Column, seed: str) -> Column:
    """A rerun-stable random order: md5 of seed, id and text."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")),
                             F.coalesce(text, F.lit(""))).cast("binary"))


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus position, weight, target.

    Sources in code point order (null last) take the weights in turn and share
    the sum of all sizes; a target stops at ``max_epochs`` times its source's size
    and the excess is shared by weight among the others until none is above.
    In order of cap / weight that is: cap a source while its cap is at most its
    share of what the earlier caps leave.  One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = totals.withColumn("position", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                            (F.col("position") - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * max_epochs) \
         .withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    t = t.withColumn("rank", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("caps_before", F.sum("cap").over(upto) - F.col("cap")) \
         .withColumn("weights_left", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    t = t.withColumn("unit", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
    t = t.withColumn("capped", F.min(F.col("cap") / F.col("weight") <= F.col("unit")).over(upto))
    t = t.withColumn("free_unit", F.min(F.when(~F.col("capped"), F.struct("rank", "unit"))).over(everything)["unit"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free_unit") * F.col("weight"))
    return t.select("source", "source_size", "position", "weight", target.alias("target"), "total")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, key, source, size, source_size, target, taken, copies) of every row of ``docs``.

    ``taken`` is ``copies`` times ``size``.  A null text has size 0; null sources
    are one source; sources without words have target 0 and nothing is taken;
    rows alike in id and text are ordered arbitrarily among themselves (their
    results are the same as a set); an empty table gives no rows.
    """
    n = docs.select(id_col).count()
    cells, finish_cells = max(1, math.ceil(n / cell_rows)), max(64, math.ceil(max_epochs * n / cell_rows))
    key = shuffle_key(F.col(id_col), F.col(text_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("place", place)
    rows = rows.withColumn("cell", F.floor(F.col("place") * cells / F.lit(1 << 32)).cast("int"))
    sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("sent", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    a, b = starts.alias("a"), targets.alias("b")
    starts = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "b.position", "a.cell", "a.sent", "a.source", "b.source_size", "b.target", "b.total")
    order = Window.partitionBy("source", "cell").orderBy("key")
    rows = rows.withColumn("rank", F.row_number().over(order)) \
               .withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    a, b = rows.alias("a"), starts.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.cell") == F.col("b.cell"))).select(
        "a.id", "a.key", "a.source", "a.size", "a.place", "a.cell", "a.rank", "b.position", "b.source_size", "b.target", "b.total",
        (F.col("b.sent") + F.col("a.inside")).alias("sent"))
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target")))
    began = (F.col("epoch") * F.col("source_size") + F.col("sent") - F.col("size")) / F.col("target") < 1
    copies = copies.withColumn("queued", F.coalesce(F.when(F.col("target") > 0, began), F.lit(False))) \
        .filter(F.col("queued") | (F.col("epoch") == 0))
    copies = copies.withColumn("finish_cell", F.when(
        F.col("queued"), F.floor(F.least(F.col("finish"), F.lit(float(LAST_FINISH))) * finish_cells))
        .otherwise(-1 - F.col("place") % finish_cells).cast("bigint"))
    finish_sums = copies.groupBy("finish_cell").agg(F.sum(F.when(F.col("queued"), F.col("size")).otherwise(0)).alias("n"))
    earlier = Window.orderBy("finish_cell").rowsBetween(Window.unboundedPreceding, -1)
    finish_sums = finish_sums.select("finish_cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    line = Window.partitionBy("finish_cell").orderBy("finish", "position", "key", "epoch", "rank") \
        .rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("inside", F.sum("size").over(line)).join(finish_sums, "finish_cell")
    is_in = F.col("queued") & (F.col("ahead") + F.col("inside") <= F.col("total"))
    return copies.groupBy("id", "key", "source", "position", "cell", "rank", "size", "source_size", "target").agg(
        F.sum(F.when(is_in, F.col("size")).otherwise(0)).alias("taken"),
        F.sum(F.when(is_in, 1).otherwise(0)).alias("copies")).select(
        "id", "key", "source", "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan takes it, with the columns of ``docs``."""
    plan = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    wanted = plan.groupBy("key", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"),
                        shuffle_key(F.col(id_col), F.col(text_col), seed).alias("key"))
    a, b = keyed.alias("a"), wanted.filter("copies > 0").alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.row", "b.key", "b.source", "b.copies", "b.rows")
    # rows alike in id, text and source share their copies
    nth = F.row_number().over(Window.partitionBy("key", "source").orderBy(F.xxhash64("row")))
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    both = both.withColumn("share", share.cast("int"))
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("share")))).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
