"""Integer-coded vectors, block files of queries and merged top lists (the vector searches build on these).

A component ``x`` is coded as ``floor(256 * x)`` in doubles, so scores are exact
integers.  Rows are told apart by a number of their own, given when the coded
table is written; ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import open_fs, settled

SCALE = 256
#: components of a shard held by a task at once; rows of a query block; scores of a tile at once
SHARD_VALUES, BLOCK_ROWS, TILE_SCORES = 4 << 20, 4096, 4 << 20
#: top lists of so many shards are merged at a time
FAN_IN = 16


class Coded(NamedTuple):
    """Coded rows (row, id, ..., code), their number, the most components, the largest |code|, and scan partitions."""
    rows: DataFrame
    n: int
    dims: int
    largest: int
    shards: int

    @property
    def score_bound(self) -> int:
        return self.dims * self.largest * self.largest


def code_vectors(vectors: DataFrame, vec: Column, name: str, scale: int = SCALE, **columns: Column) -> Coded:
    """The rows whose vector is complete and finite, written once with ``columns`` and their own row number.

    A score is at most dims * largest**2; where that does not fit in 64 bits
    this raises instead of returning wrong scores.
    """
    numbers = F.transform(vec, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.filter(vec.isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in columns.items()],
        F.transform(numbers, lambda x: F.floor(x * F.lit(float(scale)))).alias("code"))
    spark = vectors.sparkSession
    rows = settled(rows, f"{name}-codes")
    fact = rows.agg(F.count("*").alias("n"), F.max(F.size("code")).alias("dims"), F.max(F.greatest(
        F.abs(F.array_max("code")), F.abs(F.array_min("code")))).alias("largest")).first()
    n, dims, largest = fact["n"], fact["dims"] or 0, fact["largest"] or 0
    if dims * largest * largest >= 1 << 63:
        raise ArithmeticError(f"{dims} components of up to {largest} each give scores beyond 64 bits")
    shards = max(spark.sparkContext.defaultParallelism, -(-n * dims // SHARD_VALUES))
    return Coded(rows, n, dims, largest, shards)


def write_blocks(rows: DataFrame, n: int, name: str, *by: str) -> str:
    """``rows`` in files of about ``BLOCK_ROWS`` each; the folder that tasks read them from."""
    from cohortlens.llm.shared import new_folder

    folder = new_folder(rows.sparkSession, name)
    many = max(1, -(-n // BLOCK_ROWS))
    dealt = rows.repartitionByRange(many, *by) if many > 1 else rows.coalesce(1)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(folder)
    return folder


def read_blocks(folder: str) -> Iterator[pa.Table]:
    """The block files one after another, as one task sees them."""
    fs, path = open_fs(folder)
    from pyarrow.fs import FileSelector

    for info in sorted(fs.get_file_info(FileSelector(path)), key=lambda i: i.path):
        if info.base_name.startswith("part-"):
            t = pq.read_table(info.path, filesystem=fs, partitioning=None)
            for at in range(0, t.num_rows, BLOCK_ROWS):
                yield t.slice(at, BLOCK_ROWS).combine_chunks()


def shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The batches of a task put together into shards of bounded size."""
    most, part, n = max(1, SHARD_VALUES // max(1, width)), [], 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            piece = b.slice(at, most)
            if part and n + piece.num_rows > most:
                yield pa.Table.from_batches(part).combine_chunks()
                part, n = [], 0
            part.append(piece)
            n += piece.num_rows
    if part:
        yield pa.Table.from_batches(part).combine_chunks()


def in_id_order(t: pa.Table) -> pa.Table:
    """Rows by ascending id, null ids last, then row number."""
    null = t["id"].is_null().to_numpy()
    return t.take(pa.array(np.lexsort((t["row"].to_numpy(), t["id"].fill_null(0).to_numpy(), null))))


def matrices(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{number of components: (places, matrix)} of a list column without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    values, size = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[d] = at, values[(start[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest values of each row, equal ones by smaller column."""
    n, m = scores.shape
    if m > k:
        limit = np.partition(scores, m - k, axis=1)[:, m - k, None]
        row, col = np.nonzero(scores >= limit)
    else:
        row, col = np.divmod(np.arange(n * m), max(m, 1))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k
    return row[keep], col[keep]


def merge_lists(lists: DataFrame, keys: list[str], order: list[Column], k: int, n_shards: int,
                fan_in: int = FAN_IN) -> DataFrame:
    """Merge the top lists of ``n_shards`` shards (column ``shard``) ``fan_in`` at a time until one is left; adds rank.

    Each level keeps ``k`` rows of a list, so what is shuffled shrinks by the fan-in.
    """
    while True:
        n_shards = -(-n_shards // fan_in)
        last = n_shards <= 1
        lists = lists.withColumn("shard", F.lit(0) if last else F.floor(F.col("shard") / fan_in).cast("int"))
        rank = F.row_number().over(Window.partitionBy(*keys, "shard").orderBy(*order))
        lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
        if last:
            return lists.drop("shard")
        lists = lists.drop("rank")
