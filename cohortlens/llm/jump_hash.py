"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A stable 64-bit key walks through the shard counts at which it would move and
stops at the last one below the wanted count: no ring table, and one more shard
takes rows only into itself, 1 / (n + 1) of them.

Slots number the rows of a shard without gaps.  They come from counts of small
(shard, bucket) cells, so no task sorts a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import ship_package

#: rows of a shard that one slot cell (one window group) holds on average
CELL_ROWS = 20_000
_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``shards``."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * _MULTIPLIER + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = np.floor((shard[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard number of a bigint column; a null key goes where key 0 goes."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    ship_package()

    @F.arrow_udf("int")
    def place(col: pa.Array) -> pa.Array:
        keys = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array(jump_hash(keys, shards).astype(np.int32), pa.int32())

    return place(key.cast("bigint"))


def shard_documents(docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 16, ``grown_shard`` the shard
    with one more, ``slot`` the place in the shard by md5 of the key, then crc and
    size.  A null or empty text has size 16 and crc 0; a null key counts
    as 0 for the shard; equal rows share a shard and get neighbouring slots; an
    empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(key_col).alias("key"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", jump_shard(F.col("key"), shards)) \
               .withColumn("grown_shard", jump_shard(F.col("key"), shards + 1))
    cells = max(1, math.ceil(docs.select(key_col).count() / (shards * CELL_ROWS)))
    # a fixed random order of the rows; a cell is a range of it
    rows = rows.withColumn("turn", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")))
    place = F.conv(F.substring("turn", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("cell", F.floor(place * cells / F.lit(1 << 32)).cast("int"))
    # one number for each cell: a row of counts per (shard, cell)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")) \
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("turn", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "cell"])
    return placed.select(F.col("key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("offset") + F.col("rank") - 1).cast("bigint").alias("slot"), "grown_shard")
