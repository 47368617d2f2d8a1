"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

The rows are dealt to shards, the queries to block files in the shared folder.
A task holds one shard at a time and streams the query blocks past it; a tile
is the matrix product of some queries with the shard, of which only each query's
best ``k`` rows leave the task.  The lists of the shards are then merged some at
a time until each query has one.  No row is replicated: the shards are read
once, and a task's memory is bounded by the shard, the block and the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import ship_package
from cohortlens.llm.vectors import (SCALE, TILE_SCORES, best, code_vectors, in_id_order, matrices, merge_lists,
                                    read_blocks, shards, write_blocks)

LISTS = "query_row bigint, query_id bigint, shard int, row bigint, id bigint, score bigint"


def _tiles(folder: str, width: int, k: int, kind: type):
    """Task: each shard against every query block, the best ``k`` of each tile's queries."""

    def product(queries: pa.Table, shard: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        rows = matrices(shard["code"])
        query_row, row = queries["row"].to_numpy(), shard["row"].to_numpy()
        none = -np.inf if kind is np.float64 else -np.iinfo(np.int64).max
        for d, (places, q) in matrices(queries["code"]).items():
            if d not in rows:
                continue
            at, c = rows[d]
            c = c.astype(kind).T
            step = max(1, TILE_SCORES // len(at))
            for i in range(0, len(places), step):
                part = places[i:i + step]
                scores = q[i:i + step].astype(kind) @ c
                scores[query_row[part][:, None] == row[at][None, :]] = none
                a, b = best(scores, k)
                value = scores[a, b]
                a, b, value = a[value != none], b[value != none], value[value != none]
                yield pa.RecordBatch.from_pydict({
                    "query_row": query_row[part[a]], "query_id": queries["id"].take(pa.array(part[a])).combine_chunks(),
                    "shard": np.full(len(a), number, np.int32), "row": row[at[b]],
                    "id": shard["id"].take(pa.array(at[b])).combine_chunks(), "score": value.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for shard in shards(batches, width):
            shard = in_id_order(shard)
            for queries in read_blocks(folder):
                yield from product(queries, shard, number)

    return run


def nearest_rows(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: int = SCALE) -> DataFrame:
    """(query_row, query_id, rank, id, score): for each row where ``is_query``, the ``k`` other rows of highest score.

    A score is the inner product of the coded vectors; equal scores go by
    smaller id (null ids last, rows of one id in any order).  Only the query's
    own row is left out, so rows that repeat it are found.  Vectors that are
    null or hold a null or non-finite component take no part; vectors meet only
    others of as many components (empty ones score 0).  Fewer rows than ``k``
    give shorter lists; an empty table or no query gives no rows.  Products are
    taken in doubles while every sum is below 2**53 and in 64-bit integers beyond.
    """
    ship_package()
    coded = code_vectors(vectors, F.col(vec_col), "search", scale, id=F.col(id_col).cast("bigint"),
                         wanted=F.coalesce(is_query, F.lit(False)))
    queries = coded.rows.filter("wanted").select("row", "id", "code")
    folder = write_blocks(queries, queries.count(), "search-queries", "row")
    kind = np.float64 if coded.score_bound < 1 << 53 else np.int64
    dealt = coded.rows.select("row", "id", "code").repartition(coded.shards, "row")
    lists = dealt.mapInArrow(_tiles(folder, coded.dims, k, kind), LISTS)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    # the tool that runs this may deal out more partitions than asked for
    n_shards = max(coded.shards, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return merge_lists(lists, ["query_row", "query_id"], order, k, n_shards).select(
        "query_row", "query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
