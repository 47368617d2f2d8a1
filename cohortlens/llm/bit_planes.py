"""Hard negatives by Four-Russians scoring.

Candidates are stored as packed bit planes: plane ``b`` of a vector holds bit
``b`` of every component (two's complement), eight dimensions to a byte.  For an
anchor and each group of eight dimensions a table of the 256 subset sums of its
components is built once.  A candidate's byte indexes the table, so a plane's
sum is one lookup for each group, and the planes are put together by shift and
add, the sign plane negative: the full inner product, exactly.

Two passes over the packed candidates, each with partial selection in the task
and tree merging of the shards' lists: first each anchor's nearest rows of its
own label, then, for each distinct positive score, the highest-scoring rows of
other labels inside that positive's score range.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import settled, ship_package
from cohortlens.llm.vectors import (SCALE, best, code_vectors, in_id_order, matrices, merge_lists, read_blocks, shards,
                                    write_blocks)

GROUP = 8
#: anchors that share one table array; candidates looked up at once
ANCHORS, CANDIDATES = 64, 4096


class Range(NamedTuple):
    """A negative's score s for a positive's score p: low * p <= unit * s <= high * p."""
    low: int = 50
    high: int = 95
    unit: int = 100


def planes_for(largest: int) -> int:
    """Bits of two's complement that hold every component up to ``largest`` in size."""
    return int(largest).bit_length() + 1


def pack(matrix: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes; bit i of a byte belongs to dimension i of its group."""
    n, d = matrix.shape
    groups = -(-d // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :d] = matrix
    out = np.empty((n, planes, groups), np.uint8)
    for b in range(planes):
        out[:, b] = np.packbits(((full >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): at byte s of a group, the sum of the anchor's components whose bit is set in s."""
    n, d = anchors.shape
    groups = -(-d // GROUP)
    full = np.zeros((n, groups * GROUP), kind)
    full[:, :d] = anchors
    by_group = full.reshape(n, groups, GROUP)
    table = np.zeros((groups, 1 << GROUP, n), kind)
    for i in range(GROUP):  # the sums with bit i set are those without it plus component i
        table[:, 1 << i:2 << i] = table[:, :1 << i] + by_group[:, :, i].T[:, None, :]
    return table


def lookup_scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products: one lookup for each plane and group, planes joined by shift and add.

    ``codes`` is (planes, groups, candidates).
    """
    planes, groups, n = codes.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    found = np.empty_like(total)
    for b in reversed(range(planes)):
        np.left_shift(total, 1, out=total)
        for g in range(groups):
            np.take(table[g], codes[b, g], axis=0, out=found, mode="clip")
            if b == planes - 1:  # the sign plane
                np.subtract(total, found, out=total)
            else:
                np.add(total, found, out=total)
    return total


def _pack_rows(planes: int):
    """Task: codes -> packed planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (at, matrix) in matrices(batch["code"]).items():
                raw = pack(matrix, planes).reshape(len(at), -1)
                take = batch.select(["row", "id", "label"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    *take.columns, pa.array(np.full(len(at), d, np.int32)),
                    pa.array([r.tobytes() for r in raw], pa.binary())], ["row", "id", "label", "dims", "planes"])

    return run


class _Shard:
    """Candidates of one label set and width in id order, their bytes as lookup indices."""

    def __init__(self, t: pa.Table, planes: int):
        self.table = t = in_id_order(t)
        self.row, self.label, self.dims = t["row"].to_numpy(), t["label"].to_numpy(), t["dims"].to_numpy()
        self.raw, self.planes = t["planes"].combine_chunks(), planes

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Lookup indices (planes, groups, candidates) of rows of one width."""
        groups = -(-int(self.dims[at[0]]) // GROUP)
        raw = b"".join(self.raw.take(pa.array(at)).to_pylist())
        packed = np.frombuffer(raw, np.uint8).reshape(len(at), self.planes, groups)
        return np.ascontiguousarray(packed.transpose(1, 2, 0)).astype(np.intp)


def _tiles(anchors: pa.Table, kind: type, same_label: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, label, anchor places, tables) of up to ``ANCHORS`` anchors of one width and, if asked for, one label."""
    label = anchors["label"].to_numpy()
    for d, (places, matrix) in matrices(anchors["code"]).items():
        parts = [np.flatnonzero(label[places] == v) for v in np.unique(label[places])] if same_label else [
            np.arange(len(places))]
        for part in parts:
            for i in range(0, len(part), ANCHORS):
                at = part[i:i + ANCHORS]
                yield d, label[places[at]], places[at], subset_sums(matrix[at], kind)


def _positives(folder: str, width: int, planes: int, kind: type, k: int):
    """Task: the ``k`` best rows of an anchor's own label in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        none = -np.iinfo(kind).max
        for t in shards(batches, width):
            shard = _Shard(t, planes)
            for anchors in read_blocks(folder):
                anchor_row = anchors["row"].to_numpy()
                at_key, codes = None, []
                for d, labels, places, table in _tiles(anchors, kind, True):
                    if at_key != (d, labels[0]):
                        at_key = d, labels[0]
                        own = np.flatnonzero((shard.label == labels[0]) & (shard.dims == d))
                        codes = [(own[i:i + CANDIDATES], shard.codes(own[i:i + CANDIDATES]))
                                 for i in range(0, len(own), CANDIDATES)]
                    for at, code in codes:
                        scores = lookup_scores(table, code).T
                        scores[anchor_row[places][:, None] == shard.row[at][None, :]] = none
                        a, b = best(scores, k)
                        value = scores[a, b]
                        a, b, value = a[value != none], b[value != none], value[value != none]
                        yield pa.RecordBatch.from_pydict({
                            "anchor_row": anchor_row[places[a]],
                            "anchor_id": anchors["id"].take(pa.array(places[a])).combine_chunks(),
                            "shard": np.full(len(a), number, np.int32), "row": shard.row[at[b]],
                            "id": shard.table["id"].take(pa.array(at[b])).combine_chunks(),
                            "score": value.astype(np.int64)})

    return run


def _negatives(folder: str, width: int, planes: int, kind: type, k: int):
    """Task: for each anchor and score range, the ``k`` best rows of other labels in each shard."""

    def chosen(scores: np.ndarray, lows: list[int], highs: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(range number, places) of the first ``k`` of one anchor's scores (candidates in id order) in each range."""
        near = np.flatnonzero((scores >= min(lows)) & (scores <= max(highs)))
        near = near[np.argsort(-scores[near], kind="stable")]
        falling = -scores[near]
        for i, (low, high) in enumerate(zip(lows, highs)):
            first = np.searchsorted(falling, -high, "left")
            end = min(np.searchsorted(falling, -low, "right"), first + k)
            if first < end:
                yield i, near[first:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for t in shards(batches, width):
            shard = _Shard(t, planes)
            by_dims = {}
            for d in np.unique(shard.dims).tolist():
                own = np.flatnonzero(shard.dims == d)
                by_dims[d] = [own[i:i + CANDIDATES] for i in range(0, len(own), CANDIDATES)]
            for anchors in read_blocks(folder):
                anchor_row = anchors["row"].to_numpy()
                positive, lows, highs = (anchors[c].to_pylist() for c in ("positive_scores", "lows", "highs"))
                tiles = list(_tiles(anchors, kind, False))
                for d, pieces in by_dims.items():
                    for at in pieces:
                        code, out = shard.codes(at), []
                        for dims, labels, places, table in tiles:
                            if dims != d:
                                continue
                            scores = lookup_scores(table, code).T.astype(np.int64)
                            other = shard.label[at][None, :] != labels[:, None]
                            for j, p in enumerate(places.tolist()):
                                where = np.flatnonzero(other[j])
                                if not len(where):
                                    continue
                                for i, got in chosen(scores[j][where], lows[p], highs[p]):
                                    hit = where[got]
                                    out += [(anchor_row[p], positive[p][i], number, shard.row[at[h]], int(at[h]),
                                             scores[j, h]) for h in hit.tolist()]
                        if out:
                            a, p, n, r, h, s = zip(*out)
                            yield pa.RecordBatch.from_pydict({
                                "anchor_row": np.array(a, np.int64), "positive_score": np.array(p, np.int64),
                                "shard": np.array(n, np.int32), "row": np.array(r, np.int64),
                                "id": shard.table["id"].take(pa.array(h)).combine_chunks(),
                                "score": np.array(s, np.int64)})

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3,
                   bounds: Range = Range(), id_col: str = "vec_id", vec_col: str = "embedding",
                   scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where ``is_anchor``.

    An anchor's positives are its ``n_positives`` best other rows of its label,
    its hard negatives for a positive the ``n_negatives`` best rows of other
    labels whose score lies in ``bounds`` of the positive's.  Higher scores come
    first, equal ones by smaller id (null ids last, rows of one id in any order).
    Rows with a null label, a null vector or a null or non-finite component take
    no part; vectors meet only others of as many components.  Repeated rows are
    rows of their own.  A positive without such negatives gives no row, nor does
    an empty table.  Tables are 32-bit while every score fits, else 64-bit.
    """
    ship_package()
    coded = code_vectors(vectors.filter(label.isNotNull()), F.col(vec_col), "negatives", scale,
                         id=F.col(id_col).cast("bigint"), label=label.cast("bigint"),
                         wanted=F.coalesce(is_anchor, F.lit(False)))
    planes = planes_for(coded.largest)
    # partial sums while shifting stay below the number of planes' worth of the anchor's absolute sum
    bound = coded.dims * coded.largest << planes
    if bound >= 1 << 62:
        raise ArithmeticError(f"components of up to {coded.largest} give partial sums beyond 64 bits")
    kind = np.int32 if bound < 1 << 30 else np.int64
    packed = settled(coded.rows.select("row", "id", "label", "code").repartition(coded.shards, "row").mapInArrow(
        _pack_rows(planes), "row bigint, id bigint, label bigint, dims int, planes binary"), "negatives-planes")
    n_shards = packed.rdd.getNumPartitions()
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    anchors = coded.rows.filter("wanted").select("row", "id", "label", "code")
    n_anchors = anchors.count()
    folder = write_blocks(anchors, n_anchors, "negatives-anchors", "label", "row")
    found = packed.mapInArrow(_positives(folder, coded.dims, planes, kind, n_positives),
                             "anchor_row bigint, anchor_id bigint, shard int, row bigint, id bigint, score bigint")
    positives = settled(merge_lists(found, ["anchor_row", "anchor_id"], order, n_positives, n_shards).select(
        "anchor_row", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "negatives-positives")
    p = F.col("positive_score")
    # ceil(low * p / unit) and floor(high * p / unit) in whole numbers
    floor = "({0} * positive_score - pmod({0} * positive_score, {1})) div {1}".format
    low, high = F.expr(f"-({floor(f'({-bounds.low})', bounds.unit)})"), F.expr(floor(f"({bounds.high})", bounds.unit))
    ranges = positives.select("anchor_row", p, low.alias("low"), high.alias("high")).filter("low <= high").distinct()
    ranges = ranges.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("positive_score", "low", "high"))).alias("r"))
    ranges = ranges.select("anchor_row", F.col("r.positive_score").alias("positive_scores"), F.col("r.low").alias("lows"),
                           F.col("r.high").alias("highs"))
    with_ranges = anchors.join(ranges, anchors["row"] == ranges["anchor_row"]).drop("anchor_row")
    folder = write_blocks(with_ranges, n_anchors, "negatives-ranges", "label", "row")
    found = packed.mapInArrow(_negatives(folder, coded.dims, planes, kind, n_negatives),
                             "anchor_row bigint, positive_score bigint, shard int, row bigint, id bigint, score bigint")
    lists = merge_lists(found, ["anchor_row", "positive_score"], order, n_negatives, n_shards)
    lists = lists.select("anchor_row", "positive_score", F.col("rank").cast("int").alias("rank"),
                         F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(lists, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
