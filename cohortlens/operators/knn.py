"""Exact k-nearest neighbours (J6) and kNN classification (M7), pruned by the triangle inequality.

1. Up to ``MAX_PIVOTS`` candidates, a seeded sample, are pivots; every candidate
   belongs to the cell of its nearest pivot and keeps its distance to it. The
   cells are written to the shared folder, one folder each, by that distance.
2. Every query goes to one group of queries of near-by cells and travels once.
   A group's task streams the cells past it, nearest first, and keeps each
   query's k best so far.
3. A query leaves out the cells whose nearest possible point, d(q, pivot) -
   radius, is beyond its k-th best, and inside a cell the tiles whose distances
   to the pivot differ from its own by more than that.
4. A tile is screened first: euclidean distances by one matrix product, Manhattan
   distances by one that leaves out components in which both lie between the same
   two marks (so it is never more than the distance), or in single precision, each
   with the bound of its rounding error. Only pairs that the screen cannot refute
   get their distance, in doubles, and equal distances go by candidate id.

Nothing is approximated and no row is copied: where the data have no structure
that the bound could use, every query meets every cell, and a task still holds
one group, one tile and k rows a query. A small set of queries is sent to the
candidates' tasks instead, and nothing but the k best of each task is shuffled.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import checkpoint_dir, discard, qualified, written

METRICS = ("euclidean", "manhattan", "minkowski")
#: pivots at most; candidates of a cell aimed at; values of a query set that is sent to the tasks; rows of a file of a cell
MAX_PIVOTS, CELL_ROWS, SMALL_VALUES, FILE_ROWS = 256, 512, 1 << 18, 1 << 14
#: tiles of queries in a group; pairs screened at once (euclidean, Manhattan)
GROUP_TILES, PRODUCT_PAIRS, SINGLE_PAIRS = 4, 1 << 20, 1 << 16
#: ranges into which the marks cut a component, queries from which a tile is screened that way, and pairs screened at once
MARKED, LEAST_MARKED, MARKED_PAIRS = 4, 64, 1 << 20
#: slack of the bounds for rounding; components up to which single precision may screen
SLACK, SINGLE_MAX = 1e-9, 1e30

NEIGHBORS = "query_id long, neighbor_id long, distance double, neighbor_label int"


def _distances(q: np.ndarray, c: np.ndarray, metric: str, p: float) -> np.ndarray:
    """(queries, candidates) distances."""
    return _lengths(q[:, None, :] - c[None, :, :], metric, p)


def _lengths(diff: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of differences along the last axis."""
    if metric == "manhattan" or metric == "minkowski" and p == 1:
        return np.abs(diff).sum(axis=-1)
    if metric == "euclidean" or p == 2:
        return np.sqrt((diff * diff).sum(axis=-1))
    return (np.abs(diff) ** p).sum(axis=-1) ** (1 / p)


def _chunked(q: np.ndarray, c: np.ndarray, metric: str, p: float, values: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, values // max(1, c.size))
    for s in range(0, len(q), step):
        yield s, _distances(q[s:s + step], c, metric, p)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


class _Nearest:
    """The ``k`` nearest candidates so far of each of some queries, equal distances by candidate id.

    ``bound`` is never below a query's k-th distance; it falls with every tile."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, p: float, exclude_self: bool):
        self.qids, self.q, self.k, self.metric, self.p, self.exclude_self = qids, q, k, metric, p, exclude_self
        self.kind = "single" if metric == "manhattan" or metric == "minkowski" and p == 1 else \
            "product" if metric == "euclidean" or p == 2 else "plain"
        self.bound = np.full(len(q), np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))  # row, distance, id, label
        self.pending, self.n_pending = [], 0
        with np.errstate(all="ignore"):
            self.reach = np.sqrt((q * q).sum(axis=1)) if self.kind == "product" else np.abs(q).sum(axis=1)
        self.single = self.kind == "single" and bool((np.abs(q) < SINGLE_MAX).all())
        if self.single:
            self.q32 = np.ascontiguousarray(q.T.astype(np.float32))
            # any marks do: those that deal these queries evenly leave out least
            self.marks = np.quantile(q, np.arange(1, MARKED) / MARKED, axis=0) if len(q) else np.zeros((MARKED - 1, q.shape[-1]))
            self.range, self.rows32 = self._ranges(q), q.astype(np.float32)

    def _ranges(self, x: np.ndarray) -> np.ndarray:
        """The range of each component among the marks."""
        out = np.zeros(x.shape, np.int8)
        for m in self.marks:
            out += x > m
        return out

    def _marked(self, c: np.ndarray):
        """``_screen`` for queries with a bound: the sum of the component distances between different ranges; last,
        whether single precision cannot refute a pair either.

        With a in range i, b in range j and s the sign of j - i that is s b - s a: a
        product of (1, a) at i on one side with (s, -s) (b, 1) for every i on the other."""
        d, far = c.shape[1], np.abs(c).sum(axis=1).max()
        told, c32 = self._ranges(c).T, c.T.astype(np.float32)
        other = np.empty((MARKED, 2, d, len(c)), np.float32)
        for i in range(MARKED):
            np.sign(told - i, out=other[i, 1], casting="unsafe")
            np.multiply(other[i, 1], c32, out=other[i, 0])
            np.negative(other[i, 1], out=other[i, 1])
        other = other.reshape(2 * MARKED * d, len(c))

        def sums(r: np.ndarray) -> np.ndarray:
            own = np.zeros((len(r), MARKED, 2, d), np.float32)
            at, component = np.arange(len(r))[:, None], np.arange(d)[None, :]
            own[at, self.range[r], 0, component] = 1
            own[at, self.range[r], 1, component] = self.q32[:, r].T
            return own.reshape(len(r), -1) @ other

        rows32 = np.ascontiguousarray(c32.T)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.empty(len(i), bool)
            for s in range(0, len(i), 4096):  # small pieces stay in the cache
                a = i[s:s + 4096]
                diff = self.rows32[a]
                diff -= rows32[j[s:s + 4096]]
                out[s:s + 4096] = ~(np.abs(diff, out=diff).sum(axis=1) > limit(2 * d + 8, a, self.bound[a]))
            return out

        def limit(n: int, r: np.ndarray, x: np.ndarray) -> np.ndarray:
            return (x * (1 + 1e-6) + SLACK + n * 2.0 ** -23 * (self.reach[r] + far)).astype(np.float32)

        return MARKED_PAIRS, sums, lambda r, x: limit(4 * MARKED * d + 16, r, x), None, near

    def _screen(self, c: np.ndarray):
        """(pairs at once, function of some rows -> their screen values against ``c``, function (rows, distance) ->
        the least screen value that refutes a distance up to this, function (rows, screen value) -> a distance that
        the pair cannot exceed)."""
        d = c.shape[1]
        if self.kind == "product":
            norm = (c * c).sum(axis=1)
            far = np.sqrt(norm.max())
            turned = np.vstack([-2.0 * c.T, norm[None, :]])
            slack = lambda r: 4 * (d + 8) * 2.0 ** -53 * (self.reach[r] + far) ** 2
            return (PRODUCT_PAIRS, lambda r: np.hstack([self.q[r], np.ones((len(r), 1))]) @ turned,
                    lambda r, x: (x * (1 + SLACK) + SLACK) ** 2 + slack(r) - self.reach[r] ** 2,
                    lambda r, v: np.sqrt(np.maximum(v + self.reach[r] ** 2 + slack(r), 0.0)))
        if self.single and (np.abs(c) < SINGLE_MAX).all():
            c32, far = np.ascontiguousarray(c.T.astype(np.float32)), np.abs(c).sum(axis=1).max()

            def sums(r: np.ndarray) -> np.ndarray:
                q32 = self.q32[:, r]
                total, part = np.zeros((len(r), len(c)), np.float32), np.empty((len(r), len(c)), np.float32)
                for j in range(d):
                    np.subtract(q32[j][:, None], c32[j][None, :], out=part)
                    np.abs(part, out=part)
                    total += part
                return total

            slack = lambda r: 2 * (d + 4) * 2.0 ** -23 * (self.reach[r] + far)
            # compared in single precision: the limit is rounded as well
            return (SINGLE_PAIRS, sums, lambda r, x: (x * (1 + 1e-6) + SLACK + slack(r)).astype(np.float32),
                    lambda r, v: v.astype(np.float64) + slack(r))
        return (max(1, (1 << 21) // max(1, d)), lambda r: _distances(self.q[r], c, self.metric, self.p),
                lambda r, x: x * (1 + SLACK) + SLACK, lambda r, v: v)

    def meet(self, rows: np.ndarray, cids: np.ndarray, labels: np.ndarray, c: np.ndarray) -> None:
        """Take the candidates of one tile into account for the queries ``rows``."""
        if not len(rows) or not len(c):
            return
        with np.errstate(all="ignore"):
            bounded = rows[np.isfinite(self.bound[rows])] if self.single else rows[:0]
            if len(bounded) < LEAST_MARKED or not (np.abs(c) < SINGLE_MAX).all():
                self._meet(rows, cids, labels, c, self._screen(c))
                return
            self._meet(bounded, cids, labels, c, self._marked(c))
            if len(bounded) < len(rows):
                self._meet(rows[~np.isfinite(self.bound[rows])], cids, labels, c, self._screen(c))

    def _meet(self, rows: np.ndarray, cids: np.ndarray, labels: np.ndarray, c: np.ndarray, screen) -> None:
        with np.errstate(all="ignore"):
            pairs, values, limit, at_most, *near = screen
            step = max(1, pairs // len(c))
            for s in range(0, len(rows), step):
                r = rows[s:s + step]
                v = values(r)
                new = np.flatnonzero(np.isinf(self.bound[r]))
                if len(new) and len(c) >= self.k:
                    # no bound yet: the k-th of this tile gives one
                    some = v[new]
                    if self.exclude_self:
                        some[self.qids[r[new]][:, None] == cids[None, :]] = np.inf
                    self.bound[r[new]] = at_most(r[new], np.partition(some, self.k - 1, axis=1)[:, self.k - 1])
                i, j = np.nonzero(~(v > limit(r, self.bound[r])[:, None]))
                i = r[i]
                for refine in near:
                    left = refine(i, j)
                    i, j = i[left], j[left]
                if self.exclude_self:
                    other = self.qids[i] != cids[j]
                    i, j = i[other], j[other]
                # pairs in pieces: one tile can leave many where distances are equal
                for t in range(0, len(i), PRODUCT_PAIRS // 8):
                    a, b = i[t:t + PRODUCT_PAIRS // 8], j[t:t + PRODUCT_PAIRS // 8]
                    self.pending.append((a, _lengths(self.q[a] - c[b], self.metric, self.p), cids[b], labels[b]))
                    self.n_pending += len(a)
                    if self.n_pending > max(1 << 16, len(self.best[0])):
                        self.settle()

    def settle(self) -> None:
        """Keep the ``k`` best of what was found since."""
        if not self.pending:
            return
        row, d, cid, label = (np.concatenate(x) for x in zip(self.best, *self.pending))
        order = np.lexsort((cid, d, row))
        row, d, cid, label = row[order], d[order], cid[order], label[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        last = nth == self.k - 1
        self.bound[row[last]] = np.fmin(self.bound[row[last]], d[last])
        self.best = row[keep], d[keep], cid[keep], label[keep]
        self.pending, self.n_pending = [], 0

    def table(self) -> pd.DataFrame:
        self.settle()
        row, d, cid, label = self.best
        none = np.isnan(label)
        told = pd.arrays.IntegerArray(np.where(none, 0, label).astype(np.int32), none)
        return pd.DataFrame({"query_id": self.qids[row], "neighbor_id": cid, "distance": d, "neighbor_label": told})


def _sent_queries(queries: DataFrame, k: int, metric: str, p: float, exclude_self: bool, block_rows: int):
    """Task over candidates against a small query set that travels with the code."""
    rows = queries.collect()  # bounded: checked by the caller
    qids = np.array([r["qid"] for r in rows], np.int64)
    q = np.array([r["qvec"] for r in rows], np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, every = _Nearest(qids, q, k, metric, p, exclude_self), np.arange(len(q))
        for b in batches:
            for s in range(0, len(b), block_rows):
                t = b.iloc[s:s + block_rows]
                found.meet(every, t["cid"].to_numpy(np.int64), t["clabel"].to_numpy(np.float64, na_value=np.nan), _matrix(t["cvec"]))
        yield found.table()

    return run


def _to_cells(pivots: np.ndarray, metric: str, p: float, vec: str):
    """Task: each row's cell and its distance to that pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                parts = [(d.argmin(axis=1), d.min(axis=1)) for _, d in _chunked(_matrix(b[vec]), pivots, metric, p)]
                yield b.assign(cell=np.concatenate([x for x, _ in parts]).astype(np.int32),
                               far=np.concatenate([x for _, x in parts]))

    return run


def _cell_tiles(folder: str, cell: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors, distances to the pivot) of a cell, some rows at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, path = FileSystem.from_uri(f"{folder}/cell={cell}")
    for info in sorted(fs.get_file_info(FileSelector(path)), key=lambda i: i.path):
        if info.base_name.startswith("part-"):
            with fs.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(rows, columns=["cid", "clabel", "cvec", "far"]):
                    cid, label, vec, far = (b.column(c) for c in ("cid", "clabel", "cvec", "far"))
                    yield (cid.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False).astype(np.float64),
                           vec.flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1), far.to_numpy(zero_copy_only=False))


def _group_search(folder: str, pivots: np.ndarray, cells: pd.DataFrame, k: int, metric: str, p: float, exclude_self: bool,
                  block_rows: int):
    """Task: groups of queries, each with the cells streamed past it."""
    numbers, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy(np.float64)

    def search(b: pd.DataFrame) -> pd.DataFrame:
        found = _Nearest(b["qid"].to_numpy(np.int64), _matrix(b["qvec"]), k, metric, p, exclude_self)
        at = np.concatenate([d for _, d in _chunked(found.q, pivots[numbers], metric, p)])
        for i in np.argsort(at.mean(axis=0), kind="stable"):
            near = at[:, i]
            # written so that a distance that is no number refutes nothing
            least = near * (1 - SLACK) - radius[i] * (1 + SLACK)
            if (least > found.bound * (1 + SLACK) + SLACK).all():
                continue
            for cid, label, c, far in _cell_tiles(folder, int(numbers[i]), block_rows):
                reach = found.bound * (1 + SLACK) + SLACK
                refuted = (least > reach) | (far.min() * (1 - SLACK) - near * (1 + SLACK) > reach) | \
                    (near * (1 - SLACK) - far.max() * (1 + SLACK) > reach)
                found.meet(np.flatnonzero(~refuted), cid, label, c)
            if 4 * found.n_pending >= len(b):
                found.settle()
        return found.table()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, part, n = block_rows * GROUP_TILES, [], 0
        for b in batches:
            for s in range(0, len(b), most):
                piece = b.iloc[s:s + most]
                if n + len(piece) > most:
                    yield search(pd.concat(part))
                    part, n = [], 0
                part.append(piece)
                n += len(piece)
        if n:
            yield search(pd.concat(part))

    return run


def meeting_cells(queries: DataFrame, candidates: DataFrame, k: int, metric: str, p: float, cell_rows: int
                  ) -> tuple[DataFrame, DataFrame, int]:
    """(queries by own cell, candidates by cell, number of cells): a row of either keeps the distance to its pivot."""
    pivots = _pivots(candidates, cell_rows)
    return *_in_cells(queries, candidates, pivots, metric, p), len(pivots)


def _in_cells(queries: DataFrame, candidates: DataFrame, pivots: np.ndarray, metric: str, p: float) -> tuple[DataFrame, DataFrame]:
    return (queries.mapInPandas(_to_cells(pivots, metric, p, "qvec"), "qid long, qvec array<double>, cell int, far double"),
            candidates.mapInPandas(_to_cells(pivots, metric, p, "cvec"),
                                   "cid long, cvec array<double>, clabel int, cell int, far double"))


def _pivots(candidates: DataFrame, cell_rows: int) -> np.ndarray:
    order = F.md5(F.concat(F.lit("pivot:"), F.col("cid").cast("string")))
    n_pivots = max(1, min(MAX_PIVOTS, math.ceil(candidates.count() / cell_rows)))
    return np.array([r["cvec"] for r in candidates.orderBy(order, "cid").limit(n_pivots).collect()], np.float64)


def _by_groups(q: DataFrame, n: int, c: DataFrame, k: int, metric: str, p: float, exclude_self: bool, block_rows: int,
               cell_rows: int) -> DataFrame:
    """The ``k`` nearest of every query, each group of queries against the cells in the shared folder."""
    spark = q.sparkSession
    pivots = _pivots(c, cell_rows)
    asked, dealt = _in_cells(q, c, pivots, metric, p)
    cells = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))
    cells = cells.orderBy("cell").toPandas()  # at most MAX_PIVOTS rows
    folder = f"{checkpoint_dir(spark).rstrip('/')}/knn-cells-{uuid.uuid4().hex}"
    if len(cells):
        files = F.element_at(F.create_map(*[F.lit(int(x)) for row in zip(cells["cell"], cells["files"]) for x in row]), F.col("cell"))
        (dealt.withColumn("file", F.pmod(F.xxhash64("cid"), files))
         .repartition(max(spark.sparkContext.defaultParallelism, int(cells["files"].sum())), "cell", "file").sortWithinPartitions("cell", "far")
         .drop("file").write.partitionBy("cell").parquet(folder))
    # a partition is a run of near-by cells, cut anywhere: several groups of bounded size, at least two a core
    groups = max(math.ceil(n / (block_rows * GROUP_TILES)), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 256)))
    search = _group_search(qualified(spark, folder), pivots, cells, k, metric, p, exclude_self, block_rows)
    best = written(asked.repartitionByRange(groups, "cell", "qid").mapInPandas(search, NEIGHBORS), "knn-best")
    discard(spark, folder)
    return best


def nearest_neighbors(queries: DataFrame, candidates: DataFrame, k: int = 5,
                      id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
                      metric: str = "euclidean", exclude_self: bool = True, block_rows: int = 2048, p: float = 2.0,
                      cell_rows: int = CELL_ROWS, small_values: int = SMALL_VALUES) -> DataFrame:
    """The k nearest candidates of every query row (query_id, rank,
    neighbor_id, distance, neighbor_label); the row itself is excluded."""
    if metric not in METRICS or metric == "minkowski" and p < 1:
        raise ValueError(f"unknown metric {metric} (p = {p})")
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("qvec"))
    c = candidates.select(F.col(id_col).cast("long").alias("cid"), F.col(vec_col).cast("array<double>").alias("cvec"),
                          label.alias("clabel"))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("qvec")), F.lit(0)).alias("d")).first()
    if size["n"] * size["d"] <= small_values:
        cores = q.sparkSession.sparkContext.defaultParallelism
        c = c.repartition(cores, "cid") if c.rdd.getNumPartitions() < cores else c
        partial = c.mapInPandas(_sent_queries(q, k, metric, p, exclude_self, block_rows), NEIGHBORS) if size["n"] else \
            q.sparkSession.createDataFrame([], NEIGHBORS)
    else:
        partial = _by_groups(q, size["n"], c, k, metric, p, exclude_self, block_rows, cell_rows)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def knn_classify(vectors: DataFrame, k: int = 5, weights: str = "uniform", metric: str = "euclidean",
                 id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 candidates: DataFrame | None = None, p: float = 2.0) -> DataFrame:
    """M7: predict each row from its k nearest labelled rows (leave-one-out
    when ``candidates`` is None). Uniform or inverse-distance weights; the
    probability is the weighted vote share; ties go to the smallest label.
    A zero distance takes all the weight, as in inverse-distance voting."""
    cand = vectors if candidates is None else candidates
    nb = nearest_neighbors(vectors, cand, k, id_col, vec_col, label_col, metric,
                           exclude_self=candidates is None, p=p)
    if weights == "distance":
        has_zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
        wgt = F.when(has_zero == 1, (F.col("distance") == 0).cast("double")) \
            .otherwise(1.0 / F.col("distance"))
    else:
        wgt = F.lit(1.0)
    votes = (nb.withColumn("w", wgt).groupBy("query_id", "neighbor_label")
             .agg(F.sum("w").alias("w")))
    tot = votes.groupBy("query_id").agg(
        F.max_by(F.struct(F.col("w"), (-F.col("neighbor_label")).alias("neg_label")),
                 F.struct(F.col("w"), (-F.col("neighbor_label")).alias("neg_label"))).alias("best"),
        F.sum("w").alias("total"),
        F.map_from_entries(F.collect_list(F.struct(F.col("neighbor_label"), F.col("w")))).alias("scores"))
    return tot.select(F.col("query_id").alias(id_col),
                      (-F.col("best.neg_label")).cast("int").alias("prediction"),
                      (F.col("best.w") / F.col("total")).alias("confidence"),
                      "scores", "total")


class _KNNParams(Params):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean, manhattan or minkowski", TypeConverters.toString)
    p = Param(Params._dummy(), "p", "power of the minkowski metric", TypeConverters.toFloat)
    nClasses = Param(Params._dummy(), "nClasses", "length of the probability vector", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, weights="uniform", metric="euclidean", p=2.0, nClasses=2)


class KNNClassifier(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """M7 as an estimator over (id, features, label): features are standardised with
    the training rows' means and deviations, which the model keeps with those rows."""

    def __init__(self, k=5, weights="uniform", metric="euclidean", p=2.0, n_classes=2):
        super().__init__()
        if metric not in METRICS or weights not in ("uniform", "distance"):
            raise ValueError(f"unknown metric or weights: {metric}, {weights}")
        self._set(k=k, weights=weights, metric=metric, p=p, nClasses=n_classes)

    def _fit(self, df: DataFrame) -> KNNClassificationModel:
        long = df.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
        stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row a feature
        scale = {"mean": [r["m"] for r in stats], "std": [r["s"] or 1.0 for r in stats]}
        rows = written(df.select("id", vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")), "knn-rows")
        return self._copyValues(KNNClassificationModel(scale, rows))


class KNNClassificationModel(Model, _KNNParams, MLReadable, MLWritable):
    """Adds ``probability`` (vote shares of all classes) and ``prediction`` to rows with id and features."""

    def __init__(self, scale: dict | None = None, rows: DataFrame | None = None):
        super().__init__()
        self.scale, self.rows = scale or {}, rows

    def _scaled(self, x: Column) -> Column:
        mean, std = (F.array(*[F.lit(float(v)) for v in self.scale[s]]) for s in ("mean", "std"))
        return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda a, b: a / b)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = lambda name: self.getOrDefault(getattr(self, name))
        n = g("nClasses")
        known = self.rows.select("id", self._scaled(F.col("x")).alias("v"), "label")
        asked = df.select("id", self._scaled(vector_to_array("features")).alias("v"))
        votes = knn_classify(asked, g("k"), g("weights"), g("metric"), "id", "v", "label", known, g("p"))
        share = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                            lambda i: F.coalesce(F.element_at("scores", i.cast("int")), F.lit(0.0)) / F.col("total"))
        told = votes.select(F.col("id").alias("__id"), array_to_vector(share).alias("probability"),
                            F.col("prediction").cast("double").alias("prediction"))
        return df.join(told, F.col("id") == F.col("__id"), "left").drop("__id")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: KNNClassificationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame([(json.dumps(self.model.scale),)], "scale string").write.text(f"{path}/scale")
        self.model.rows.write.parquet(f"{path}/rows")


class _Reader(MLReader):
    def load(self, path: str) -> KNNClassificationModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        scale = json.loads(spark.read.text(f"{path}/scale").first()[0])
        model = KNNClassificationModel(scale, spark.read.parquet(f"{path}/rows"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
