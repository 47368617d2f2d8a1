"""Exact order statistics, modes and dictionary codes without one final buffer.

Everything starts from the value counts of some columns: ``(name, value, n)``,
one row for each distinct value, pre-aggregated in every map task.  Where these
are few they are picked from directly.  Where they are many they are dealt into
ranges of (name, value), written once with the range's number, and

* the size of every range (a row for each range) gives its running offset;
* only the ranges that hold a wanted rank are read again, and only inside one
  range is there a running total;
* a code is the range's offset plus the place inside the range.

Both ways give the same answers; no task ever holds all values of a column.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import discard, written_at

#: distinct (column, value) pairs up to which counts are picked from on the driver
FEW = 50_000


def value_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, value, n) of every distinct value of some expressions of one type; nulls are counted as a value."""
    long = df.select(*[e.alias(f"v{i}") for i, e in enumerate(values.values())]) \
        .unpivot([], [f"v{i}" for i in range(len(values))], "name", "value")
    named = F.element_at(F.array(*[F.lit(k) for k in values]), F.substring("name", 2, 10).cast("int") + 1)
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("name", named)


class Ranged:
    """Rows (name, value, n) dealt into ranges of (name, value), in the shared folder while this is open."""

    def __init__(self, counts: DataFrame):
        self.spark = counts.sparkSession
        ranged = counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id())
        self.rows, self.path = written_at(ranged, "ranges")

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.path)

    def offsets(self, what: Column) -> dict[str, list[tuple[int, int, int]]]:
        """{name: [(range, offset, size)]} in value order; as many rows as there are ranges and names."""
        sizes = self.rows.groupBy("name", "part").agg(what.alias("size")).orderBy("name", "part").collect()
        out: dict[str, list[tuple[int, int, int]]] = {}
        for r in sizes:
            own = out.setdefault(r["name"], [])
            own.append((r["part"], own[-1][1] + own[-1][2] if own else 0, r["size"]))
        return out


def _ranks(n: int, p: float) -> tuple[float, int, int]:
    place = p * (n - 1)
    return place, math.floor(place), math.ceil(place)


class OrderedCounts:
    """The counted values of some columns, ready for exact interpolated quantiles."""

    def __init__(self, counts: DataFrame, few: int = FEW):
        self.counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
        rows = self.counts.limit(few + 1).collect()
        self.few = {} if len(rows) <= few else None
        if self.few is not None:
            for r in rows:
                self.few.setdefault(r["name"], {})[r["value"]] = r["n"]
            self.missing = {k: v.pop(None, 0) for k, v in self.few.items()}
        else:
            nulls = self.counts.filter("value IS NULL").collect()  # at most one row a column
            self.missing = {r["name"]: r["n"] for r in nulls}
        self.limit = few

    def close(self) -> None:
        self.counts.unpersist()

    def __enter__(self) -> OrderedCounts:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def quantiles(self, probs: dict[str, list[float]], extra: dict[str, tuple[float, int]] | None = None
                  ) -> dict[str, list[float | None]]:
        """The interpolated quantiles of every name, nulls left out; None for a column without values.

        ``extra`` adds so many repetitions of a value to a column first (a fill)."""
        extra = {k: v for k, v in (extra or {}).items() if v[1]}
        if self.few is None:
            return self._from_ranges(probs, extra)
        out = {}
        for name, ps in probs.items():
            counts = dict(self.few.get(name, {}))
            if name in extra:
                value, n = extra[name]
                counts[value] = counts.get(value, 0) + n
            values = sorted(counts)
            upto = list(accumulate(counts[v] for v in values))
            out[name] = [_interpolate(*_ranks(upto[-1], p), lambda r: values[bisect_right(upto, r)]) if values else None
                         for p in ps]
        return out

    def _from_ranges(self, probs, extra) -> dict[str, list[float | None]]:
        spark, counts = self.counts.sparkSession, self.counts.filter(F.col("value").isNotNull() & F.col("name").isin(*probs))
        if extra:
            added = spark.createDataFrame([(k, float(v), n) for k, (v, n) in extra.items() if k in probs], counts.schema)
            counts = counts.unionByName(added).groupBy("name", "value").agg(F.sum("n").alias("n"))
        with Ranged(counts) as ranged:
            ranges = ranged.offsets(F.sum("n"))
            wanted = {}
            for name, ps in probs.items():
                if name in ranges:
                    n = ranges[name][-1][1] + ranges[name][-1][2]
                    for rank in {r for p in ps for r in _ranks(n, p)[1:]}:
                        part, before, _ = next(x for x in ranges[name] if x[1] + x[2] > rank)
                        wanted[name, rank] = part, rank - before
            if not wanted:
                return {name: [None] * len(ps) for name, ps in probs.items()}
            rows = [(name, part, rank, inside) for (name, rank), (part, inside) in wanted.items()]
            picks = spark.createDataFrame(rows, "name string, part int, rank long, inside long")
            upto = F.sum("n").over(Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
            held = ranged.rows.filter(F.col("part").isin(*{r[1] for r in rows})).withColumn("upto", upto)
            found = held.join(F.broadcast(picks), ["name", "part"]).filter(
                (F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside")))
            at = {(r["name"], r["rank"]): r["value"] for r in found.select("name", "rank", "value").collect()}
        out = {}
        for name, ps in probs.items():
            n = ranges[name][-1][1] + ranges[name][-1][2] if name in ranges else 0
            out[name] = [_interpolate(*_ranks(n, p), lambda r: at[name, r]) if n else None for p in ps]
        return out


def _interpolate(place: float, low: int, high: int, value) -> float:
    a, b = value(low), value(high)
    return a if low == high or a == b else (high - place) * a + (place - low) * b


def quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of some numeric expressions (cast to double, nulls left out)."""
    if not values:
        return {}
    with OrderedCounts(value_counts(df, {k: v.cast("double") for k, v in values.items()}), few) as c:
        return c.quantiles({k: probs for k in values})


def modes(df: DataFrame, values: dict[str, Column]) -> dict[str, str | None]:
    """The most frequent non-null value of each string expression, the smallest on ties; one pair a map task and column."""
    if not values:
        return {}
    counts = value_counts(df, values).filter(F.col("value").isNotNull())
    top = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
    found = {r["name"]: r["value"] for r in top.select("name", "top.value").collect()}  # one row a column
    return {k: found.get(k) for k in values}


def dictionary_codes(distinct: DataFrame, few: int = FEW) -> DataFrame:
    """(column, value, code) of distinct (column, value) rows: the value's place among its column's sorted values.

    Few rows are numbered at once; many by range, where the offsets (a row for
    each range) are all that is put together."""
    spark = distinct.sparkSession
    kept = distinct.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.limit(few + 1).collect()
        if len(rows) <= few:
            by_column: dict[str, list[str]] = {}
            for r in rows:
                by_column.setdefault(r["column"], []).append(r["value"])
            return spark.createDataFrame([(c, v, i) for c in sorted(by_column) for i, v in enumerate(sorted(by_column[c]))],
                                         "column string, value string, code int")
        ranged = Ranged(kept.select(F.col("column").alias("name"), "value"))
    finally:
        kept.unpersist()
    offsets = [(name, part, before) for name, own in ranged.offsets(F.count(F.lit(1))).items() for part, before, _ in own]
    starts = spark.createDataFrame(offsets, "name string, part int, before long")
    place = F.row_number().over(Window.partitionBy("name", "part").orderBy("value")) - 1
    return ranged.rows.withColumn("place", place).join(F.broadcast(starts), ["name", "part"]).select(
        F.col("name").alias("column"), "value", (F.col("before") + F.col("place")).cast("int").alias("code"))
