"""Vector searches and ranked lexical search against brute force, on ties, repeated rows, nulls and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs, frame, multiset, nothing, rows, sentence  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import bag_search, bit_planes, vectors
from cohortlens.llm.bag_search import ranked_search
from cohortlens.llm.bit_planes import Range, hard_negatives
from cohortlens.llm.exact_search import nearest_rows

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that the operators use themselves
    T.StructField("row", T.StringType()), T.StructField("id", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("score", T.StringType()), T.StructField("wanted", T.StringType())])


def vector_rows(seed=3, n=400, d=11):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.4, (n, d)).round(2)
    out = [(i, v.tolist(), int(rng.integers(4))) for i, v in enumerate(base)]
    common = base[0].tolist()
    out += [(n + i, common, i % 2) for i in range(130)]  # one very common vector: ties
    out += [(10, base[10].tolist(), 1), (10, base[10].tolist(), 1), (20, base[3].tolist(), 2)]  # repeated rows, repeated ids
    out += [(None, base[5].tolist(), 3), (700, None, 1), (710, [1.0] * (d - 1) + [None], 1), (720, [float("nan")] * d, 1),
            (730, [float("inf")] + [0.0] * (d - 1), 1), (740, [0.5, -0.5, 0.25], 1), (750, [0.25, 0.5, 1.0], 1),
            (760, [-1.0, -2.0, -3.0], 2), (770, [], 1), (780, [], 2), (790, base[7].tolist(), None)]
    return out


def vector_frame(spark, data):
    return spark.createDataFrame([(i, v, x, "r", "i", "c", "s", "t", "w") for i, v, x in data], VECTORS).repartition(5)


def coded(data):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def ranked(scored):
    """(id, score) by higher score, then smaller id, null last."""
    return sorted(scored, key=lambda p: (-p[1], p[0] is None, p[0] or 0))


def slow_nearest(data, step, k):
    c, out = coded(data), []
    for a, (i, v, _) in enumerate(c):
        if i is None or i % step:
            continue
        found = ranked((j, sum(x * y for x, y in zip(v, w))) for b, (j, w, _) in enumerate(c) if b != a and len(w) == len(v))
        out += [(i, r + 1, j, s) for r, (j, s) in enumerate(found[:k])]
    return multiset(out)


def slow_negatives(data, step, n_pos, n_neg, low, high):
    c, out = [x for x in coded(data) if x[2] is not None], []
    for a, (i, v, y) in enumerate(c):
        if i is None or i % step:
            continue
        scored = [(j, sum(p * q for p, q in zip(v, w)), z) for b, (j, w, z) in enumerate(c) if b != a and len(w) == len(v)]
        for j, p in ranked((j, s) for j, s, z in scored if z == y)[:n_pos]:
            near = ranked((m, s) for m, s, z in scored if z != y and low * p <= 100 * s <= high * p)
            out += [(i, j, r + 1, m, p, s) for r, (m, s) in enumerate(near[:n_neg])]
    return multiset(out)


@pytest.mark.parametrize("limits", [(4 << 20, 4096, 4 << 20), (300, 7, 40)])
def test_nearest_rows(spark, monkeypatch, limits):
    # small limits: many shards a task, many blocks, tiles of a few queries
    for name, value in zip(("SHARD_VALUES", "BLOCK_ROWS"), limits):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr("cohortlens.llm.exact_search.TILE_SCORES", limits[2])
    data = vector_rows()
    found = nearest_rows(vector_frame(spark, data), F.col("vec_id") % 10 == 0, k=5)
    assert multiset(found.select("query_id", "rank", "id", "score").collect()) == slow_nearest(data, 10, 5)
    assert found.groupBy("query_row", "rank").count().filter("count > 1").count() == 0


def test_nearest_rows_of_large_components(spark):
    data = [(i, [1e5 * (i + 1), -3e5, float(i)], 0) for i in range(30)]  # sums beyond 2**53: whole numbers, not doubles
    found = nearest_rows(vector_frame(spark, data), F.col("vec_id") % 10 == 0, k=4)
    assert multiset(found.select("query_id", "rank", "id", "score").collect()) == slow_nearest(data, 10, 4)
    with pytest.raises(ArithmeticError):
        nearest_rows(vector_frame(spark, [(0, [3e38], 0), (1, [1.0], 0)]), F.col("vec_id") == 0, k=1)


def test_searches_of_nothing(spark, nothing):  # noqa: F811
    none = vector_frame(spark, [])
    assert nearest_rows(none, F.col("vec_id") % 10 == 0, 5).collect() == []
    assert hard_negatives(none, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    few = vector_frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])
    assert nearest_rows(few, F.col("vec_id") % 10 == 0, 5).collect() == []
    assert [tuple(r) for r in nearest_rows(few, F.col("vec_id") == 1, 5).select("id", "score").collect()] == [(2, 256 * 256)]
    assert hard_negatives(few, F.col("vec_id") == 1, F.col("label")).collect() == []
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert ranked_search(nothing, items).collect() == []
    assert ranked_search(frame(spark, [(1, "a b", "s")]), items.limit(0)).collect() == []


def test_merging_in_a_tree_is_the_plain_top(spark):
    rng = random.Random(1)
    data = [(q, s, rng.randrange(50), rng.randrange(10)) for q in range(4) for s in range(60) for _ in range(3)]
    lists = spark.createDataFrame(data, "q int, shard int, id long, score long")
    order = [F.desc("score"), F.asc("id")]
    got = vectors.merge_lists(lists, ["q"], order, 6, 60, fan_in=3).select("q", "rank", "id", "score").collect()
    want = []
    for q in range(4):
        best = sorted(((i, s) for p, _, i, s in data if p == q), key=lambda x: (-x[1], x[0]))[:6]
        want += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    assert multiset(got) == multiset(want)


@pytest.mark.parametrize("bits", [1, 5, 9, 17])
def test_lookups_are_inner_products(bits):
    rng = np.random.default_rng(bits)
    for d in (1, 7, 8, 9, 64):
        a, c = (rng.integers(-(1 << bits - 1), 1 << bits - 1, (n, d)) for n in (6, 40))
        planes = bit_planes.planes_for(1 << bits - 1)
        codes = np.ascontiguousarray(bit_planes.pack(c, planes).transpose(1, 2, 0)).astype(np.intp)
        assert (bit_planes.lookup_scores(bit_planes.subset_sums(a, np.int64), codes) == c @ a.T).all()


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "SHARD_VALUES", 600)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 9)
        monkeypatch.setattr(bit_planes, "ANCHORS", 2)
        monkeypatch.setattr(bit_planes, "CANDIDATES", 13)
    data = vector_rows(seed=5)
    found = hard_negatives(vector_frame(spark, data), F.col("vec_id") % 10 == 0, F.col("label"))
    assert multiset(found.collect()) == slow_negatives(data, 10, 5, 3, 50, 95)


def test_hard_negatives_with_other_bounds_and_large_components(spark):
    data = [(i, [1000.5 * x for x in v], y) for i, v, y in vector_rows(seed=9, n=60) if v is not None and None not in v]
    found = hard_negatives(vector_frame(spark, data), F.col("vec_id") % 5 == 0, F.col("label"), 3, 4, Range(-20, 110))
    assert multiset(found.collect()) == slow_negatives(data, 5, 3, 4, -20, 110)


TERM = re.compile(bag_search.TERM)


def slow_terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def slow_ranking(documents, items, k):
    bags = [(i, Counter(slow_terms(t))) for i, t in documents]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            n = sum(b.values())
            m = 75 + 25 * n * n_docs // total if total else 0
            scored.append((i, sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                                  * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in slow_terms(text) if b[t])))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(ranked(x for x in scored if x[1] > 0)[:k])]
    return multiset(out)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, rows, docs, small):  # noqa: F811
    if small:  # many item blocks, a few classes at a time
        monkeypatch.setattr(bag_search, "BLOCK_ITEMS", 3)
        monkeypatch.setattr(bag_search, "MATRIX", 100)
        monkeypatch.setattr(vectors, "FAN_IN", 2)
    rng = random.Random(2)
    items = [(i, sentence(rng, 12)) for i in range(9)]
    items += [(9, None), (10, ""), (11, "w1 W1 w1 w2"), (11, "w3"), (None, "w5 w6"), (12, "nowhere else"), (13, "Ünï 😀x CÖDÉ"),
              (14, "?!"), (15, "A-b,c"), (16, " ".join(f"w{i}" for i in range(400)))]
    asked = spark.createDataFrame([(*x, "b", "t") for x in items], "item_id long, text string, block string, term string")
    found = ranked_search(docs, asked, k=7)
    assert multiset(found.select("item_id", "rank", "id", "score").collect()) == slow_ranking([(i, t) for i, t, _ in rows], items, 7)
    # items of a text column that is another table's id type
    named = asked.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text")
    assert ranked_search(docs, named, k=1).schema["item_id"].dataType == T.StringType()


def test_classes_are_scored_once(spark):
    copies = [(i, "alpha beta beta", "s") for i in range(300)] + [(1000 + i, f"alpha gamma{i} x", "s") for i in range(50)]
    items = [(1, "alpha"), (2, "beta"), (3, "gamma7")]
    found = ranked_search(frame(spark, copies, 6), spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert multiset(found.select("item_id", "rank", "id", "score").collect()) == slow_ranking([(i, t) for i, t, _ in copies], items, 20)


def test_scores_beyond_doubles():
    impact = np.array([[5, (1 << 52) + 1], [3, 7]], np.int64)
    counts = np.array([[2, 9], [3, 1]], np.int64)
    assert bag_search.class_scores(impact, counts).tolist() == [[10 + 3 * ((1 << 52) + 1), 45 + (1 << 52) + 1], [27, 34]]
