"""Edge-case tables and plain reference versions of the operators."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import types as T

SF_SMALL = os.environ.get("COHORTLENS_TEST_SF", "/root/testdata/sf0.001")
SF_ORACLE = os.environ.get("COHORTLENS_ORACLE_SF", "/root/testdata/sf0.01")

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("quality", T.StringType()), T.StructField("id", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("_node", T.StringType()), T.StructField("copies", T.StringType())])


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=7):
    """Rows (id, text, source) with nulls, empty and long texts, exact and near copies, shared passages, repeated ids."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(30, 160)) for _ in range(25)]
    passage = sentence(rng, 60, 5000)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    n = len(rows)
    for i in range(6):  # near copies
        w = base[3].split()
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((n + i, " ".join(w), "s0"))
    n = len(rows)
    rows += [(n + i, base[5], "s1") for i in range(5)]  # exact copies
    n = len(rows)
    rows += [(n + i, sentence(rng, 20) + "\n\t" + passage + " \x0b" + sentence(rng, 15), None) for i in range(8)]
    n = len(rows)
    rows += [(n, None, "s2"), (n + 1, "", "s2"), (n + 2, " \n\t ", None), (n + 3, "one", "s0"), (n + 4, "a b c", "s0"),
             (n + 5, sentence(rng, 4000, 9000), "s1"), (None, base[1], "s1"), (None, passage, "s0"), (None, None, None),
             (n + 6, base[2], "s2"), (n + 6, base[2], "s2"), (n + 7, base[7], "s0"), (n + 7, base[8], "s0"),
             (n + 8, "Ünï cödé   x y 😀 " + passage, "ß"), (n + 9, (sentence(rng, 12) + "\n") * 30, "s2"),
             (n + 10, "A B C D E F g", "s0"), (n + 11, "a b c d e f g", "s0")]
    return rows


def frame(spark, rows, partitions=3):
    data = [(i, t, "xx", s, len(t) if t else None, "q", 5, "s", "k", "h", "n", "r", "m", "c") for i, t, s in rows]
    return spark.createDataFrame(data, DOC_SCHEMA).repartition(partitions)


def multiset(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# fixtures for the test modules that import them


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [], 1)
