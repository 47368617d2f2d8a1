"""Ranked lexical search by bag deduplication.

The items come in blocks, each with the vocabulary of its items.  Every whole
text is split into terms once; per block only its bag stays: the counts of
vocabulary terms.  Documents with the same bag and the same length norm ``m``
form one class, met by hash and verified on the bag itself.  A class is scored
once, against all items of its block, as a matrix product of the class's term
impacts with the items' term counts; each task keeps the best classes of an item
and these lists are merged some at a time.  The best classes are then expanded
to their members by ascending id.

Equal scores go by ascending id.  At most ``k`` members of a class and ``k``
classes of an item can reach its first ``k`` documents (every class ahead holds
a document that is ahead), so nothing else is carried on.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import new_folder, open_fs, settled, ship_package
from cohortlens.llm.vectors import merge_lists
from cohortlens.llm.words import text_chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: items of a block on average; values of a matrix of class impacts at once
BLOCK_ITEMS, MATRIX = 256, 4 << 20

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

BAGS = "kind int, block int, id bigint, n bigint, bag binary, term int, count bigint"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, block, term, idx, qtf): a row for each item and term, ``idx`` numbering its block's terms."""
    rows = settled(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"),
                                F.col(text_col).alias("text")), "search-items")
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    terms = rows.select("item", "item_id", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"),
                        F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    terms = terms.groupBy("item", "item_id", "block", "term").agg(F.count("*").alias("qtf"))
    vocabulary = terms.select("block", "term").distinct().withColumn(
        "idx", F.row_number().over(Window.partitionBy("block").orderBy("term")) - 1)
    return settled(terms.join(vocabulary, ["block", "term"]), "search-terms")


def _write_by_block(df: DataFrame, name: str) -> str:
    folder = new_folder(df.sparkSession, name)
    df.repartition("block").write.mode("overwrite").partitionBy("block").parquet(folder)
    return folder


def _blocks(folder: str) -> list[int]:
    fs, path = open_fs(folder)
    from pyarrow.fs import FileSelector

    return sorted(int(i.base_name.split("=")[1]) for i in fs.get_file_info(FileSelector(path)) if "block=" in i.base_name)


def _read_block(folder: str, block: int) -> pa.Table:
    fs, path = open_fs(folder)
    from pyarrow.fs import FileSelector

    files = [i.path for i in fs.get_file_info(FileSelector(f"{path}/block={block}")) if i.base_name.startswith("part-")]
    return pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)]).combine_chunks()


@lru_cache(maxsize=4)
def _vocabulary(folder: str, block: int) -> pa.Array:
    """The block's terms in the order of their numbers."""
    t = _read_block(folder, block)
    terms = t["term"].combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
    return terms.take(pa.array(np.argsort(t["idx"].to_numpy())))


def split_terms(texts: list[bytes | None]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(text number, term in lower case) of all terms of some texts (UTF-8; bytes from 0x80 on belong to terms)."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    inside = _IN_TERM[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(np.cumsum(sizes), start, "right")
    letters = _LOWER[buf[inside]]
    place = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=place[1:])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place), pa.py_buffer(letters)])
    return row, terms


def pairs(row: np.ndarray, idx: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the distinct pairs, in that order."""
    key, count = np.unique(row * max(size, 1) + idx, return_counts=True)
    return key // max(size, 1), key % max(size, 1), count


def _bags(folder: str):
    """Task: bags of the texts (kind 0), document counts of the terms (1), documents with terms and their terms (2)."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("id", pa.int64()), ("n", pa.int64()),
                        ("bag", pa.binary()), ("term", pa.int32()), ("count", pa.int64())])

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, documents, terms_total = _blocks(folder), {}, 0, 0
        for b in batches:
            for first, texts in text_chunks(b["text"]):
                row, terms = split_terms(texts)
                n = np.bincount(row, minlength=len(texts))
                documents += int((n > 0).sum())
                terms_total += len(row)
                ids = b["id"].slice(first, len(texts))
                for block in blocks:
                    words = _vocabulary(folder, block)
                    number = pc.index_in(terms, value_set=words)
                    known = number.is_valid().to_numpy(zero_copy_only=False)
                    r, t, count = pairs(row[known], number.drop_null().to_numpy(), len(words))
                    held[block] = held.get(block, 0) + np.bincount(t, minlength=len(words))
                    which, size = np.unique(r, return_counts=True)
                    if not len(which):
                        continue
                    place = np.zeros(len(which) + 1, np.int32)
                    np.cumsum(8 * size, out=place[1:])
                    body = np.ascontiguousarray(np.stack([t, count], 1).astype("<u4"))
                    bags = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(place), pa.py_buffer(body)])
                    yield batch(len(which), kind=np.zeros(len(which)), block=np.full(len(which), block),
                                id=ids.take(pa.array(which)), n=n[which], bag=bags)
        for block, count in held.items():
            t = np.flatnonzero(count)
            yield batch(len(t), kind=np.full(len(t), 1), block=np.full(len(t), block), term=t, count=count[t])
        yield batch(1, kind=[2], n=[terms_total], count=[documents])

    return run


@lru_cache(maxsize=4)
def _items(folder: str, block: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(item numbers, item ids, term weights, term counts as terms x items) of a block."""
    t = _read_block(folder, block)
    item, first, at = np.unique(t["item"].to_numpy(), return_index=True, return_inverse=True)
    idx = t["idx"].to_numpy()
    weight = np.zeros(idx.max() + 1, np.int64)
    weight[idx] = t["weight"].to_numpy()
    counts = np.zeros((len(weight), len(item)), np.int64)
    counts[idx, at] = t["qtf"].to_numpy()
    return item, t["item_id"].combine_chunks().take(pa.array(first)), weight, counts


def impacts(bags: list[bytes], m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(classes, terms): weight * ((10**9 * tf) div (1000 * tf + 12 * m))."""
    out = np.zeros((len(bags), len(weight)), np.int64)
    body = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
    term, tf = body[:, 0], body[:, 1]
    out[row, term] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    return out


def class_scores(impact: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact matrix product: in doubles while every score is below 2**53, in 64-bit integers beyond."""
    if int(impact.max(initial=0)) * int(counts.sum(0).max(initial=0)) < 1 << 53:
        return (impact.astype(np.float64) @ counts.astype(np.float64)).astype(np.int64)
    return impact @ counts


def _score(folder: str, k: int):
    """Task: classes against the items of their block, the best ``k`` classes of each item."""

    def best(score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, class) of each item's first ``k`` classes with a score above 0, equal ones by ``first``."""
        by_id = np.argsort(first, kind="stable")
        score = score[by_id].T
        if score.shape[1] > k:
            limit = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None], 1)
        else:
            limit = 1
        item, at = np.nonzero(score >= limit)
        order = np.lexsort((at, -score[item, at], item))
        item, at = item[order], at[order]
        keep = np.arange(len(item)) - np.searchsorted(item, np.arange(score.shape[0]))[item] < k
        return item[keep], by_id[at[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for b in batches:
            for block in pc.unique(b["block"]).to_pylist():
                own = b.filter(pc.equal(b["block"], block))
                item, item_id, weight, counts = _items(folder, block)
                step = max(1, MATRIX // max(len(weight), len(item)))
                for at in range(0, own.num_rows, step):
                    t = own.slice(at, step)
                    score = class_scores(impacts(t["bag"].to_pylist(), t["m"].to_numpy(), weight), counts)
                    first = t["first"].fill_null(np.iinfo(np.int64).max).to_numpy()
                    i, c = best(score, first)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(item[i]), item_id.take(pa.array(i)), pa.array(np.full(len(i), number, np.int32)),
                        pa.array(score[c, i]), t["first"].take(pa.array(c)), t["members"].take(pa.array(c))],
                        ["item", "item_id", "shard", "score", "first", "members"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, item_id, rank, id, score): the ``k`` best documents of every item, scores above 0 only.

    Every row of ``docs`` is a document and every row of ``items`` an item of its
    own, repeated ids included; ``item`` is the item row's number.  Null and empty
    texts have no terms: such documents are found by nothing and such items find
    nothing.  Equal scores go by ascending id, null ids last.  Texts of any length
    are taken whole (a chunk of their own).  Empty tables give no rows.
    """
    ship_package()
    spark = docs.sparkSession
    terms = item_terms(items, item_col, item_text_col)
    vocabulary = _write_by_block(terms.select("block", "term", "idx").distinct(), "search-vocabulary")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    made = settled(texts.mapInArrow(_bags(vocabulary), BAGS), "search-bags")
    whole = made.filter("kind = 2").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("documents"),
                                        F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = made.filter("kind = 1").groupBy("block", F.col("term").alias("idx")).agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * whole["documents"] + 2)) / (2 * F.col("df") + 1).cast("double")))
    folder = _write_by_block(terms.join(held, ["block", "idx"]).select(
        "block", "item", "item_id", "idx", "qtf", weight.cast("bigint").alias("weight")), "search-weights")
    norm = F.expr(f"75 + (25 * n * {whole['documents']}L) div {max(1, whole['terms'])}L")
    bags = made.filter("kind = 0").select("block", "id", norm.alias("m"), "bag").withColumn(
        "hash", F.xxhash64("block", "m", "bag"))
    same = ["hash", "block", "m", "bag"]  # the hash deals out, the bag decides
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("id")))
    classes = bags.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy(*same).agg(
        F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("members")).select(
        "block", "m", "bag", F.col("members.id").alias("members"), F.col("members")[0]["id"].alias("first"))
    id_type = items.schema[item_col].dataType.simpleString()
    lists = classes.mapInArrow(_score(folder, k),
                               f"item bigint, item_id {id_type}, shard int, score bigint, first bigint, members array<bigint>")
    order = [F.desc("score"), F.asc_nulls_last("first")]
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = merge_lists(lists, ["item", "item_id"], order, k, n_shards).drop("rank")
    found = top.select("item", "item_id", "score", F.explode("members").alias("id"))
    rank = F.row_number().over(Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("item", "item_id", "rank", "id", "score")
