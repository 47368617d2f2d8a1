"""Token ids in static range asymmetric numeral system (rANS) files.

One shared frequency table, counted over all tokens, codes every block.  A block
is a run of whole documents of about ``BLOCK_TOKENS`` ids; its ids are dealt to
``LANES`` interleaved coders that share one word stream, so numpy codes a row of
lanes at a time.  The sidecar index has a checkpoint for each block (place,
length, first id, ids, checksum), and each block starts from its own lane states,
so blocks decode in parallel in any order.

Files of a folder: ``table`` (frequencies), ``part-*.rans`` (blocks), ``part-*.index``
(tab-separated: file, at, length, start, n_tokens, n_docs, crc32).
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.shared import WholeFile, give_back, new_folder, open_fs, ship_package
from cohortlens.llm.tokens import encoder
from cohortlens.llm.words import text_chunks

BLOCK_TOKENS = 1 << 18
LANES = 1024
#: blocks that one task decodes
BLOCKS_PER_TASK = 8
LOW = np.uint64(1 << 31)
_HALF = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
INDEX = "file string, at bigint, length bigint, start bigint, n_tokens bigint, n_docs bigint, crc32 bigint"


class Frequencies:
    """Frequencies of the symbols, scaled to a power of two."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray, bits: int):
        self.symbols, self.scaled, self.bits = symbols, scaled, bits
        size = int(symbols.max()) + 1 if len(symbols) else 0
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = scaled
        self.first = np.zeros(size, np.uint64)
        self.first[symbols] = np.cumsum(scaled) - scaled

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> Frequencies:
        """Scale counts so that each symbol keeps at least one slot and the sum is 2 ** bits."""
        symbols = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
        n = np.array([counts[int(s)] for s in symbols], np.float64)
        bits = max(12, min(24, int(np.ceil(np.log2(max(2, len(symbols))))) + 4))
        scaled = np.maximum(1, np.floor(n / max(1.0, n.sum()) * (1 << bits))).astype(np.int64)
        order = np.argsort(-scaled, kind="stable")
        rest = (1 << bits) - int(scaled.sum())
        if len(order) and rest > 0:
            scaled[order[0]] += rest
        for i in order:  # what rounding up took goes off the most frequent symbols
            if rest >= 0:
                break
            off = min(-rest, int(scaled[i]) - 1)
            scaled[i] -= off
            rest += off
        return cls(symbols, scaled.astype(np.uint64), bits)

    def to_bytes(self) -> bytes:
        return json.dumps({"bits": self.bits, "symbols": self.symbols.tolist(), "scaled": self.scaled.tolist()}).encode()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Frequencies:
        x = json.loads(raw)
        return cls(np.array(x["symbols"], np.int64), np.array(x["scaled"], np.uint64), x["bits"])

    def slots(self) -> np.ndarray:
        """Symbol of each slot."""
        return np.repeat(self.symbols, self.scaled.astype(np.int64)).astype(np.uint32)


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(lane states to start decoding from, 32-bit words in the order of decoding)."""
    n = len(ids)
    bits = np.uint64(table.bits)
    x = np.full(lanes, LOW, np.uint64)
    freq, first = table.freq[ids], table.first[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    room = np.uint64(63 - table.bits)
    words: list[np.ndarray] = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f, c = freq[at:at + lanes], first[at:at + lanes]
        y = x[:len(f)]
        full = np.flatnonzero(y >= f << room)
        words.append((y[full] & _LOW32).astype(np.uint32))
        y[full] >>= _HALF
        quotient = y // f
        x[:len(f)] = (quotient << bits) + (y - quotient * f) + c
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode(n: int, x: np.ndarray, words: np.ndarray, table: Frequencies, slots: np.ndarray) -> np.ndarray:
    """The n ids of a block; raises ValueError if the stream does not end where it began."""
    lanes, bits, mask = len(x), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    x, words = x.copy(), words.astype(np.uint64)
    out = np.empty(n, np.uint32)
    p = 0
    for at in range(0, n, lanes):
        y = x[:min(lanes, n - at)]
        slot = y & mask
        s = slots[slot]
        out[at:at + len(y)] = s
        y[:] = table.freq[s] * (y >> bits) + slot - table.first[s]
        empty = np.flatnonzero(y < LOW)
        if len(words) - p < len(empty):
            raise ValueError("the block's words end too early")
        y[empty] = (y[empty] << _HALF) | words[p:p + len(empty)]
        p += len(empty)
    if p != len(words) or not (x == LOW).all():
        raise ValueError("the block does not decode to its start")
    return out


_HEAD = "<4sIQQQQ"


def pack_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, table: Frequencies,
               lanes: int = LANES) -> bytes:
    """A block: its documents' ids and lengths, lane states, words."""
    states, words = encode(ids, table, max(1, min(lanes, len(ids))))
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = zlib.compress(np.packbits([d is None for d in doc_ids]).tobytes() + keys.tobytes()
                         + sizes.astype(np.int64).tobytes(), 6)
    body = head + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return struct.pack(_HEAD, b"rANS", len(states), len(doc_ids), len(ids), len(head), len(words)) + body


def unpack_block(raw: bytes, table: Frequencies, slots: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids) of a block."""
    magic, lanes, n_docs, n, head_size, n_words = struct.unpack_from(_HEAD, raw)
    if magic != b"rANS":
        raise ValueError("not a block")
    at = struct.calcsize(_HEAD)
    head = zlib.decompress(raw[at:at + head_size])
    at += head_size
    bits = (n_docs + 7) // 8
    null = np.unpackbits(np.frombuffer(head, np.uint8, bits), count=n_docs)
    keys = np.frombuffer(head, np.int64, n_docs, bits)
    sizes = np.frombuffer(head, np.int64, n_docs, bits + 8 * n_docs)
    states = np.frombuffer(raw, "<u8", lanes, at)
    words = np.frombuffer(raw, "<u4", n_words, at + 8 * lanes)
    ids = decode(n, states, words, table, slots)
    return [None if z else k for z, k in zip(null.tolist(), keys.tolist(), strict=True)], sizes, ids


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


# raw token files: chunks of (documents, ids) between counting and coding

_RAW = "<QQQ"


def _tokenise(folder: str, definition, end_id: int):
    """Arrow batches (id, text) in order -> a raw file of the partition; rows (part, symbol, n) of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(definition.value)
        count = np.zeros(0, np.int64)
        docs = tokens = 0
        with WholeFile(f"{folder}/raw-{part:06d}") as out, pa.CompressedOutputStream(out, "zstd") as z:
            batch = first
            while batch is not None:
                doc_ids = batch.column("id").to_pylist()
                for at, texts in text_chunks(batch.column("text")):
                    ids, n = enc.encode(texts)
                    n = n + 1
                    ends = np.cumsum(n)
                    full = np.empty(int(ends[-1]), np.uint32)
                    is_end = np.zeros(len(full), bool)
                    is_end[ends - 1] = True
                    full[is_end] = end_id
                    full[~is_end] = ids
                    seen = np.bincount(full, minlength=len(count))
                    seen[:len(count)] += count
                    count = seen
                    docs += len(texts)
                    tokens += len(full)
                    own = doc_ids[at:at + len(texts)]
                    width = 2 if len(count) <= 1 << 16 else 4
                    z.write(struct.pack(_RAW, len(texts), len(full), width))
                    z.write(np.array([d is None for d in own], np.uint8).tobytes())
                    z.write(np.array([0 if d is None else d for d in own], np.int64).tobytes())
                    z.write(n.astype(np.int64).tobytes())
                    z.write(full.astype(np.uint16 if width == 2 else np.uint32).tobytes())
                batch = next(batches, None)
        used = np.flatnonzero(count)
        for at in range(0, len(used), 50_000):
            some = used[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1] * len(some), pa.int32()),
                                              "symbol": pa.array(some, pa.int64()), "n": pa.array(count[some], pa.int64())})
        yield pa.RecordBatch.from_pydict({"part": pa.array([part, part], pa.int32()), "symbol": pa.array([-1, -2], pa.int64()),
                                          "n": pa.array([tokens, docs], pa.int64())})
        del first, ids, n, full, is_end, seen, count, used
        give_back()

    return run


def _raw_chunks(uri: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression="zstd") as z:
        def take(size: int) -> bytes:
            parts = []
            while size:
                b = z.read(size)
                if not b:
                    raise EOFError(f"{uri} ends too early")
                parts.append(b)
                size -= len(b)
            return b"".join(parts)

        size = struct.calcsize(_RAW)
        while head := z.read(size):
            n_docs, n, width = struct.unpack(_RAW, head + take(size - len(head)))
            null = np.frombuffer(take(n_docs), np.uint8)
            keys = np.frombuffer(take(8 * n_docs), np.int64)
            sizes = np.frombuffer(take(8 * n_docs), np.int64)
            ids = np.frombuffer(take(width * n), np.uint16 if width == 2 else np.uint32)
            yield [None if z else k for z, k in zip(null.tolist(), keys.tolist(), strict=True)], sizes, ids


def _blocks(chunks, block_tokens: int):
    """Runs of whole documents of at least ``block_tokens`` ids (the last may be shorter)."""
    docs: list[int | None] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = 0
    for keys, n, toks in chunks:
        ends = np.cumsum(n)
        at = done = 0
        while at < len(keys):
            # as many documents as fill the block
            to = min(len(keys), int(np.searchsorted(ends, done + block_tokens - held)) + 1)
            upto = int(ends[to - 1])
            docs += keys[at:to]
            sizes.append(n[at:to])
            ids.append(toks[done:upto])
            held += upto - done
            at, done = to, upto
            if held >= block_tokens:
                yield docs, np.concatenate(sizes), np.concatenate(ids)
                docs, sizes, ids, held = [], [], [], 0
    if docs:
        yield docs, np.concatenate(sizes), np.concatenate(ids)


def write_tokens(docs: DataFrame, definition: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", block_tokens: int = BLOCK_TOKENS, lanes: int = LANES) -> str:
    """Encode every text, ids in ascending order of ``id_col``; the folder of the files.

    ``definition`` is a tokenizer's JSON; ``end_id`` ends each document.  A null
    text counts as empty (its only id is the end id); null ids come first; rows
    alike in id are ordered by text hash; an empty table makes no part file.
    Other columns are not read.

    Two passes: tokens are written and counted (one range shuffle of the texts),
    then coded with the shared table.  The driver sees two numbers for each part
    and one for each symbol of the vocabulary.
    """
    ship_package()
    spark = docs.sparkSession
    raw, folder = new_folder(spark, "tokens-raw"), folder or new_folder(spark, "tokens")
    shared = spark.sparkContext.broadcast(definition)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    counted = rows.mapInArrow(_tokenise(raw, shared, end_id), "part int, symbol bigint, n bigint")
    counts, totals, n_docs = {}, {}, 0
    for r in counted.groupBy("part", "symbol").agg(F.sum("n").alias("n")).collect():
        if r["part"] < 0:
            counts[r["symbol"]] = r["n"]
        elif r["symbol"] == -1:
            totals[r["part"]] = r["n"]
        else:
            n_docs += r["n"]
    table = Frequencies.of_counts(counts)
    with WholeFile(f"{folder}/table") as out:
        out.write(table.to_bytes())
    if not totals:
        return folder
    starts, at = [], 0
    for part in sorted(totals):
        starts.append((part, at))
        at += totals[part]
    frequencies = spark.sparkContext.broadcast(table.to_bytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies.from_bytes(frequencies.value)
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                name = f"part-{part:06d}.rans"
                at = n_docs = 0
                with WholeFile(f"{folder}/{name}") as out, WholeFile(f"{folder}/part-{part:06d}.index") as index:
                    for keys, sizes, ids in _blocks(_raw_chunks(f"{raw}/raw-{part:06d}"), block_tokens):
                        block = pack_block(keys, sizes, ids, table, lanes)
                        out.write(block)
                        index.write(f"{name}\t{at}\t{len(block)}\t{start}\t{len(ids)}\t{len(keys)}\t{checksum(ids)}\n".encode())
                        at += len(block)
                        start += len(ids)
                        n_docs += len(keys)
                yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": n_docs}])

    parts = spark.createDataFrame(starts, "part int, start bigint").repartition(len(starts))
    coded = parts.mapInArrow(code, "part bigint, n_docs bigint").agg(F.sum("n_docs")).first()[0]
    if coded != n_docs:
        raise RuntimeError(f"{coded} of {n_docs} documents were coded")
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").option("pathGlobFilter", "*.index").csv(folder)


def read_documents(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the blocks of an index: (doc_id, start, n_tokens, ids_crc32[, ids]) of each document."""
    ship_package()
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots = None
        for batch in batches:
            for b in batch.to_pylist():
                if table is None:
                    fs, path = open_fs(f"{folder}/table")
                    with fs.open_input_stream(path) as f:
                        table = Frequencies.from_bytes(f.read())
                    slots = table.slots()
                fs, path = open_fs(f"{folder}/{b['file']}")
                with fs.open_input_file(path) as f:
                    raw = f.read_at(b["length"], b["at"])
                keys, sizes, ids = unpack_block(raw, table, slots)
                if checksum(ids) != b["crc32"] or len(ids) != b["n_tokens"] or len(keys) != b["n_docs"]:
                    raise ValueError(f"{b['file']} at {b['at']}: checksum mismatch")
                ends = np.cumsum(sizes)
                each = [ids[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(b["start"] + ends - sizes, pa.int64()),
                       "n_tokens": pa.array(sizes, pa.int64()),
                       "ids_crc32": pa.array([checksum(x) for x in each], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    # index rows are tiny, their blocks are not: deal them out by number
    return index.repartition(max(1, math.ceil(index.count() / BLOCKS_PER_TASK))).mapInArrow(read, schema)
