"""WARC archives: writer, monolithic gzip normaliser, reader by sidecar index.

``write_archives`` writes each partition as one gzip stream (the form many tools
leave behind, which nothing can read from the middle).  ``normalise`` inflates
each such stream once, front to back, and writes every record as a gzip member
of its own plus a sidecar index of offsets.  ``read_archives`` reads members by
that index, in any split.  Tasks hold one record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.shared import WholeFile, new_folder, open_fs, ship_package

#: payloads below this many bytes are never replaced by a revisit
MIN_REVISIT_BYTES = 1000
#: records that one task reads on average, and bytes of an archive that one task reads together
RECORDS_PER_TASK = 2000
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, at bigint, length bigint, page_id bigint, record_type string"
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, payload binary")


def mark_revisits(pages: DataFrame, id_col: str, payload: Column, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` plus ``_digest``, ``_bytes``, ``_refers_to`` (null: a response).

    Of equal payloads of at least ``min_bytes`` the row with the largest id is the
    response; rows alike in id and payload are then all responses.  Digests are
    counted on (id, digest, bytes) rows, so payloads move once, keyed by row.
    """
    rows = pages.withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.octet_length(payload).cast("bigint"))
    small = rows.select(F.col(id_col).alias("_id"), "_digest", "_bytes")
    first = small.filter(F.col("_bytes") >= min_bytes).groupBy("_digest") \
        .agg(F.max("_id").alias("_winner"), F.count("*").alias("_n")).filter("_n > 1").select("_digest", "_winner")
    links = small.filter(F.col("_bytes") >= min_bytes).join(first, "_digest") \
        .filter(~F.col("_id").eqNullSafe(F.col("_winner"))) \
        .groupBy("_id", "_digest").agg(F.max("_winner").alias("_refers_to")).withColumnRenamed("_digest", "_d")
    return rows.join(links, rows[id_col].eqNullSafe(links["_id"]) & (rows["_digest"] == links["_d"]), "left") \
        .drop("_id", "_d")


def _clean(value: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in value)


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, raw record, block) of each record of an inflated stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        raw, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("the stream ends inside a record header")
            raw.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise EOFError("the stream ends inside a record")
        yield headers, b"".join(raw) + b"\r\n" + block + b"\r\n\r\n", block


def _urn(value: str) -> int | None:
    inner = value.strip("<>").removeprefix("urn:page:")
    return int(inner) if inner else None


def parse(headers: dict[str, str], block: bytes) -> dict:
    """One row of ``RECORD``."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and hashlib.sha1(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("payload digest mismatch")
    return {"page_id": _urn(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": headers["warc-type"], "refers_to": _urn(headers["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as gzip streams below ``folder``; (file, n_records) of each, one row a partition.

    The payload is the html in UTF-8 (null: empty).  Null ids and urls are kept
    as such; an empty table writes no file; other columns are not read.
    """
    ship_package()
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = mark_revisits(rows, "page_id", F.col("payload"), min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        name, n = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with WholeFile(f"{folder}/{name}") as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=5, mtime=0) as gz:
            batch = first
            while batch is not None:
                cols = [batch.column(c) for c in ("page_id", "url", "payload", "_digest", "_refers_to")]
                for i in range(batch.num_rows):
                    gz.write(render(*[c[i].as_py() for c in cols]))
                n += batch.num_rows
                batch = next(batches, None)
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}])

    return rows.select("page_id", "url", "payload", "_digest", "_refers_to").mapInArrow(write, "file string, n_records bigint")


def normalise(files: DataFrame, folder: str, to: str) -> DataFrame:
    """Rewrite each gzip stream named by ``files.file`` in ``folder`` record by record; (file, n_records).

    ``to`` gets ``<file>`` with one gzip member a record and ``<file>.index``, a
    tab-separated sidecar of (file, at, length, page_id, record_type).
    """

    ship_package()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = open_fs(f"{folder}/{name}")
                n = at = 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as gz, \
                        WholeFile(f"{to}/{name}") as out, WholeFile(f"{to}/{name}.index") as index:
                    for headers, record, _ in records(io.BufferedReader(gz, 1 << 20)):
                        member = gzip.compress(record, 6, mtime=0)
                        out.write(member)
                        page = _urn(headers["warc-record-id"])
                        index.write(f"{name}\t{at}\t{len(member)}\t{'' if page is None else page}\t"
                                    f"{headers['warc-type']}\n".encode())
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}])

    return files.select("file").mapInArrow(rewrite, "file string, n_records bigint")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").option("pathGlobFilter", "*.index").csv(folder)


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records (``RECORD``) that the rows of a sidecar index point to, each member inflated on its own."""

    ship_package()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary())])
        name, source = None, None
        for batch in batches:
            out, held = [], 0
            for x in batch.select(["file", "at", "length"]).to_pylist():
                if x["file"] != name:
                    fs, path = open_fs(f"{folder}/{x['file']}")
                    name, source = x["file"], fs.open_input_file(path)
                member = gzip.decompress(source.read_at(x["length"], x["at"]))
                headers, _, block = next(records(io.BytesIO(member)))
                row = parse(headers, block)
                if not payloads:
                    row["payload"] = None
                held += len(row["payload"] or b"")
                out.append(row)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    # index rows are tiny, their members are not: deal them out by number, near ones together
    n = max(1, math.ceil(index.count() / RECORDS_PER_TASK))
    near = F.floor(F.col("at") / READ_BYTES)
    return index.repartition(n, "file", near).sortWithinPartitions("file", "at").mapInArrow(read, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, **options) -> tuple[str, DataFrame]:
    """Write, normalise and open: (folder of normalised archives, their index)."""
    raw, done = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    # one row a file: as many as the write had partitions
    files = write_archives(pages, raw, **options).collect()
    if files:
        names = spark.createDataFrame([(f["file"],) for f in files], "file string").repartition(len(files))
        n = sum(r["n_records"] for r in normalise(names, raw, done).collect())
        if n != sum(f["n_records"] for f in files):
            raise RuntimeError("the normalised archives do not hold every record")
    return done, read_index(spark, done)
