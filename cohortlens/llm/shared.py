"""Files in the shared folder: tasks write whole files there, other tasks read them.  The package for Python workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import cohortlens
from cohortlens.session import checkpoint_dir

_shipped: set[str] = set()


def ship_package() -> None:
    """Send this package's source to the Python workers of the active session (once), wherever they run."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(cohortlens.__file__))
    out = os.path.join(tempfile.mkdtemp(), "cohortlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cohortlens", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(spark.sparkContext.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir`` that tasks can write to."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and reread: computed once, safe from lost executors, lineage cut."""
    return settled_at(df, name)[0]


def settled_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``settled``, and the folder (for ``discard``)."""
    folder = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    # Spark drops a shuffle's files once the driver has collected its plan: do that now, not some day
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside send rows to Python workers in batches of about ``size`` bytes (each worker and its JVM hold a batch)."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, and what it keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


class WholeFile:
    """A file that appears under its name only when it is complete; a repeated task replaces it by an equal one."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, value, trace):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
