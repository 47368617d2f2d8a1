"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster the master and partition count come from spark-submit; the
    arguments are for local runs and tests.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names this folder. Only a session in one process (a ``local``
    master: tests and trials) gets a folder of its own when it is unset; on a
    cluster a machine-local folder would lose data, so that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` computed once into the shared folder and reread, and the folder (see ``discard``)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into the shared folder and reread (run-time failures surface here)."""
    return written_at(df, name)[0]


#: rows of a table that one task prepares at most, and at least before there are as many tasks as cores
TASK_ROWS, LEAST_TASK_ROWS = 25_000, 5_000


def spread(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parts of equal row counts, for wide work on narrow rows.

    A table of few bytes comes in one or two splits however many rows it has, and
    every later pass would run in as many tasks. A table too small for two parts
    is returned as it is."""
    n = df.count()
    parts = max(-(-n // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_TASK_ROWS))
    return written(df.repartition(parts), name) if n >= 2 * LEAST_TASK_ROWS else df


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of ``path`` as tasks open it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage.

    A reliable checkpoint writes the data in a second job after the one that
    computes it; caching first makes that second job read the cached blocks
    instead of recomputing the plan. The cache is dropped once the files exist.
    """
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)
