"""What a session needs to run this library's Python functions."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


BATCH_BYTES = 1 << 20


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone (on a cluster it is installed or
    shipped with --py-files; then this changes nothing), and send them batches of at most BATCH_BYTES (the session's own
    setting where that is less): ten thousand long texts would be a batch otherwise, held by each worker."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(setting).lower().removesuffix("b")
    if not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(setting, BATCH_BYTES)


def ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        make_importable(spark)
        return query(spark, sf_dir)

    return run


def dealt(df, *keys: str):
    """Rows dealt by keys to as many tasks as the session shuffles to, which adaptive execution doesn't merge: for costly
    expressions over few bytes. A join or aggregate on the same keys needs no shuffle of its own after it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df, *keys: str):
    """The same only where a scan has fewer tasks than there are cores (files of one row group); large scans stay as
    they are."""
    return dealt(df, *keys) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def tasks(df: DataFrame) -> int:
    """As many as df has partitions, or the session shuffles to: for shuffles of all of df's rows, whose tasks then don't
    grow with the input (adaptive execution merges tasks, but never adds any)."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below spark.checkpoint.dir, which driver and executors share, that goes with the application. Where that is
    unset: a temporary folder in local mode, the warehouse on a cluster."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="hopframe-core-")
        base = base or spark.conf.get("spark.sql.warehouse.dir")
        _ROOTS[app] = f"{base.rstrip('/')}/hopframe-core-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{tag}-{uuid.uuid4().hex[:8]}"


def file_system(spark: SparkSession, uri: str):
    """Hadoop's file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _drop(spark: SparkSession, uri: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            fs, path = file_system(spark, uri)
            fs.delete(path, True)
        except Exception:  # the JVM may be gone at the interpreter's end
            pass


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once below the shared folder, and read from there: what comes after doesn't compute it again, and it
    outlives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
