"""Shared plumbing of the training-data operators: work folders, staged tables, row ids, side tables.

Everything that must outlive one job (lost executors included) is written below the folder named by
``spark.checkpoint.dir``, which driver and executors share. Input text is never shuffled by operators
that can avoid it: they key rows by ``row_id`` (scan partition and position, as given by
``monotonically_increasing_id``) and hand per-partition side tables back to the same scan partition.
The input must therefore be deterministic, as any stored table is; its partition layout is fixed by
the file splits.
"""

from __future__ import annotations

import atexit
import os
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


BATCH_BYTES = 1 << 20


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone, and send them batches of at most
    BATCH_BYTES (the session's own setting where that is less): ten thousand long texts would be a batch otherwise, held
    by the JVM and the worker of each task at once."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(setting).lower().removesuffix("b")
    if not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(setting, BATCH_BYTES)


def work_root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir (local sessions without one get a temp folder)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        make_importable(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
                base = "file://" + tempfile.mkdtemp(prefix="hopframe-")
            else:
                base = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in base and not base.startswith("file:"):
            base = "file://" + base
        root = f"{base.rstrip('/')}/hopframe-{uuid.uuid4().hex[:12]}"
        _ROOTS[app] = root
        atexit.register(_drop_root, spark, root)
    return _ROOTS[app]


def _drop_root(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, root)
        except Exception:  # the JVM may be gone at interpreter exit; nothing depends on this
            pass


def hadoop_path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = hadoop_path(spark, uri)
    fs.delete(path, True)


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{work_root(spark)}/{tag}-{uuid.uuid4().hex[:8]}"


def stage(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df below the shared folder and read it back: durable, and the lineage ends here."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, *columns) -> DataFrame:
    """The given columns plus row_id: scan partition in the upper bits, position in the lower 33."""
    make_importable(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias("row_id"), *columns)


def partition_of(row_id: str = "row_id"):
    return F.shiftright(F.col(row_id), 33).cast("int")


def scan_partitions(source: DataFrame) -> int:
    return max(1, source.rdd.getNumPartitions())


PIECES = 4  # tasks that share what one scan partition is told


def side_table(df: DataFrame, tag: str, source: DataFrame) -> str:
    """Write df, which has row_id or pid, in one folder per scan partition of source; workers load only their own. It
    is written by as many tasks as source has partitions, whatever the session's default, so tasks don't grow with
    the input."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    deal = F.pmod(F.xxhash64(*df.columns), F.lit(PIECES))
    if "pid" not in df.columns:
        df = df.withColumn("pid", partition_of())
    df.repartition(scan_partitions(source), "pid", deal).write.option("compression", "zstd").partitionBy("pid").parquet(path)
    return path


def load_side(path: str, pid: int) -> pa.Table | None:
    """A worker's part of a side table; None where that partition has no rows."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(path)
    files = [f for f in fs.get_file_info(pafs.FileSelector(f"{base}/pid={pid}", allow_not_found=True)) if f.is_file and f.base_name.startswith("part-")]
    if not files:
        return None
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f.path)).read() for f in sorted(files, key=lambda x: x.path)])


_TOLD: dict[str, object] = {}


def tell(spark: SparkSession, what: object, tag: str) -> str:
    """Write an object of bounded size below the shared folder, for workers to read with `told`. Unlike a broadcast's
    copies on every executor's disk, which stay until its garbage is collected, the one file goes with `remove`."""
    from pyarrow import fs as pafs

    path = new_dir(spark, tag)
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(base), recursive=True)
    with fs.open_output_stream(base) as f:
        f.write(pickle.dumps(what, protocol=5))
    return path


def told(path: str):
    """What `tell` has written, read once by a worker as long as it's the last one."""
    from pyarrow import fs as pafs

    if path not in _TOLD:
        _TOLD.clear()
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(base) as f:
            _TOLD[path] = pickle.loads(f.read())
    return _TOLD[path]


_HELD: list[dict | list] = [_TOLD]  # what modules keep in a worker between tasks
_LAST = [""]


def held(store):
    """Register a module's dict or list of things that a worker keeps between tasks; see `tidy`."""
    _HELD.append(store)
    return store


def tidy(work):
    """A mapInArrow function that gives freed memory back to the system at its end, and, where the worker's last task was
    another module's, first drops what modules have kept: workers live on between tasks and stages, and an executor's
    limit counts what their allocators keep."""
    owner = work.__module__

    def run(batches):
        forget_others(owner)
        yield from work(batches)
        give_back()

    return run


def forget_others(owner: str) -> None:
    if _LAST[0] != owner:
        _LAST[0] = owner
        for store in _HELD:
            store.clear()
        give_back()


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def task_partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# ---- columnar text kernels -------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """Cut a batch into runs of rows of about `most` text bytes (one long row may exceed it)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = held([])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        grown = []
        for b in (BASE, INVERSE):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        if n > 8 << 20:
            return grown[0], grown[1]
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that low and high bits are equally usable."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c, so that (c[j] - c[i]) * BASE**-i is the hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=c[1:])
    return c


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, the row of each word, its first byte and its end.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased.
    """
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    sep = SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    word = ~sep
    first = word.copy()
    first[1:] &= sep[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= sep[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = LOWER[data]
    step = 1 << 20
    at = 0
    while at < len(starts):  # runs of whole words of about a megabyte, so that the tables of powers stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        a, b = starts[at], ends[to - 1]
        c = prefix_hash(low[a:b])
        _, down = powers(b - a + 1)
        s, e = starts[at:to] - a, ends[at:to] - a
        hashes[at:to] = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    if len(sorted_keys) == 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---- dense counters, summed without meeting in one task ----------------------------------------

SLICE = 1024


def dense_batches(counts: np.ndarray):
    """Rows (slice, counts) of the non-zero slices of one partition's int64 counters."""
    counts = np.ascontiguousarray(counts.reshape(-1), np.int64)
    if len(counts) % SLICE:
        counts = np.concatenate((counts, np.zeros(-len(counts) % SLICE, np.int64)))
    parts = counts.reshape(-1, SLICE)
    live = np.flatnonzero(parts.any(axis=1))
    for at in range(0, len(live), 1024):
        some = live[at : at + 1024]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some.astype(np.int32)), "counts": pa.array([parts[i].tobytes() for i in some], pa.binary())})


DENSE = "slice int, counts binary"


def sum_dense(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all partitions' counters; `size` of them reach the driver, whatever the input."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.int64)
                if k in total:
                    total[k] += own
                else:
                    total[k] = own.copy()
        keys = sorted(total)
        for at in range(0, len(keys), 1024):
            yield pa.RecordBatch.from_pydict({"slice": pa.array(keys[at : at + 1024], pa.int32()), "counts": pa.array([total[k].tobytes() for k in keys[at : at + 1024]], pa.binary())})

    out = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for k, raw in rows.repartition("slice").mapInArrow(tidy(add), DENSE).collect():
        out[k * SLICE : (k + 1) * SLICE] = np.frombuffer(raw, np.int64)
    return out[:size]
