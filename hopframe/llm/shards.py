"""A sharded table with size-tiered compaction, in DataFrame operations only.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the live shards into tiers by size (a tier
spans a factor of `fan_in`); where a tier has `fan_in` shards or more, it merges them into files of about
`target_bytes`, which leaves shards of at least that size alone. Rows are written about once per tier, so
log_fan_in(target / arrival) times in all.

A version is a manifest, a Parquet table of the live shards (path, bytes, rows, tier). It is written aside and
renamed to its number, which fails if that number exists: of two writers one commits, the other reads the new
version and tries again. Readers follow the newest manifest and see all of a version or none of it; shards of
older versions stay until `vacuum`. Files that a lost task or writer leaves are in no manifest and are never read.

Rows are kept as they are: nulls, repeated rows and any columns (a batch may lack some, which are then null);
an empty batch commits a version without new shards; an empty table reads as no rows.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TARGET = 128 << 20
FAN_IN = 4
MANIFEST = "path string, bytes long, n_rows long, tier int"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fan_in = target_bytes, fan_in
        self.fs, base = common.hadoop_path(spark, f"{self.root}/versions")
        self.fs.mkdirs(base)

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def version(self) -> int:
        """The newest committed version; 0 for a new table."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/versions/{v}")

    def _commit(self, manifest: DataFrame, version: int) -> None:
        aside = f"pending-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.root}/versions/{aside}")
        if self.fs.exists(self._path("versions", str(version))) or not self.fs.rename(self._path("versions", aside), self._path("versions", str(version))):
            raise Conflict(f"version {version} exists")
        if self.fs.exists(self._path("versions", str(version), aside)):  # a store whose rename moves into an existing folder
            self.fs.delete(self._path("versions", str(version), aside), True)
            raise Conflict(f"version {version} exists")

    def _tier(self, size):
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / F.lit(float(1 << 16))) / math.log(self.fan_in))).cast("int")

    def _shards(self, folder: str) -> DataFrame:
        """The shards of a written folder, with their sizes and rows."""
        files = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")
        sized = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        return sized.select("path", "bytes", "n_rows", self._tier(F.col("bytes")).alias("tier"))

    def _write(self, df: DataFrame) -> str:
        folder = f"shards-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def append(self, batch: DataFrame) -> int:
        """Write a batch as new shards, one for each of its partitions, and commit; returns the version."""
        have = set(batch.columns)
        aligned = batch.select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        new = self._shards(self._write(aligned))
        while True:
            v = self.version()
            try:
                self._commit(self.manifest(v).unionByName(new), v + 1)
                return v + 1
            except Conflict:
                continue

    def compact(self, keep_old: bool = True) -> int:
        """Merge the tiers that are full, lowest first, until none is; returns the version. keep_old False vacuums after
        each merge, for a table that nobody else reads meanwhile."""
        while True:
            v = self.version()
            live = self.manifest(v)
            small = live.where(F.col("bytes") < self.target)
            full = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fan_in).orderBy("tier").first()
            if full is None:
                return v
            merged = small.where(F.col("tier") == full.tier)
            paths = [r.path for r in merged.select("path").orderBy("path").collect()]  # names of files, not rows
            files = max(1, math.ceil(full.bytes / self.target))
            if files >= len(paths):
                return v
            rows = self.spark.read.schema(self.schema).parquet(*paths).coalesce(files)
            new = self._shards(self._write(rows))
            try:
                self._commit(live.join(merged.select("path"), "path", "left_anti").select("path", "bytes", "n_rows", "tier").unionByName(new), v + 1)
            except Conflict:
                continue
            if not keep_old:
                self.vacuum()

    def read(self, version: int | None = None) -> DataFrame:
        paths = [r.path for r in self.manifest(version).select("path").orderBy("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def vacuum(self) -> int:
        """Delete shards that the newest version doesn't name; only while nobody reads older versions."""
        live = {r.path.rsplit("/", 1)[1] for r in self.manifest().select("path").collect()}
        gone = 0
        for folder in self.fs.listStatus(self._path()):
            if folder.getPath().getName().startswith("shards-"):
                for f in self.fs.listStatus(folder.getPath()):
                    if f.getPath().getName().startswith("part-") and f.getPath().getName() not in live:
                        self.fs.delete(f.getPath(), False)
                        gone += 1
        return gone

    def describe(self) -> str:
        tiers = self.manifest().groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("tier").collect()
        return json.dumps({"version": self.version(), "tiers": [r.asDict() for r in tiers]})


ARRIVALS = 4


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """documents, arriving in batches, compacted, and read back through the newest manifest: every row, with the
    digest of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = ShardedTable(spark, common.new_dir(spark, "sharded"), docs.schema)
    arrival = F.pmod(F.xxhash64("doc_id", "source"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        table.append(docs.where(arrival == k))
    table.compact(keep_old=False)
    return table.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP4_SQL = "select doc_id, lang, source, n_chars, cast(strlen(text) as bigint) as n_bytes, md5(text) as text_md5 from documents"
