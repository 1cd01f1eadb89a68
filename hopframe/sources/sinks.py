"""Writers: JSON lines, partitioned exports, guarded appends, embedding caches, run artifacts."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """JSON lines; with an order, files and rows follow it (one file only for small results)."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    (out.coalesce(1) if one_file else out).write.mode("error").option("ignoreNullFields", False).json(path)


def by_slug(df: DataFrame, path: str, slug: str = "slug") -> None:
    """One folder per slug, rows by index (null last)."""
    df.repartition(slug).sortWithinPartitions(slug, F.col("index").asc_nulls_last()).write.partitionBy(slug).json(path)


def append_guarded(df: DataFrame, path: str, key: str, identity: list[str]) -> int:
    """Append rows whose key isn't there yet; refuses another schema or another identity. Returns the rows added."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return df.count()
    if old.columns != df.columns or [f.dataType for f in old.schema] != [f.dataType for f in df.schema]:
        raise ValueError(f"columns are {old.columns}, not {df.columns}")
    have, new = old.select(*identity).first(), df.select(*identity).first()
    if have is not None and new is not None and have != new:
        raise ValueError(f"the table is of {have.asDict()}, these rows of {new.asDict()}")
    fresh = df.join(old.select(key), key, "left_anti").select(*df.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def joined_csv(results: DataFrame, gold: DataFrame, path: str, key: str, steps: str) -> None:
    """All results, with their gold steps in one column (empty without gold), as CSV with a header."""
    own = gold.groupBy(key).agg(F.any_value(F.array_join(steps, " | ")).alias("gold_decomposition"))
    rows = results.join(own, key, "left").select(*results.columns, F.coalesce("gold_decomposition", F.lit("")).alias("gold_decomposition"))
    rows.write.option("header", True).option("escape", '"').csv(path)


def cache_key(*parts: str) -> str:
    import hashlib

    return hashlib.sha256("::".join(parts).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table stored under a content key; anything unreadable or incomplete is made again."""
    path = f"{root}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def probe(spark: SparkSession, path: str, vector: str, rows: int, dimension: int) -> DataFrame | None:
    """A stored table of vectors, or None where it can't be read, isn't complete or holds other sizes."""
    try:
        df = spark.read.parquet(path)
        seen = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(vector) != dimension, F.lit(True))).alias("bad")).first()
    except Exception:  # whatever is wrong with a cache, it's a miss
        return None
    return df if seen["n"] == rows and not seen["bad"] else None


def artifacts(folder: str, config: dict, metrics: dict, title: str, notes: list[str], prefix: str = "") -> dict[str, str]:
    """config.json, metrics.json and notes.md of a run (driver side; they are small)."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    now = datetime.now(timezone.utc).isoformat()
    out = {}
    for name, body in (("config.json", json.dumps(config, indent=2, default=str, ensure_ascii=False)), ("metrics.json", json.dumps({**metrics, "written_at": now}, indent=2, default=str, ensure_ascii=False)), ("notes.md", "\n".join([f"# {title}", "", *notes, ""]))):
        p = base / f"{prefix}{name}"
        p.write_text(body, encoding="utf-8")
        out[name] = str(p)
    return out


def refuse_below(path: str, read_only: str) -> None:
    if Path(path).resolve().is_relative_to(Path(read_only).resolve()):
        raise ValueError(f"{path} is below {read_only}, which is read-only")
