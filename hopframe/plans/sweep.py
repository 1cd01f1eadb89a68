"""A sweep over pool sizes and balances as one relation with a cell column, instead of one process per cell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, sampling, topk


@dataclass(frozen=True)
class Cell:
    size: int
    balance: str
    trial: int = 0

    @property
    def key(self) -> str:
        return f"size{self.size}_{self.balance}_trial{self.trial}"


def grid(sizes: list[int], balances: list[str], extra: list[tuple[int, str]] = (), trials: int = 1) -> list[Cell]:
    pairs = list(dict.fromkeys([(s, b) for s in sizes for b in balances] + list(extra)))
    return [Cell(s, b, t) for s, b in pairs for t in range(trials)]


def only(cells: list[Cell], token: str) -> list[Cell]:
    """Cells named by "sizeN", a balance, or "sizeN_balance"."""
    return [c for c in cells if token in (f"size{c.size}", c.balance, f"size{c.size}_{c.balance}")]


def trial_seeds(base: int, n: int, explicit: list[int] | None = None) -> list[int]:
    return explicit[:n] if explicit else [base + i for i in range(n)]


def pools(pool: DataFrame, cells: list[Cell], group: str, key: str, groups: list, vector: str | None = None) -> DataFrame:
    """All cells' pools, with a cell column."""
    out = None
    for c in cells:
        seed = str(c.trial)
        if c.balance == "imbalanced":
            some = sampling.exact(pool, key, c.size, seed)
        elif c.balance == "balanced":
            some = sampling.balanced(pool, group, key, c.size, groups, seed).drop("sample_rank")
        elif c.balance == "clustered" and vector:
            some = sampling.representatives(pool, vector, key, c.size, seed=42 + c.trial).select(*pool.columns)
        else:
            raise ValueError(f"unknown balance {c.balance}")
        some = some.withColumn("cell", F.lit(c.key))
        out = some if out is None else out.unionByName(some)
    return out


def retrieve(queries: DataFrame, cells: dict[str, DataFrame], key: str, vector: str, k: int, bucket: str | None = None) -> DataFrame:
    out = None
    for name, pool in cells.items():
        one = topk.similar(queries, pool, key, vector, k, bucket).withColumn("cell", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def truncate(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def stage(path: str, make: Callable[[], DataFrame], spark, overwrite: bool = False) -> DataFrame:
    """A stored stage: made once, read again afterwards."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def summarize(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return aggregate.sweep(rows, ["balance", "variant", "mode", "size"], metrics)
