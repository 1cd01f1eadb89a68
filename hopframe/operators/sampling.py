"""Deterministic samples: rows are ordered by md5 of their key (and a seed), the same in any engine. Ranks are per group;
where a group may be large, a threshold on the hash is found first, so no window sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def exact(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows without replacement (TakeOrdered); fewer rows are refused."""
    have = df.count()
    if n > have:
        raise ValueError(f"{n} rows are asked for, there are {have}")
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def per_group(df: DataFrame, group: str, key: str, n: Column | int, seed: str = "") -> DataFrame:
    """Up to n rows of each group. WindowGroupLimit keeps n rows of a group in each partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(order_key(F.col(key), seed), key)
    limit = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= limit)


def balanced(df: DataFrame, group: str, key: str, size: int, groups: list, seed: str = "") -> DataFrame:
    """size // k rows of each of k groups, the remainder to the first ones; a group too small is refused."""
    quota = {g: size // len(groups) + (i < size % len(groups)) for i, g in enumerate(groups)}
    have = {r[0]: r[1] for r in df.where(F.col(group).isin(groups)).groupBy(group).count().collect()}
    short = {g: have.get(g, 0) for g, q in quota.items() if have.get(g, 0) < q}
    if short:
        raise ValueError(f"too few rows: {short}, wanted {quota}")
    most = max(quota.values())
    some = per_group(df.where(F.col(group).isin(groups)), group, key, most, seed)
    limit = F.lit(0)
    for g, q in quota.items():
        limit = F.when(F.col(group) == g, F.lit(q)).otherwise(limit)
    return some.where(F.col("sample_rank") <= limit)


def water_fill(counts: dict, total: int) -> dict:
    """Quotas: the smallest group first, each at most an even share (rounded up) of what is left."""
    out, left = {}, total
    order = sorted(counts, key=lambda g: (counts[g], g))
    for i, g in enumerate(order):
        out[g] = min(counts[g], -(-left // (len(order) - i)))
        left -= out[g]
    return out


def capped(df: DataFrame, group: str, key: str, total: int, seed: str = "") -> DataFrame:
    """At most `total` rows, filled up evenly over groups."""
    quota = water_fill({r[0]: r[1] for r in df.groupBy(group).count().collect()}, total)
    if not quota:
        return df.withColumn("sample_rank", F.lit(0))
    some = per_group(df, group, key, max(max(quota.values()), 1), seed)
    limit = F.lit(0)
    for g, q in quota.items():
        limit = F.when(F.col(group) == g, F.lit(q)).otherwise(limit)
    return some.where(F.col("sample_rank") <= limit)


def folds(df: DataFrame, stratum: str, key: str, k: int, seed: str = "") -> DataFrame:
    """Fold 0..k-1 of each row, even within each stratum: its rank in hash order modulo k.

    Ranks are found without sorting a stratum in one task: hash ranges are counted, earlier ranges add up."""
    h = order_key(F.col(key), seed)
    df = df.withColumn("\x00h", h).withColumn("\x00p", F.substring(h, 1, 3))  # 4096 ranges
    counts = df.groupBy(stratum, "\x00p").count()
    before = F.sum("count").over(Window.partitionBy(stratum).orderBy("\x00p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(stratum, "\x00p", F.coalesce(before, F.lit(0)).alias("\x00s"))
    rank = F.row_number().over(Window.partitionBy(stratum, "\x00p").orderBy("\x00h", key)) - 1
    out = df.withColumn("\x00r", rank).join(starts, [stratum, "\x00p"])
    return out.withColumn("fold", F.pmod(F.col("\x00s") + F.col("\x00r"), F.lit(k)).cast("int")).drop("\x00h", "\x00p", "\x00r", "\x00s")


def representatives(df: DataFrame, vector: str, key: str, size: int, per_cluster: int = 1, seed: int = 42) -> DataFrame:
    """`size` distinct rows by k-means: ceil(size / per_cluster) clusters; round-robin over clusters by distance to the
    centre, so each gives one before any gives a second."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = df.count()
    if size > n:
        raise ValueError(f"{size} rows are asked for, there are {n}")
    k = min(n, -(-size // per_cluster))
    data = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=max(k, 2), seed=seed, maxIter=10, initSteps=2).fit(data.select("features"))
    spark = df.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    near = model.transform(data).withColumnRenamed("prediction", "cluster").join(centres, "cluster")
    square = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", key))
    return near.withColumn("distance", F.sqrt(square)).withColumn("cluster_rank", rank).drop("features", "centre").orderBy("cluster_rank", "cluster", key).limit(size)
