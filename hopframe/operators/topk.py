"""Nearest neighbours of queries in a pool: dot products, restricted candidates, votes, coverage, re-ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, bucket: str | None) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(bucket) if bucket else F.lit(0)).alias("bucket"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def similar(queries: DataFrame, pool: DataFrame, key: str, vector: str, k: int, bucket: str | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, pool_id, score): the k pool rows of each query with the largest dot product, ties to the smaller id.

    bucket restricts candidates to rows of the query's bucket (null is one too) before the cut. Each bucket's queries and
    pool are dealt out in blocks by its sizes; a task multiplies one block by another and keeps k of each query, so
    neither side is gathered, and rows of different buckets never meet. Rows without an id or a vector, or with a null or NaN
    component, take no part; vectors of different lengths never meet."""
    q, p = _blocks(queries, key, vector, bucket), _blocks(pool, key, vector, bucket)
    count = lambda df, most, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    q_size, p_size = count(q, BLOCK, "q_blocks").alias("l"), count(p, 4 * BLOCK, "p_blocks").alias("r")
    sizes = q_size.join(p_size, F.col("l.bucket").eqNullSafe(F.col("r.bucket"))).select(F.col("l.bucket").alias("of"), "q_blocks", "p_blocks")
    dealt = lambda df, own, n: df.join(sizes, F.col("bucket").eqNullSafe(F.col("of"))).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = dealt(q, "qb", "q_blocks").select("bucket", "id", "v", "qb", each("p_blocks").alias("pb"))
    p = dealt(p, "pb", "p_blocks").select("bucket", "id", "v", "pb", each("q_blocks").alias("qb"))

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if left.num_rows and right.num_rows:
            sides = [(t["id"].to_numpy(), t["v"].to_numpy(zero_copy_only=False), np.asarray(t["v"].combine_chunks().value_lengths())) for t in (left, right)]
            for length in np.intersect1d(sides[0][2], sides[1][2]):
                (lid, a), (rid, b) = ((i[n == length], np.stack(v[n == length])) for i, v, n in sides)
                order = np.argsort(rid, kind="stable")
                rid, b = rid[order], b[order]
                for at in range(0, len(a), 256):
                    scores = a[at : at + 256] @ b.T
                    for i, row in enumerate(scores, at):
                        where = np.flatnonzero(rid != lid[i]) if exclude_self else np.arange(len(rid))
                        if len(where) > k:
                            cut = np.partition(row[where], len(where) - k)[len(where) - k]
                            above = where[row[where] > cut]
                            where = np.concatenate((above, where[row[where] == cut][: k - len(above)]))
                        out[0].append(np.full(len(where), lid[i]))
                        out[1].append(rid[where])
                        out[2].append(row[where])
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
        return pa.table({"query_id": flat(out[0], pa.int64()), "pool_id": flat(out[1], pa.int64()), "score": flat(out[2], pa.float64())})

    found = q.groupBy("bucket", "qb", "pb").cogroup(p.groupBy("bucket", "qb", "pb")).applyInArrow(multiply, "query_id long, pool_id long, score double")
    return top(found, "query_id", [F.desc("score"), F.asc("pool_id")], k).select("query_id", "rank", "pool_id", "score")


def top(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_lists(ranked: DataFrame, *fields: str) -> DataFrame:
    """One row per query: its neighbours as array<struct>, by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "pool_id", "score", *fields)))
    return ranked.groupBy("query_id").agg(rows.alias("neighbours"))


def vote(ranked: DataFrame, label: str, most: int) -> DataFrame:
    """Most frequent label among the first `most` neighbours; ties to the smaller label."""
    n = ranked.where(F.col("rank") <= most).groupBy("query_id", label).count()
    return n.groupBy("query_id").agg(F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias("predicted"))


def rerank(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """A new score (rounded to 6 before the sort) takes the old one's place, which stays as bi_encoder_score."""
    new = ranked.withColumn("\x00new", F.round(score, 6)).withColumnsRenamed({"score": "bi_encoder_score", "rank": "bi_rank"}).withColumnRenamed("\x00new", "score")
    return top(new, "query_id", [F.desc("score"), F.asc("bi_rank")], k)


def coverage(ranked: DataFrame, group: str, ks: tuple[int, ...] = (1, 3, 6), thresholds: tuple[float, ...] = (0.5, 0.6, 0.7)) -> DataFrame:
    """Per group: mean similarity of the first k, extremes of the first, and how many of those fall below thresholds."""
    first = F.when(F.col("rank") == 1, F.col("score"))
    aggs = [F.avg(F.when(F.col("rank") <= k, F.col("score"))).alias(f"mean_top{k}") for k in ks]
    aggs += [F.min(first).alias("min_top1"), F.max(first).alias("max_top1"), F.count(first).alias("n_queries")]
    aggs += [F.count_if(first < t).alias(f"below_{int(t * 100)}") for t in thresholds]
    return ranked.groupBy(group).agg(*aggs)


def without_self(neighbours: Column, query_id: Column, question: Column, k: int) -> Column:
    """The first k of array<struct<pool_id, pool_question, ...>> that aren't the query by id or normalized text."""
    from ..functions.text import normalize_question as norm

    return F.slice(F.filter(neighbours, lambda n: ~(n["pool_id"].eqNullSafe(query_id) | (norm(n["pool_question"]) == norm(question)))), 1, k)
