"""Nearest neighbours by additive quantisation.

A vector is the sum of one word from each of `books` codebooks, all of full dimension. The codebooks are fitted
one after the other to what the earlier ones leave (k-means), on a sample of at most SAMPLE vectors, the ones with
the smallest hashes; every vector is then encoded by beam search over the books and indexed with its codes and the
norm of its reconstruction. A query scores all indexed vectors from a table of its products with the words:

    |q - x|^2 ~ |q|^2 - 2 sum_m <q, word_m(x)> + |x|^2

and the best `shortlist` are ranked again by their exact distance. The k-th of these is proven: a vector's distance is
at least that of its reconstruction less the reconstruction's error, which is indexed too, and every vector for which
this isn't above the k-th is ranked exactly as well. So results are those of brute force, whatever the vectors; the
codes only spare exact distances.

Equal vectors are indexed once, with the k + 1 smallest of their ids, so a group of copies takes one place of a
shortlist, however large it is. Queries and index are dealt out in blocks; a task answers one block of queries
from one block of vectors and keeps the best k ids of it. Magnitudes don't matter: codes are in units of the sample's
median, distances are scaled where their squares would leave the doubles' range, and a vector without a finite bound is
ranked exactly.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take
no part, as candidates or queries. Rows with a null id take no part. An id that occurs twice is a candidate
with each of its vectors, and is returned at its nearest; a query id that does is answered for its smallest vector.
Queries with no other vector have no rows. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 16_384
BOOKS, WORDS = 16, 256
BEAM = 8
SHORTLIST = 1024
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4096
SLACK = 1e-9  # of the lengths involved, for rounding in the bound
CLIP = 1e15


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T * -2 + (centres**2).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.flatnonzero(n))
        sums[n > 0] = np.add.reduceat(x[order], first, axis=0)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; squares that would leave the doubles' range are taken of scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = x - y
        plain = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~((plain > 1e-140) & (plain < np.inf)))
        if len(odd):
            half = x[odd] / 2 - np.broadcast_to(y, x.shape)[odd] / 2  # the difference itself may leave it
            most = np.abs(half).max(axis=1, initial=0.0)
            scaled = half / np.where(most > 0, most, 1.0)[:, None]
            plain[odd] = np.sqrt((scaled**2).sum(axis=1)) * most * 2
    return plain


class Codebooks:
    """Books of words in units of `unit`, a power of two near the sample's median magnitude; what is far larger is
    encoded as if it were CLIP units large, which costs precision of the code and nothing of the result."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.unit = 2.0 ** np.clip(np.round(np.log2(np.median(np.abs(sample).max(axis=1)))), -1000, 1000)
        rest, found = self.small(sample).copy(), []
        for _ in range(books):
            book = _kmeans(rest, min(words, max(1, len(rest))), rounds, rng)
            found.append(book)
            rest -= book[(rest @ book.T * -2 + (book**2).sum(axis=1)).argmin(axis=1)]
        self.books = np.stack(found).astype(np.float32)  # books x words x dimension

    def small(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x / self.unit, -CLIP, CLIP).astype(np.float32)

    def words(self) -> np.ndarray:
        """The books in the vectors' own units."""
        return self.books.astype(np.float64) * self.unit

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the reconstructions; each book extends the best `beam` sums so far."""
        m, k, d = self.books.shape
        rest = self.small(x)[:, None, :]
        codes = np.zeros((len(x), 1, 0), np.uint8)
        for book in self.books:
            error = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(axis=1)
            width = min(beam, error.shape[1] * k)
            flat = error.reshape(len(x), -1)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.take_along_axis(flat, best, 1).argsort(axis=1, kind="stable"), 1)
            parent, word = best // k, best % k
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)), axis=2)
        rebuilt = (self.small(x) - rest[:, 0]).astype(np.float64) * self.unit
        with np.errstate(over="ignore"):
            return codes[:, 0], (rebuilt**2).sum(axis=1)


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    sound = v.isNotNull() & F.expr("forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('inf'))") & F.expr("exists(embedding, e -> e <> 0)")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, e -> cast(e as double))").alias("embedding")).where(F.col("vec_id").isNotNull() & sound)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def build(vectors: DataFrame, copies: int, books: int = BOOKS, words: int = WORDS) -> tuple[DataFrame, Codebooks | None, int]:
    """The index (key, ids, embedding, codes, norm, error: one row per distinct vector), its codebooks and dimension."""
    rows = _usable(vectors)
    d = rows.select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if d is None:
        return rows.sparkSession.createDataFrame([], "key long, ids array<long>, embedding array<double>, codes binary, norm double, error double"), None, 0
    d = d[0]
    rows = rows.where(F.size("embedding") == d)
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, copies)
    some = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("deal")).agg(smallest(F.collect_list("vec_id")).alias("ids"))
    few = some.groupBy("embedding", F.pmod("deal", F.lit(32)).alias("deal")).agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    distinct = few.groupBy("embedding").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    distinct = common.stage(distinct.select(F.xxhash64("embedding").alias("key"), "ids", "embedding"), "vectors")
    sample = np.array([r[0] for r in distinct.orderBy("key", F.element_at("ids", 1)).limit(SAMPLE).select("embedding").collect()])
    fitted = Codebooks(sample, books, words)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def encode(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(2), d)
                codes, _ = c.encode(x)
                rebuilt = sum(book[codes[:, j]] for j, book in enumerate(c.words()))
                with np.errstate(over="ignore"):
                    norm, error = (rebuilt**2).sum(axis=1), distances(x, rebuilt)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norm), pa.array(error)], names=["key", "ids", "embedding", "codes", "norm", "error"])

    index = distinct.repartition(F.col("key")).mapInArrow(common.tidy(encode), "key long, ids array<long>, embedding array<double>, codes binary, norm double, error double")
    return common.stage(index, "index"), fitted, d


def search(index: DataFrame, books: Codebooks | None, d: int, queries: DataFrame, k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query (vec_id, embedding), itself left out."""
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _usable(queries).where(F.size("embedding") == d).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = common.stage(asked, "queries")
    n, q = index.count(), asked.count()
    n_blocks, q_blocks = max(1, math.ceil(n / INDEX_BLOCK)), max(1, math.ceil(q / QUERY_BLOCK))
    numbered = index.select("ids", "embedding", "codes", "norm", "error", F.pmod(F.xxhash64("key", F.element_at("ids", 1)), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = numbered.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asks = asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    shared = spark.sparkContext.broadcast(books.words())

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore"):
            return ranked(left, right)

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        words = shared.value
        m = len(words)
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x, norm, error = _matrix(left["embedding"].combine_chunks(), d), left["norm"].to_numpy(), left["error"].to_numpy()
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(-1, m)
            ids = left["ids"].combine_chunks()
            flat, n_ids = ids.flatten().to_numpy(), np.asarray(ids.value_lengths())
            first = np.cumsum(n_ids) - n_ids
            length = distances(x, np.zeros(d))

            def nearest(one: int, vector: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The k nearest ids of these rows, and their distances."""
                score = distances(x[rows], vector)
                if len(rows) > 2 * k + 2:  # each of the k nearest ids is in one of as many rows, unless an id has several
                    near = np.flatnonzero(score <= np.partition(score, 2 * k + 1)[2 * k + 1])
                    if len(np.setdiff1d(flat[first[rows[near]]], [one])) >= k:
                        rows, score = rows[near], score[near]
                n = n_ids[rows]
                place = np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                v, s = flat[place], np.repeat(score, n)
                v, s = v[v != one], s[v != one]
                order = np.lexsort((v, s))
                _, where = np.unique(v[order], return_index=True)
                order = order[np.sort(where)][:k]
                return v[order], s[order]

            for one, vector in zip(right["query_id"].to_pylist(), _matrix(right["embedding"].combine_chunks(), d)):
                table = words @ vector
                product = table[0][codes[:, 0]]
                for j in range(1, m):
                    product += table[j][codes[:, j]]
                square = float(vector @ vector)
                near = norm - 2.0 * product
                rows = np.argpartition(near, shortlist - 1)[:shortlist] if len(near) > shortlist else np.arange(len(near))
                v, s = nearest(one, vector, rows)
                if len(rows) < len(near):
                    worst = s[-1] if len(s) == k else np.inf
                    scale = SLACK * (square + norm + length**2)
                    least = np.sqrt(np.maximum(near + square - scale, 0.0)) - error * (1 + SLACK)
                    open_ = ~(least > worst * (1 + SLACK))  # what has no bound, in numbers beyond the doubles' range, is ranked too
                    open_[rows] = True
                    v, s = nearest(one, vector, np.flatnonzero(open_))
                out_q.append(np.full(len(v), one, np.int64))
                out_v.append(v)
                out_s.append(s)
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": whole(out_q, pa.int64()), "vec_id": whole(out_v, pa.int64()), "score": whole(out_s, pa.float64())})

    found = blocks.groupBy("block", "deal").cogroup(asks.groupBy("block", "deal")).applyInArrow(answer, "query_id long, vec_id long, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank_ = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank_).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index, books, d = build(vectors, copies=11)
    return search(index, books, d, vectors.where("vec_id % 100 = 0"), 10)
