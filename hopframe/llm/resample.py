"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words and word pairs; 2**BITS counters) are counted: one of the target texts,
one of all texts. A text's weight is the log ratio of its probabilities under the two,

    sum over its n-grams g of log(p_target(g) / p_raw(g)) = log((t(g) + PRIOR) / (e(g) + PRIOR)),    e(g) = r(g) * T / R

with t and r the counts of g in target and in all texts, T and R those of all n-grams: e is what the target would have if
it were drawn from all texts, and both models are smoothed by the same number of such draws. An n-gram whose t is within
DEVIATIONS standard deviations of e, which chance explains, weighs nothing; without that, a text's own rare n-grams
weigh the more the longer it is, and copies of labelled texts are favoured (README has figures). A sample without
replacement, with chances in proportion to the weights, is the top k of weight + Gumbel noise; the noise is made from a
hash of doc_id and text, so the sample is the same however the rows are stored.

All rows count towards both models, the counters are of fixed size and broadcast. The k-th key is found by counts in
ever finer ranges; no row is sorted, and at most LAST rows reach the driver.

Null or empty text has weight 0; repeated rows (doc_id and text) have equal weights and noise, ties at the end of the
sample go to the first row; very long texts are counted whole, one at a time; rows without a
label count as raw text only; labels without a row don't matter; of several labels of a doc_id, one that is
not target wins. Without target texts all weights are 0. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
PRIOR = 0.5
DEVIATIONS = 2.0
LAST = 1024


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    h, rows, _, _ = common.word_hashes(data, offsets)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    keys = [h, common.mix(h[pair] * np.uint64(0x9FB21C651E98DF25) + h[pair + 1])]
    return np.concatenate((rows, rows[pair])), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(rows: DataFrame) -> np.ndarray:
    """Counters of rows (text, target): of all texts, then of target texts."""
    size = 1 << BITS

    def count(batches):
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                own, bucket = features(*common.text_buffers(part.column(0)))
                total[:size] += np.bincount(bucket, minlength=size)
                target = part.column(1).to_numpy(zero_copy_only=False)[own] if len(own) else np.empty(0, bool)
                total[size:] += np.bincount(bucket[target], minlength=size)
        yield from common.dense_batches(total)

    return common.sum_dense(rows.mapInArrow(common.tidy(count), common.DENSE), 2 * size)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return np.where(np.abs(target - expected) >= DEVIATIONS * np.sqrt(expected + 1), ratio, 0.0)


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, doc_id, identity (a hash of doc_id and text), log_weight and label (true: target, false: not, null: none) of every row of docs (doc_id, text);
    labels has doc_id and target."""
    source = common.with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("identity"))
    told = labels.where("doc_id is not null and target is not null").groupBy("doc_id").agg(F.min("target").alias("target"))
    path = common.side_table(source.select("row_id", "doc_id").join(told, "doc_id").select("row_id", "target"), "labels", source)

    def join(batches):
        pid = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                side = common.load_side(path, pid)
                good = np.empty(0, np.int64) if side is None else np.sort(side["row_id"].to_numpy()[side["target"].to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.isin(batch.column(0).to_numpy(), good))], names=["text", "target"])

    counts = _count(source.select("row_id", "text").mapInArrow(common.tidy(join), "text string, target boolean"))
    raw, target = counts[: 1 << BITS].astype(np.float64), counts[1 << BITS :].astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target))

    def weigh(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                own, bucket = features(*common.text_buffers(part.column(2)))
                out = np.bincount(own, weights=shared.value[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(out.astype(np.float64))], names=["row_id", "doc_id", "identity", "log_weight"])

    rows = source.mapInArrow(common.tidy(weigh), "row_id long, doc_id long, identity long, log_weight double")
    return rows.join(told.withColumnRenamed("target", "label"), "doc_id", "left")


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the largest key (ties: the smaller row_id). Rows must be stored."""
    n = rows.count()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0  # rows over `high`, all of them kept
    while True:
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        if high <= low or inside.limit(LAST + 1).count() <= LAST:
            break
        step = (high - low) / 256
        if step == 0 or low + step == low:
            break
        part = F.least(F.floor((F.col(key) - low) / step), F.lit(255))
        bins = {int(r[0]): r for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for p in sorted(bins, reverse=True):
            if above + bins[p].n >= k:
                break
            above += bins[p].n
        if (bins[p].lo, bins[p].hi) == (low, high):
            break
        low, high = bins[p].lo, bins[p].hi
    edge = inside.orderBy(F.desc(key), "row_id").limit(k - above).select("row_id") if high > low else inside.orderBy("row_id").limit(k - above).select("row_id")
    last = edge.agg(F.max("row_id")).first()[0] if high <= low else None
    if last is not None:
        return rows.where((F.col(key) > high) | ((F.col(key) == high) & (F.col("row_id") <= last)))
    kept = edge.collect()  # at most LAST rows, or values that a double can't tell apart
    return rows.where((F.col(key) > high) | F.col("row_id").isin([r[0] for r in kept]))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """row_id, doc_id, log_weight, key of a sample of k rows of docs; k None: as many as the share of target among the
    labelled rows says."""
    rows = weights(docs, labels)
    u = (F.pmod(F.xxhash64(F.lit(seed), "identity"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    rows = common.stage(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    if k is None:
        n, good, told = rows.agg(F.count("*"), F.count_if("label"), F.count("label")).first()
        k = round(n * good / told) if told else n
    return top(rows, "key", k).select("row_id", "doc_id", "log_weight", "key")


def op9_resample(spark, sf_dir: str) -> DataFrame:
    """The documents drawn towards those of good quality that aren't toxic: doc_id, log_weight, gumbel_key."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))
    rows = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return rows.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"))
