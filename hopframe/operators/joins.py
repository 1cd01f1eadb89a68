"""Joins of questions, decompositions and predictions. Sides are never hinted; Catalyst broadcasts the ones it has
measured to be small, and AQE splits skewed keys of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions.text import normalize_question
from . import checks
from .ordered import merge_intervals as merge_intervals  # noqa: PLC0414


def keep_one(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("\x00rn", F.row_number().over(w)).where(F.col("\x00rn") == 1).drop("\x00rn")


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The same as keep_one by ordinal descending, as an aggregate: partial before the shuffle, so no key is hot."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("\x00r"))
    return best.select(key, "\x00r.*").select(*df.columns)


def first_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("\x00r"))
    return best.select(key, "\x00r.*").select(*df.columns)


def by_question(pred: DataFrame, gold: DataFrame, question: str = "question", ordinal: str | None = None) -> DataFrame:
    """Predictions with their gold row (columns gold_*) by normalized question, and gold_found."""
    g = gold.withColumn("qnorm", normalize_question(F.col(question)))
    g = last_wins(g, "qnorm", ordinal) if ordinal else g
    g = g.select("qnorm", *(F.col(c).alias(f"gold_{c}") for c in gold.columns), F.lit(True).alias("gold_found"))
    joined = pred.withColumn("qnorm", normalize_question(F.col(question))).join(g, "qnorm", "left")
    return joined.withColumn("gold_found", F.coalesce("gold_found", F.lit(False)))


def complete(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must have the same keys."""
    checks.require_same_keys(a, b, key)
    return a.join(b, key)


def with_fallback(left: DataFrame, right: DataFrame, key: str, question: str, ordinal: str) -> DataFrame:
    """Right rows by id, else by normalized question (first wins): two equi-joins, no OR."""
    r = right.withColumn("qnorm", normalize_question(F.col(question)))
    cols = [c for c in right.columns if c != key]
    ids = last_wins(r, key, ordinal).select(key, F.struct(*cols).alias("by_id"))
    qs = first_wins(r, "qnorm", ordinal).select("qnorm", F.struct(*cols).alias("by_q"))
    out = left.withColumn("qnorm", normalize_question(F.col(question))).join(ids, key, "left").join(qs, "qnorm", "left")
    return out.withColumn("match", F.coalesce("by_id", "by_q")).drop("by_id", "by_q", "qnorm")


def fill_empty(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
    """Fill an empty field from right (key, field), and say how: pre_existing, enriched, unknown or no_id."""
    fill = right.select(key, F.col(field).alias("\x00f"))
    empty = F.coalesce(F.length(F.trim(F.col(field).cast("string"))) == 0, F.lit(True))
    status = F.when(~empty, "pre_existing").when(F.col(key).isNull(), "no_id").when(F.col("\x00f").isNotNull(), "enriched").otherwise("unknown")
    return left.join(fill, key, "left").withColumn("status", status).withColumn(field, F.when(empty, F.col("\x00f")).otherwise(F.col(field))).drop("\x00f")


def total(rows: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Left join in which every row must match."""
    missing = rows.join(predicted, key, "left_anti").select(key).limit(checks.SHOWN).collect()
    if missing:
        raise checks.ConstraintError(f"no prediction for {[r[0] for r in missing]}")
    return rows.join(predicted, key)


def unused(rows: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    return predicted.join(rows, key, "left_anti")


def concat_first_wins(parts: list[DataFrame], key: str, ordinal: str) -> DataFrame:
    """Parts one after the other, later repeats of a key dropped, with a new 0-based index."""
    every = None
    for rank, p in enumerate(parts):
        p = p.withColumn("\x00src", F.lit(rank))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    kept = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), F.struct("\x00src", ordinal)).alias("\x00r")).select(key, "\x00r.*")
    return reindex(kept, ["\x00src", ordinal]).drop("\x00src")


def concat_keep_all(parts: list[DataFrame], ordinal: str) -> DataFrame:
    every = None
    for rank, p in enumerate(parts):
        p = p.withColumn("\x00src", F.lit(rank))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    return reindex(every, ["\x00src", ordinal]).drop("\x00src")


def reindex(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """A 0-based index in the given order, without bringing all rows to one task.

    Rows are dealt into ranges, sorted and stored, each with its range's number and its place; the ranges' counts come
    from what is stored, so they fit it whatever is read later and however adaptive execution deals tasks. Only one
    count for each range reaches the driver. Rows that are equal in `order` are numbered in any, but one, order."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(runtime.tasks(df), *order).sortWithinPartitions(*order)
    placed = runtime.stored(ranges.withColumn("\x00p", F.spark_partition_id()).withColumn("\x00i", F.monotonically_increasing_id()), "ordinals")
    starts, at = [], 0
    for p, lo, n in placed.groupBy("\x00p").agg(F.min("\x00i"), F.count("*")).orderBy("\x00p").collect():
        starts.append((p, at - lo))
        at += n
    shift = spark.createDataFrame(starts, "`\x00p` int, `\x00s` long")
    out = placed.join(F.broadcast(shift), "\x00p").withColumn(name, F.col("\x00s") + F.col("\x00i"))  # one row for each range
    return out.drop("\x00p", "\x00i", "\x00s")


def gold_for(rows: DataFrame, gold: DataFrame, hop: str = "hop_count", question: str = "question") -> DataFrame:
    """rows with the gold columns of their hop count and trimmed question; null where there is none or no hop count.
    gold has one row for each."""
    keys = {hop: "\x00hop", question: "\x00question"}
    g = gold.withColumn(question, F.trim(question)).withColumnsRenamed(keys)
    same = (F.col(hop) == F.col("\x00hop")) & (F.trim(F.coalesce(question, F.lit(""))) == F.col("\x00question"))
    return rows.join(g, same, "left").drop(*keys.values())
