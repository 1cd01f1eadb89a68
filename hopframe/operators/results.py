"""Projections of results and run-level counters: what a routing or answering run writes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.metrics import safe_div


def clean(rows: DataFrame, item_id: Column, question: Column, ordinal: str) -> DataFrame:
    """id, question, index: rows with a question, trimmed, numbered from 0 in the order of `ordinal`."""
    from .joins import reindex

    kept = rows.select(item_id.alias("id"), F.trim(question).alias("question"), F.col(ordinal).alias("\x00o")).where(F.length("question") > 0)
    return reindex(kept, ["\x00o"]).select("id", "question", "index")


def predictions(rows: DataFrame, query_id: Column, hop: Column, parsed: Column, expected: Column) -> DataFrame:
    """query_id, predicted_hop, expected_hop, correct, parse_fallback (the hop is a default, not read from a response)."""
    fields = {"query_id": F.trim(query_id.cast("string")), "predicted_hop": hop.cast("int"), "expected_hop": expected.cast("int"), "correct": hop.cast("int").eqNullSafe(expected.cast("int")), "parse_fallback": ~parsed}
    return rows.select(*(c.alias(k) for k, c in fields.items()))


def hit_rate(ranked: DataFrame, hit: Column, k: int, by: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """n_queries, n_hits, rate: queries with at least one hit among their first k neighbours. queries (query_id, and `by`):
    all that were asked; those without a neighbour are misses. Without it only queries with neighbours are counted."""
    keys = [by] if by else []
    one = ranked.where(F.col("rank") <= k).groupBy("query_id", *keys).agg(F.max(hit.cast("int")).alias("\x00h"))
    if queries is not None:
        one = queries.select("query_id", *keys).join(one.select("query_id", "\x00h"), "query_id", "left")
    out = one.groupBy(*keys).agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("\x00h"), F.lit(0)).alias("n_hits"))
    return out.withColumn("rate", safe_div(F.col("n_hits"), F.col("n_queries")))


def run_counters(items: DataFrame, n_expected: int, n_paragraphs: Column, steps: Column, golds: Column) -> DataFrame:
    """One row: items, items without steps or gold answers, steps, and how many paragraphs items had."""
    return items.agg(
        F.count("*").alias("n_items"), F.count_if(F.size(steps) == 0).alias("n_without_steps"), F.count_if(F.size(golds) == 0).alias("n_without_gold"), F.sum(F.size(steps)).alias("n_steps"),
        F.min(n_paragraphs).alias("min_paragraphs"), F.max(n_paragraphs).alias("max_paragraphs"), F.avg(n_paragraphs).alias("mean_paragraphs"), F.count_if(n_paragraphs < n_expected).alias("n_below_expected"),
    )


def over_both(scored: DataFrame, executed: Column, exact: Column, jaccard: Column) -> DataFrame:
    """Rates over the items that ran, and over all, those that failed counting as empty sets: n_executed, n_items,
    exact_rate_executed, exact_rate, mean_jaccard_executed, mean_jaccard; rates without items are null."""
    of_ran = lambda c: F.avg(F.when(executed, c.cast("double")))
    return scored.agg(
        F.count_if(executed).alias("n_executed"), F.count("*").alias("n_items"), of_ran(exact).alias("exact_rate_executed"), F.avg(exact.cast("double")).alias("exact_rate"),
        of_ran(jaccard).alias("mean_jaccard_executed"), F.avg(jaccard.cast("double")).alias("mean_jaccard"),
    )


def detailed(rows: DataFrame, question: Column, response: Column, expected: Column, predicted: Column) -> DataFrame:
    """question, response without artifacts, expected, predicted, correct, pattern ("2 -> 3", null where right)."""
    right = expected.eqNullSafe(predicted)
    pattern = F.when(~right, F.concat_ws(" -> ", F.coalesce(expected.cast("string"), F.lit("none")), F.coalesce(predicted.cast("string"), F.lit("none"))))
    return rows.select(question.alias("question"), text.post_process(response).alias("response"), expected.alias("expected"), predicted.alias("predicted"), right.alias("correct"), pattern.alias("pattern"))


def normalize_schema(rows: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """One column for each name in aliases: the first of its spellings that the table has and the row fills, else the
    default. Tables of different runs get the same columns."""
    out = []
    for name, spellings in aliases.items():
        have = [F.col(f"`{c}`") for c in spellings if c in rows.columns]
        out.append(F.coalesce(*have, F.lit((defaults or {}).get(name))).alias(name))
    return rows.select(*out)


def row_indexes(rows: DataFrame, bucket: Column, index: str) -> DataFrame:
    """bucket, n, first, last: a bucket's rows by index. The rows themselves stay a table with a bucket column; a list of
    all their indexes would be as large as the bucket."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))


def cross_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys together and by each alone; the keys left out are null, `level` says which are there."""
    sets = [[*keys], *([k] for k in keys)]
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    names = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): " x ".join(s) for s in sets}
    return out.withColumn("level", F.coalesce(*(F.when(F.col("g") == g, name) for g, name in names.items()))).drop("g")
