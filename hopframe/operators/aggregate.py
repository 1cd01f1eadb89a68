"""Aggregates: macro and micro means, zero-filled domains, histograms, coverage, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def micro(valid: Column, total: Column) -> Column:
    """Sum over sum; 1 where there is nothing to be valid."""
    return F.when(F.coalesce(F.sum(total), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.sum(valid) / F.sum(total))


def grouped_and_total(df: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """One row per group and one for all rows (group null, is_total true) from a single pass."""
    return df.rollup(by).agg(F.grouping(by).cast("boolean").alias("is_total"), *aggs)


def over_domain(counts: DataFrame, by: str, domain: list, fills: dict[str, object]) -> DataFrame:
    """Groups of a fixed domain, missing ones filled."""
    spark = counts.sparkSession
    kind = counts.schema[by].dataType
    full = spark.createDataFrame([(x,) for x in domain], f"`{by}` {kind.simpleString()}")
    return full.join(counts, by, "left").fillna(fills)


def accuracy_by_class(df: DataFrame, expected: str, predicted: str, domain: list) -> DataFrame:
    hit = F.col(expected) == F.col(predicted)
    rows = df.groupBy(expected).agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"))
    rows = over_domain(rows, expected, domain, {"total": 0, "correct": 0})
    return rows.withColumn("recall", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def confusion(df: DataFrame, expected: str, predicted: str, domain: list) -> DataFrame:
    some = df.where(F.col(expected).isin(domain))
    return some.groupBy(expected).pivot(predicted, domain).count().na.fill(0)


def error_patterns(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    wrong = df.where(~F.col(expected).eqNullSafe(F.col(predicted)))
    return wrong.groupBy(F.concat_ws(" -> ", F.col(expected).cast("string"), F.col(predicted).cast("string")).alias("pattern")).count()


def multi_label(df: DataFrame, flags: str, domain: list[str]) -> DataFrame:
    """(flag, n) for each of the domain: flags aren't exclusive; unknown ones are refused."""
    every = df.select(F.explode(flags).alias("flag"))
    unknown = every.where(~F.col("flag").isin(domain)).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown flag {unknown[0][0]}")
    return over_domain(every.groupBy("flag").agg(F.count("*").alias("n")), "flag", domain, {"n": 0})


def mean_std(value: Column) -> tuple[Column, Column]:
    """Mean, and sample deviation that is 0 for a single value."""
    return F.avg(value), F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def sweep(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long format: keys, metric, n, mean, std."""
    long = df.unpivot(keys, metrics, "metric", "value").where(F.col("value").isNotNull())
    mean, std = mean_std(F.col("value"))
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), mean.alias("mean"), std.alias("std"))


def delta(df: DataFrame, keys: list[str], by: str, a, b, value: str) -> DataFrame:
    """Mean of a less mean of b where both are there."""
    mean = lambda x: F.avg(F.when(F.col(by) == x, F.col(value)))
    return df.groupBy(*keys).agg((mean(a) - mean(b)).alias("delta")).where(F.col("delta").isNotNull())


def cost_summary(df: DataFrame, value: str) -> DataFrame:
    """n_measured, mean, median, total over the rows with a number; one row, of nulls where there is none."""
    one = ordered.quantiles(df, [], [value], {"median": 0.5})
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_measured"), *(F.max(c).alias(c) for c in ("mean", "median", "total")))


def mode_with_priority(df: DataFrame, key: str, value: str, priority: Column) -> DataFrame:
    """Most frequent value of each key; ties by priority, then value."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"), F.max(priority).alias("p"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", "p", value)).alias(value))


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns))


def fingerprint(df: DataFrame, line: Column) -> DataFrame:
    """Order-free digest of all rows' lines: count, sum and xor of 64-bit hashes (partial sums; no list is gathered)."""
    h = F.xxhash64(line)
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def sorted_fingerprint(df: DataFrame, line: Column) -> DataFrame:
    """sha256 of the sorted lines joined by line feeds, for pinned evaluation sets (their size is declared and small)."""
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))


def same_definition(df: DataFrame, name: str, definition: str) -> DataFrame:
    """(definition, names): rows grouped by equal definitions, a map or a JSON object in any order of keys; null and empty
    ones are left out."""
    kind = df.schema[definition].dataType.typeName()
    given = F.col(definition) if kind == "map" else F.from_json(definition, "map<string,string>")
    entries = F.array_sort(F.map_entries(given))
    rows = df.select(F.col(name).alias("name"), F.to_json(F.map_from_entries(entries)).alias("definition"), F.size(entries).alias("n"))
    return rows.where("n > 0").groupBy("definition").agg(F.array_sort(F.collect_list("name")).alias("names"))
