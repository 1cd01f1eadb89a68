"""Validation in the pass that writes: every row's broken rules are found, counted and stored at once.

`checks` raises at the first broken constraint, for one scan each; here a table goes through one scan, all rules are
expressions of that scan, their counts are observed while the rows are written, and what needs other rows (repeated
keys, declared counts, pinned ids) is answered from the stored keys. Nothing is thrown: the caller gets good rows, a
table of problems, and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import runtime


@dataclass
class Report:
    rows: DataFrame  # those without a problem
    problems: DataFrame  # key, problem, detail
    counts: dict[str, int]  # rows, and rows that break each rule

    def summary(self) -> DataFrame:
        """problem, n: how often each occurs."""
        return self.problems.groupBy("problem").agg(F.count("*").alias("n"))


def validate(df: DataFrame, key: str, rules: dict[str, Column], details: dict[str, Column] | None = None, by: str | None = None, expected: dict | None = None, pinned: DataFrame | None = None) -> Report:
    """rules: name to an expression that is true where a row is sound (null isn't); details: what to show of those that
    aren't. A null or repeated key is a problem of all its rows. expected: rows of distinct keys for each value of `by`, or
    none at all where a value isn't declared. pinned: a table with `key`; its keys must be there, and others are left out
    of the rows without being problems."""
    broken = {n: ~F.coalesce(ok, F.lit(False)) for n, ok in rules.items()}
    detail = lambda n: (details or {}).get(n, F.lit(None)).cast("string")
    said = F.array_compact(F.array(*(F.when(b, F.struct(F.lit(n).alias("problem"), detail(n).alias("detail"))) for n, b in broken.items()))) if rules else F.array().cast("array<struct<problem: string, detail: string>>")
    seen = Observation()
    marked = df.withColumn("\x00said", said)
    counted = marked.observe(seen, F.count("*").alias("rows"), *(F.count_if(b).alias(n) for n, b in broken.items()))
    stored = runtime.stored(counted, "validated")
    own = F.col(key).cast("string")
    told = stored.select(own.alias("key"), F.explode("\x00said").alias("s")).select("key", "s.*")
    groups = stored.groupBy(key, *([by] if by else [])).agg(F.count("*").alias("\x00n"))
    keys = groups.groupBy(key).agg(F.sum("\x00n").alias("\x00n")) if by else groups
    twice = keys.where(F.col("\x00n") > 1).where(F.col(key).isNotNull())
    told = told.union(twice.select(own, F.lit("repeated_key"), F.col("\x00n").cast("string")))
    told = told.union(stored.where(F.col(key).isNull()).select(own, F.lit("no_key"), F.lit(None).cast("string")))
    if expected is not None:
        kind = df.schema[by].dataType.simpleString()
        declared = df.sparkSession.createDataFrame(list(expected.items()), f"`\x00by` {kind}, `\x00want` long")
        have = groups.where(F.col(key).isNotNull()).groupBy(by).agg(F.count("*").alias("\x00have"))
        both = have.join(declared, have[by].eqNullSafe(declared["\x00by"]), "full_outer")
        differ = both.where(F.coalesce("\x00have", F.lit(0)) != F.coalesce("\x00want", F.lit(0)))
        told = told.union(differ.select(F.lit(None).cast("string"), F.lit("declared_count"), F.concat_ws(" ", F.concat(F.lit(f"{by}="), F.coalesce(F.coalesce(by, "\x00by").cast("string"), F.lit("null"))), F.concat(F.lit("has "), F.coalesce("\x00have", F.lit(0)).cast("string")), F.concat(F.lit("declared "), F.coalesce("\x00want", F.lit(0)).cast("string")))))
    good = stored.where(F.size("\x00said") == 0).where(F.col(key).isNotNull()).join(twice.select(key), key, "left_anti")
    if pinned is not None:
        wanted = pinned.select(key).distinct()
        told = told.union(wanted.join(keys, key, "left_anti").select(own, F.lit("pinned_but_missing"), F.lit(None).cast("string")))
        good = good.join(wanted, key, "left_semi")
    return Report(good.select(*df.columns), told.toDF("key", "problem", "detail"), {k: int(v) for k, v in seen.get.items()})


def gold(df: DataFrame, key: str, steps: str, hops: str, expected: dict | None = None, pinned: DataFrame | None = None) -> Report:
    """Gold decompositions: rows have steps, and as many as their hop count says, where it is a positive number; else the
    number of steps is their hop count. Both denominators are then one number, `gold_hops`."""
    declared = F.when(F.col(hops) > 0, F.col(hops)).cast("int")
    rows = df.withColumn("gold_hops", F.coalesce(declared, F.size(steps)))
    rules = {"no_steps": F.size(steps) > 0, "denominators_differ": F.coalesce(declared == F.size(steps), F.lit(True))}
    return validate(rows, key, rules, {"denominators_differ": F.concat(declared.cast("string"), F.lit(" hops, "), F.size(steps).cast("string"), F.lit(" steps"))}, "gold_hops", expected, pinned)
