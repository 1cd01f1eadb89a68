"""Plan-only mode of a search restricted to buckets: what each query will find, from counts alone, before anything is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(queries: DataFrame, pool: DataFrame, by: list[str], bucket: str, least: int, exclude: Column | None = None) -> DataFrame:
    """A row for each group of queries (`by`, such as their file) and bucket: n_queries, n_candidates, feasible, problem.

    Buckets are counted once on either side and joined as counts. A query needs at least `least` candidates in its own
    bucket, one more where it is in the pool itself (`exclude` says so of a query). Null buckets are a problem of their
    own: "no_bucket"; others are "empty_bucket" and "too_few"."""
    own = F.coalesce(exclude.cast("int"), F.lit(0)) if exclude is not None else F.lit(0)
    asked = queries.groupBy(*by, bucket).agg(F.count("*").alias("n_queries"), F.max(own).alias("\x00own"))
    have = pool.groupBy(F.col(bucket).alias("\x00bucket")).agg(F.count("*").alias("\x00n"))
    both = asked.join(have, F.col(bucket) == F.col("\x00bucket"), "left").withColumn("n_candidates", F.greatest(F.coalesce("\x00n", F.lit(0)) - F.col("\x00own"), F.lit(0)))
    problem = F.when(F.col(bucket).isNull(), "no_bucket").when(F.col("n_candidates") == 0, "empty_bucket").when(F.col("n_candidates") < least, "too_few")
    return both.select(*by, bucket, "n_queries", "n_candidates", problem.isNull().alias("feasible"), problem.alias("problem"))


def summary(plan: DataFrame, by: list[str]) -> DataFrame:
    """For each group of queries, and in all (is_total): n_queries, n_buckets, the smallest and largest number of candidates
    that a query has, and how many queries can't be answered."""
    aggs = [F.sum("n_queries").alias("n_queries"), F.count_distinct(F.struct(plan.columns[len(by)])).alias("n_buckets"), F.min("n_candidates").alias("fewest"), F.max("n_candidates").alias("most"), F.sum(F.when(F.col("feasible"), 0).otherwise(F.col("n_queries"))).alias("n_infeasible")]
    sets = [[F.col(b) for b in by], []]
    return plan.groupingSets(sets, *(F.col(b) for b in by)).agg((F.grouping_id() > 0).alias("is_total"), *aggs).select(*by, "is_total", "n_queries", "n_buckets", "fewest", "most", "n_infeasible")
