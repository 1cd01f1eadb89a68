"""Running sums and maxima along an order, and what follows from them, for groups of any size.

A window over a group sorts the whole group in one task. Here rows are dealt into ranges of (group, order) and stored
once; a range's rows are run through by themselves, and what the ranges before it give to a group is run through as
one row for each range. So a group that holds all rows is as many tasks as there are ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime

RANGE = "\x00p"


def ranges(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of the order, stored, with the number of each row's range."""
    dealt = df.repartitionByRange(runtime.tasks(df), *order).withColumn(RANGE, F.spark_partition_id())
    return runtime.stored(dealt, "ranges")


def running(placed: DataFrame, by: list[str], order: list[str], value: Column, how: str, name: str, inclusive: bool = False) -> DataFrame:
    """Rows of `ranges` (whose order begins with `by`) with the sum or maximum ("sum", "max") of value over the rows of their
    group before them, or up to them; null where there are none. Rows that are equal in `order` are in one range, in any
    order: count them first where there may be many."""
    add, meet = (F.sum, lambda a, b: F.coalesce(a + b, a, b)) if how == "sum" else (F.max, lambda a, b: F.greatest(a, b))
    rows = placed.withColumn("\x00v", value)
    inside = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = rows.groupBy(RANGE, *by).agg(add("\x00v").alias("\x00w"))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = whole.withColumn("\x00c", add("\x00w").over(earlier)).select(F.col(RANGE).alias("\x00q"), *(F.col(b).alias(f"\x00by {b}") for b in by), "\x00c")
    same = F.col(RANGE) == F.col("\x00q")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"\x00by {b}"))
    out = rows.withColumn("\x00i", add("\x00v").over(inside)).join(carried, same)
    return out.withColumn(name, meet(F.col("\x00i"), F.col("\x00c"))).drop("\x00v", "\x00i", "\x00q", "\x00c", *(f"\x00by {b}" for b in by))


def merge_intervals(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of each group as one: (by, start, end, n). A new one begins after the largest end
    so far. Intervals without a start are merged with their equals alone."""
    counted = df.groupBy(by, start, end).agg(F.count("*").alias("\x00n"))
    seen = running(ranges(counted, by, start, end), [by], [start, end], F.when(F.col(start).isNotNull(), F.col(end)), "max", "\x00seen")
    marked = runtime.stored(seen.withColumn("\x00b", F.coalesce(F.col(start) > F.col("\x00seen"), F.lit(True)).cast("int")), "intervals")
    islands = running(marked, [by], [start, end], F.col("\x00b"), "sum", "\x00island", inclusive=True)
    return islands.groupBy(by, "\x00island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("\x00n").alias("n")).drop("\x00island")


def quantiles(df: DataFrame, by: list[str], values: list[str], shares: dict[str, float]) -> DataFrame:
    """by, statistic (one of values), n, mean, total and a column for each share (its name to a number from 0 to 1): exact, as
    sorted values give them, with linear interpolation. Values that are null, NaN or infinite are left out; a group
    without any has no row.

    Equal values are counted before anything is sorted, so neither a frequent value nor a large group is one task's."""
    sound = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("statistic"), F.col(v).cast("double").alias("v")) for v in values))).alias("s")).select(*by, "s.*").where(sound)
    keys = [*by, "statistic"]
    counted = long.groupBy(*keys, "v").agg(F.count("*").alias("k"))
    placed = running(ranges(counted, *keys, "v"), keys, ["v"], F.col("k"), "sum", "before").withColumn("before", F.coalesce("before", F.lit(0)))
    whole = counted.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("v")).alias("total"))
    whole = whole.select(*(F.col(k).alias(f"\x00{k}") for k in keys), "n", "total")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"\x00{k}"))
    rows = placed.join(whole, same)
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in shares.items()}
    there = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("k"))
    ends = [F.max(F.when(there(edge(at[name])), F.col("v"))).alias(f"\x00{kind}{name}") for name in shares for kind, edge in (("l", F.floor), ("h", F.ceil))]
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("total").alias("total"), *ends)
    between = lambda name: F.col(f"\x00l{name}") + (F.col(f"\x00h{name}") - F.col(f"\x00l{name}")) * (at[name] - F.floor(at[name]))
    return out.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), "total", *(between(name).alias(name) for name in shares))
