"""Constraints on tables: each is one aggregate pass, and raises with at most ten offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 10


class ConstraintError(ValueError):
    """A table breaks a constraint."""


def usable_number(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def hop_depth(value: Column) -> Column:
    """Whether a value is a positive whole number by its type: booleans, fractions and text never are."""
    whole = F.typeof(value).isin("tinyint", "smallint", "int", "bigint")
    return F.coalesce(whole & (value.try_cast("long") >= 1), F.lit(False))


def require_domain(df: DataFrame, column: str, domain: list, label: Column) -> None:
    """All values are of a parser's domain; null isn't."""
    require(df, {f"{column} in {domain}": F.col(column).isin(domain)}, label)


def require_agreement(df: DataFrame, label: Column, **columns: Column) -> None:
    """All of the given depths that a row has are equal."""
    given = F.filter(F.array(*(c.cast("int") for c in columns.values())), lambda x: x.isNotNull())
    require(df, {f"{' = '.join(columns)}": F.size(F.array_distinct(given)) <= 1}, label)


def require(df: DataFrame, conditions: dict[str, Column], label: Column) -> None:
    """All rows meet all conditions; otherwise raise with the count and first labels of each broken one."""
    bad = {n: ~F.coalesce(ok, F.lit(False)) for n, ok in conditions.items()}
    counts = df.agg(*(F.count_if(b).alias(n) for n, b in bad.items())).first()
    broken = [n for n in conditions if counts[n]]
    if broken:
        told = []
        for n in broken:
            some = [r[0] for r in df.where(bad[n]).select(label.cast("string")).limit(SHOWN).collect()]
            told.append(f"{n}: {counts[n]} rows, such as {sorted(map(str, some))}")
        raise ConstraintError("; ".join(told))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())


def require_unique(df: DataFrame, key: str) -> None:
    bad = duplicates(df, key).limit(SHOWN).collect()
    if bad:
        raise ConstraintError(f"{key} is missing or repeated: {[(r[0], r[1]) for r in bad]}")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """No key of a is in b; an empty b is refused too."""
    if not b.limit(1).count():
        raise ConstraintError("there is nothing to be disjoint from")
    common = a.join(b.select(key).distinct(), key, "left_semi").select(key).limit(SHOWN).collect()
    if common:
        raise ConstraintError(f"{key} on both sides: {sorted(str(r[0]) for r in common)}")


def require_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    one = a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    bad = one.where("l is null or r is null").limit(SHOWN).collect()
    if bad:
        raise ConstraintError(f"{key} on one side only: {[(r[0], 'left' if r['l'] else 'right') for r in bad]}")


def require_counts(df: DataFrame, by: str, expected: dict, total: int | None = None) -> None:
    """Distinct rows per group (and in all) as declared."""
    have = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if have != expected or total is not None and sum(have.values()) != total:
        raise ConstraintError(f"rows by {by}: {have}, expected {expected}")


def require_schema(df: DataFrame, columns: list[str]) -> None:
    if df.columns != columns:
        raise ConstraintError(f"columns are {df.columns}, expected {columns}")


def require_witness(a: DataFrame, b: DataFrame, key: str, witnesses: list[str]) -> None:
    """Rows paired by key agree on the witnesses, nulls included; the key itself can't be one."""
    if key in witnesses:
        raise ConstraintError("the key cannot witness itself")
    both = a.alias("a").join(b.alias("b"), key)
    differ = F.lit(False)
    for w in witnesses:
        differ = differ | ~F.col(f"a.{w}").eqNullSafe(F.col(f"b.{w}"))
    bad = both.where(differ).select(key).limit(SHOWN).collect()
    if bad:
        raise ConstraintError(f"pairs that aren't the same item: {[r[0] for r in bad]}")


def available(a: DataFrame, b: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are there, and not null in any row, on both sides."""
    out = []
    for side in (a, b):
        have = [c for c in columns if c in side.columns]
        row = side.agg(F.count("*").alias("\x00"), *(F.count(c).alias(c) for c in have)).first()
        out.append({c for c in have if row[c] == row["\x00"]})
    return [c for c in columns if c in out[0] & out[1]]
