"""Paired comparisons: McNemar, t-test, bootstrap. Aggregates run distributed; p-values are of one row per statistic."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LOWER_IS_BETTER = {"ged"}


def binomial_two_sided(b: int, c: int) -> float:
    """Exact p of the discordant counts; 1 without any."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n < 1000:
        term = total = math.exp(-n * math.log(2))
        for i in range(1, k + 1):
            term *= (n - i + 1) / i
            total += term
    else:  # P(X <= k) of a fair coin as a beta integral: no list of k terms
        total = 1.0 if 2 * k >= n else incomplete_beta(n - k, k + 1, 0.5)
    return min(1.0, 2.0 * total)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1.0)


def t_two_sided(t: float, dof: int) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


p_mcnemar = F.udf(lambda b, c: None if b is None or c is None else binomial_two_sided(int(b), int(c)), DoubleType())
p_paired_t = F.udf(lambda t, dof: None if t is None or dof is None else t_two_sided(float(t), int(dof)), DoubleType())


def mcnemar(df: DataFrame, a: Column, b: Column, alpha: float = 0.05, by: str | None = None) -> DataFrame:
    """One row (by: one per group): only_a, only_b, both, neither, p_value, min_p (the least that these many could give), significant."""
    won = lambda c: F.coalesce(c >= 1.0, F.lit(False))
    counts = df.groupBy(*([by] if by else [])).agg(
        F.count_if(won(a) & ~won(b)).alias("only_a"), F.count_if(~won(a) & won(b)).alias("only_b"), F.count_if(won(a) & won(b)).alias("both"), F.count_if(~won(a) & ~won(b)).alias("neither")
    )
    out = counts.withColumn("p_value", p_mcnemar("only_a", "only_b")).withColumn("min_p", p_mcnemar(F.lit(0), F.col("only_a") + F.col("only_b")))
    return out.withColumn("significant", F.col("p_value") < alpha).withColumn("underpowered", F.col("min_p") >= alpha)


def paired_t(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row per statistic: n, mean_diff, sd, t, dof, p_value; t and p null for n < 2, no variance or values that aren't finite."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), (a.cast("double") - b.cast("double")).alias("d")) for k, (a, b) in pairs.items()))).alias("s")).select("s.*")
    agg = long.groupBy("statistic").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    sound = (F.col("n") > 1) & (F.col("sd") > 0) & ~F.isnan("sd") & (F.col("sd") < float("inf"))
    out = agg.withColumn("t", F.when(sound, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))).withColumn("dof", F.when(sound, F.col("n") - 1))
    return out.withColumn("p_value", p_paired_t("t", "dof"))


PRIME = (1 << 31) - 1
# P(X <= n) of a Poisson variable of mean 1: as many of these as lie below a uniform number is a draw of it.
STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(10)]


def draws(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """How often each key's row counts in resamples first .. last - 1: whole-number arithmetic below 2^63 alone, so that any
    engine draws the same."""
    x, r = keys[None, :] % PRIME, np.arange(first, last, dtype=np.int64)[:, None]
    y = (x * 48271 + r * 69621 + seed) % PRIME
    y = (y * y + 7 * y + r) % PRIME
    y = (y * y + 13 * y + x) % PRIME
    return np.searchsorted(STEPS, (y + 0.5) / PRIME, "left").astype(np.float64)


def resampled(df: DataFrame, key: str, sums: dict[str, Column], resamples: int, seed: int = 42) -> DataFrame:
    """Sums of many columns over Poisson resamples, in one pass: `resample` from 0, and -1 for the rows as they are; a column
    for each of `sums`, to which nulls add nothing.

    In each resample a row counts as often as a Poisson(1) draw from its key says, so no row is fetched by its place, all
    columns share the draws, and the result doesn't depend on how rows are stored. A task multiplies the matrix of draws
    by that of its rows' values and passes on its sums alone, resamples x columns, whatever the number of its rows; the
    multinomial scheme differs by the size of a resample alone. Keys are whole numbers, or anything, which is hashed."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.pmod(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(PRIME))
    names = [f"c{i}" for i in range(len(sums))]
    rows = df.select(F.coalesce(number, F.lit(0)).alias("k"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, sums.values())))
    most = max(1, (1 << 21) // max(1, resamples))

    def add(batches):
        total = np.zeros((resamples + 1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.column_stack([c.to_numpy() for c in part.columns[1:]])
                total[0] += x.sum(axis=0)
                total[1:] += draws(part.column(0).to_numpy(), 0, resamples, seed) @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, resamples, dtype=np.int64)), *map(pa.array, total.T.copy())], names=["resample", *names])

    parts = rows.mapInArrow(add, ", ".join(["resample long", *(f"{n} double" for n in names)]))
    return parts.groupBy("resample").agg(*(F.sum(n).alias(name) for n, name in zip(names, sums)))


def intervals(sums: DataFrame, statistics: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """statistic, value, ci_low, ci_high, significant of expressions over what `resampled` gave; resamples in which an
    expression is null are left out."""
    each = sums.select("resample", F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), c.cast("double").alias("v")) for k, c in statistics.items()))).alias("s")).select("resample", "s.*")
    drawn = F.when((F.col("resample") >= 0) & ~F.isnan("v"), F.col("v"))
    ends = each.groupBy("statistic").agg(F.max(F.when(F.col("resample") < 0, F.col("v"))).alias("value"), F.percentile(drawn, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"))
    low, high = F.get("ci", F.lit(0)), F.get("ci", F.lit(1))
    return ends.select("statistic", "value", low.alias("ci_low"), high.alias("ci_high"), F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("significant"))


def bootstrap(df: DataFrame, key: str, diff: Column, resamples: int, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """n, mean_diff, ci_low, ci_high, significant of a paired percentile bootstrap of one difference; nulls are left out."""
    d = diff.cast("double")
    sums = resampled(df, key, {"d": d, "n": d.isNotNull().cast("int")}, resamples, seed)
    out = intervals(sums, {"mean": F.try_divide("d", "n"), "rows": F.when(F.col("resample") < 0, F.col("n"))}, alpha)
    pick = lambda name, c: F.max(F.when(F.col("statistic") == name, F.col(c))).alias({"value": "mean_diff" if name == "mean" else "n"}.get(c, c))
    one = out.agg(pick("rows", "value"), *(pick("mean", c) for c in ("value", "ci_low", "ci_high", "significant")))
    return one.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def mcnemar_many(df: DataFrame, pairs: dict[str, tuple[Column, Column]], alpha: float = 0.05) -> DataFrame:
    """`mcnemar` of several pairs, all counted in one pass; a row per statistic."""
    won = lambda c: F.coalesce(c.cast("double") >= 1.0, F.lit(False))
    kinds = {"only_a": (True, False), "only_b": (False, True), "both": (True, True), "neither": (False, False)}
    counts = df.agg(*(F.count_if((won(a) == x) & (won(b) == y)).alias(f"{i}_{k}") for i, (a, b) in enumerate(pairs.values()) for k, (x, y) in kinds.items()))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("statistic"), *(F.col(f"{i}_{k}").alias(k) for k in kinds)) for i, name in enumerate(pairs)))).alias("s")).select("s.*")
    out = rows.withColumn("p_value", p_mcnemar("only_a", "only_b")).withColumn("min_p", p_mcnemar(F.lit(0), F.col("only_a") + F.col("only_b")))
    return out.withColumn("significant", F.col("p_value") < alpha).withColumn("underpowered", F.col("min_p") >= alpha)


def favours(name: str, difference: Column, significant: Column) -> Column:
    """"a" or "b", null unless significant and not 0."""
    up = (difference > 0) != F.lit(name in LOWER_IS_BETTER)
    return F.when(significant & (difference != 0), F.when(up, "a").otherwise("b"))
