"""The resampling kernel against plain sums of drawn rows, and comparisons of several arms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.operators import stats
from hopframe.plans import evaluation


def test_draws_are_poisson():
    w = stats.draws(np.arange(3000), 0, 400, 42)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:60])[np.triu_indices(60, 1)]).max() < 0.1 and np.abs(np.corrcoef(w[:, :60].T)[np.triu_indices(60, 1)]).max() < 0.25
    for n, p in enumerate(stats.STEPS[:4]):
        assert abs((w <= n).mean() - p) < 0.003


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_of_drawn_rows(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(x) if k % 4 else None, float(y)) for k, x, y in zip(rng.permutation(900), rng.random(900), rng.random(900))]
    df = spark.createDataFrame(rows, "k long, resample double, y double").repartition(parts)
    got = {r["resample"]: (r.x, r.n, r.y) for r in stats.resampled(df, "k", {"x": F.col("resample"), "n": F.col("resample").isNotNull().cast("int"), "y": F.col("y")}, 40, 7).collect()}
    w = stats.draws(np.array([r[0] for r in rows]), 0, 40, 7)
    x, n, y = (np.array(v) for v in ([r[1] or 0.0 for r in rows], [r[1] is not None for r in rows], [r[2] for r in rows]))
    assert sorted(got) == list(range(-1, 40))
    assert got[-1] == pytest.approx((x.sum(), n.sum(), y.sum()))
    for i in range(40):
        assert got[i] == pytest.approx((w[i] @ x, w[i] @ n, w[i] @ y))


def test_ten_thousand_resamples_of_ten_columns(spark):
    df = spark.range(2000).select("id", *((F.col("id") * (i + 3) % 17).alias(f"c{i}") for i in range(10)))
    sums = stats.resampled(df, "id", {f"c{i}": F.col(f"c{i}") for i in range(10)}, 10_000)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and sums.count() == 10_001


def test_no_rows_and_text_keys(spark):
    empty = spark.createDataFrame([], "k string, d double")
    assert tuple(stats.bootstrap(empty, "k", F.col("d"), 10).first()) == (0, None, None, None, False) or stats.bootstrap(empty, "k", F.col("d"), 10).first().n == 0
    some = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "k string, d double")
    assert stats.bootstrap(some, "k", F.col("d"), 50).first()[:2] == (2, 2.0)


def test_arms_against_a_baseline(spark):
    n = 400
    base = spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("exact_match"), F.lit(0.5).alias("step_f1"), F.lit(0.5).alias("ordered_accuracy"), F.lit(3.0).alias("ged"), F.lit(1).alias("references_valid"), F.lit(2).alias("references_total"), F.lit(-3).alias("count_error"))
    better = base.withColumns({"exact_match": F.lit(1.0), "step_f1": F.lit(1.0), "ordered_accuracy": F.lit(1.0), "ged": F.lit(1.0), "references_valid": F.lit(2), "count_error": F.lit(0)})
    mixed = base.withColumn("ged", F.when(F.col("id") > 3, F.lit(4.0))).drop("references_valid")
    out = evaluation.compare_arms({"b": base, "good": better, "mixed": mixed}, "b", "id", ["exact_match", "step_f1", "ged"], 200)
    boot = {(r.arm, r.statistic): r for r in out["bootstrap"].collect()}
    assert set(boot) == {("good", s) for s in ("exact_match", "step_f1", "ged", "reference_validity_micro", "composite")} | {("mixed", s) for s in ("exact_match", "step_f1", "ged")}
    assert boot["good", "composite"].mean_diff == pytest.approx(1.0 - (0.4 * 0.5 + 0.3 * 0.5 + 0.2 * 0.5)) and boot["good", "composite"].favours == "a"
    assert boot["good", "reference_validity_micro"].mean_diff == pytest.approx(0.5)
    assert (boot["good", "ged"].favours, boot["mixed", "ged"].favours, boot["mixed", "step_f1"].favours) == ("a", "b", None)
    assert boot["mixed", "ged"].mean_diff == pytest.approx(1.0) and boot["good", "exact_match"].ci_low < 0.5 < boot["good", "exact_match"].ci_high
    counts = {(r.arm, r.statistic): (r.only_a, r.only_b, r.both, r.neither) for r in out["mcnemar"].collect()}
    assert counts["good", "exact_match"] == (200, 0, 200, 0) and counts["mixed", "exact_match"] == (0, 0, 200, 200)
    assert {(r.arm, r.statistic): r.n for r in out["t_test"].collect()}["mixed", "ged"] == n - 4
