"""Running aggregates over ranges against windows, with groups that lie in many ranges."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopframe.operators import aggregate, joins, ordered


def _hot(spark, n=200_000):
    """Two thirds in one group."""
    i = F.col("id")
    return spark.range(n, numPartitions=4).select(F.when(i % 3 < 2, 7).otherwise((i % 50).cast("int")).alias("g"), ((i * 7919) % 1_000_003).alias("s")).withColumn("e", F.col("s") + (F.col("s") * 31) % 23)


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_against_a_window(spark, inclusive):
    rows = _hot(spark, 30_000).withColumn("g", F.when(F.col("g") == 3, None).otherwise(F.col("g")))
    placed = ordered.ranges(rows, "g", "s")
    assert placed.where("g = 7").select(ordered.RANGE).distinct().count() > 1
    got = ordered.running(ordered.running(placed, ["g"], ["s"], F.col("e"), "max", "m", inclusive), ["g"], ["s"], F.when(F.col("e") % 2 == 0, F.col("e")), "sum", "t", inclusive)
    w = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumn("m", F.max("e").over(w)).withColumn("t", F.sum(F.when(F.col("e") % 2 == 0, F.col("e"))).over(w))
    same = ["g", "s", "e", "m", "t"]
    assert got.count() == 30_000 and got.select(*same).exceptAll(want.select(*same)).count() == 0


def test_hot_group_of_intervals(spark):
    rows = _hot(spark)
    rows = rows.union(rows.limit(1000)).union(spark.createDataFrame([(7, None, 5), (7, None, 5), (1, None, None)], "g int, s long, e long"))
    got = joins.merge_intervals(rows, "g", "s", "e")
    w = Window.partitionBy("g").orderBy("s", "e")
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    sound = rows.where("s is not null").withColumn("b", F.coalesce((F.col("s") > seen).cast("int"), F.lit(1))).withColumn("i", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = sound.groupBy("g", "i").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("i")
    assert got.where("s is not null").exceptAll(want.select("g", "s", "e", "n")).count() == 0 and got.where("s is not null").count() == want.count()
    assert sorted(map(tuple, got.where("s is null").collect()), key=str) == [(1, None, None, 1), (7, None, 5, 2)]


def test_query_on_equal_and_undated_orders(spark, tmp_path):
    """Equal orders are one interval however ties fall; those without a date, or without a customer, as the SQL has them."""
    import duckdb

    from hopframe import queries

    rows = [(i, c, d) for i, (c, d) in enumerate([(1, "2000-01-01"), (1, "2000-01-01"), (1, "2000-02-10"), (1, "2001-01-01"), (1, None), (1, None), (2, None), (None, "2000-01-01"), (None, "2000-01-31"), (None, None)])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "to_timestamp_ntz(d) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, queries.interval_merge(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.SQL["interval_merge"]).fetchall(), key=str)
    assert got.count((1, None, None, 1)) == 2 and (1, "2000-01-01", "2000-04-10", 3) in got


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.standard_normal(5000), "b": np.repeat(2.5, 4000), "c": np.array([1.0, 4.0]), None: np.array([9.0])}
    rows = [(g, float(v), float(i)) for g, vs in data.items() for i, v in enumerate(vs)] + [("a", None, None), ("a", float("nan"), 1e3), ("d", None, None), ("b", float("inf"), None)]
    df = spark.createDataFrame(rows, "g string, v double, statistic_ double").repartition(6)
    got = {(r.g, r.statistic): r for r in ordered.quantiles(df, ["g"], ["v", "statistic_"], {"lo": 0.0, "q": 0.37, "mid": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {(g, s) for g in data for s in ("v", "statistic_")}
    for g, vs in data.items():
        r = got[g, "v"]
        assert (r.n, r.mean, r.lo, r.q, r.mid, r.hi) == pytest.approx((len(vs), vs.mean(), vs.min(), np.quantile(vs, 0.37), np.median(vs), vs.max()))
    assert got["a", "statistic_"].n == 5001


def test_cost_summary(spark):
    assert tuple(aggregate.cost_summary(spark.createDataFrame([(1.0,), (4.0,), (None,)], "v double"), "v").first()) == (2, 2.5, 2.5, 5.0)
    assert tuple(aggregate.cost_summary(spark.createDataFrame([], "v double"), "v").first()) == (0, None, None, None)
    plan = ordered.quantiles(spark.range(10).select(F.col("id").cast("double").alias("v")), [], ["v"], {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan and "collect" not in plan
