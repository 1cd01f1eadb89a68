"""Stored ordinals: every row once, whatever the shuffle, with rows wide enough for several ranges."""

import pytest
from pyspark.sql import functions as F

from hopframe.operators import joins


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("shuffle", [4, 16, 200])
def test_a_million_wide_rows(spark, partitions, shuffle):
    partitions(shuffle)
    rows = spark.range(1_000_000, numPartitions=8).select(((F.col("id") * 7919) % 1_000_003).alias("o"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"))
    out = joins.reindex(rows, ["o"])
    got = out.agg(F.count("*"), F.count_distinct("index"), F.min("index"), F.max("index")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 0, 999_999)
    steps = out.select("index", "o").join(out.select((F.col("index") - 1).alias("index"), F.col("o").alias("later")), "index")
    assert steps.where("later <= o").count() == 0 and steps.count() == 999_999
    assert out.select(F.sum(F.length("wide"))).first()[0] == 128 * 1_000_000


def test_ties_nulls_and_clashes(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, "c")] * 50, "k int, index string").repartition(7)
    out = joins.reindex(rows, ["k"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(200)) and [r.k for r in out] == [None] * 50 + [1] * 50 + [2] * 100
    assert joins.reindex(rows.limit(0), ["k"]).collect() == []


def test_concat_at_many_partitions(spark, partitions):
    partitions(64)
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), (-F.col("id")).alias("line"), F.repeat(F.lit("x"), 300).alias("body"))
    out = joins.concat_first_wins([part(0, 30_000), part(20_000, 50_000)], "k", "line")
    assert tuple(out.agg(F.count("*"), F.count_distinct("index"), F.max("index")).first()) == (50_000, 50_000, 49_999)
    both = joins.concat_keep_all([part(0, 30_000), part(20_000, 50_000)], "line")
    assert tuple(both.agg(F.count("*"), F.count_distinct("index"), F.max("index")).first()) == (60_000, 60_000, 59_999)
