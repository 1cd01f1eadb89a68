import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.llm import common, shards

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, **kw):
    return shards.ShardedTable(spark, common.new_dir(spark, "table"), SCHEMA, **kw)


def test_append_compact_read(spark):
    t = table(spark, fan_in=3)
    assert t.version() == 0 and t.read().count() == 0 and t.compact() == 0
    for i in range(7):
        t.append(spark.range(i * 10, i * 10 + 10, 1, 2).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("v"), F.lit(1).alias("extra")))
    before = t.manifest().count()
    t.append(spark.createDataFrame([], "k long"))
    v = t.version()
    assert before == 14 and t.compact() > v
    assert t.manifest().count() < 3 and sorted(r.k for r in t.read().collect()) == list(range(70))
    assert t.read(v).count() == 70  # older versions still read
    assert t.manifest().agg(F.sum("n_rows")).first()[0] == 70
    assert t.vacuum() == 15 and t.read().count() == 70  # the merged shards, and the file of the empty batch


def test_full_files_stay(spark):
    t = table(spark, target_bytes=1, fan_in=2)
    for _ in range(3):
        t.append(spark.range(5).select(F.col("id").alias("k")))
    v = t.version()
    assert t.compact() == v


def test_one_of_two_writers_commits(spark):
    t = table(spark)
    t.append(spark.range(3).select(F.col("id").alias("k")))
    with pytest.raises(shards.Conflict):
        t._commit(t.manifest(), 1)
    assert t.version() == 1 and t.read().count() == 3


def test_native_plan(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = shards.op4_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan and "Python" not in plan and "Arrow" not in plan


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_pipeline_stages(spark, tmp_path):
    import random

    import corpus_pipeline as p

    rng = random.Random(6)
    en = "the of and to in that was his with for as had you not be her on at by which".split()
    words = en + [f"{a}{b}ing" for a in ("wal", "tal", "run", "sto") for b in "klmnprst"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(n))
    passage, item = say(70), say(40)
    rows = [(i, say(120), "en", "s", 1) for i in range(20)]
    near = rows[0][1].split()
    near[50] = "changed"
    rows += [(20, rows[0][1], "en", "s", 1), (21, " ".join(near), "en", "s", 1), (22, say(40) + " " + passage + " " + say(40), "en", "s", 1), (23, say(45) + " " + passage + " " + say(60), "en", "s", 1), (24, say(30) + " " + item + " " + say(50), "en", "s", 1), (25, None, None, None, None), (26, "", "en", "s", 0), (27, "12345 !!", "en", "s", 8), (None, say(100), "en", None, None)]
    df = docs(spark, rows).withColumn("row_id", F.lit("clash"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = lambda f, d: common.stage(f(spark, d, str(tmp_path)), "t")
    one = step(p.identify_language, common.stage(df, "in"))
    assert {r.doc_id for r in one.collect()} == {*range(25), None} and one.columns == p.COLUMNS
    two = step(p.drop_near_duplicates, one)
    assert {r.doc_id for r in two.collect()} == ({*range(25), None} - {20, 21})
    three = step(p.cut_repeats, two)
    left = {r.doc_id: r for r in three.collect()}
    assert set(left) == set(r.doc_id for r in two.collect())
    assert passage[5:-5] not in left[22].text and passage[5:-5] not in left[23].text and left[1].text == rows[1][1]
    assert left[22].n_chars == len(left[22].text)
    four = step(p.drop_leaks, three)
    assert {r.doc_id for r in four.collect()} == set(left) - {24}
    five = step(p.pack, four)
    assert {r.doc_id for r in five.collect()} == set(left) - {24}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
