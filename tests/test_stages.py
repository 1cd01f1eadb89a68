"""Stages by content, and feasibility from counts."""

import pytest
from pyspark.sql import functions as F

from hopframe.plans import feasibility, stages


def _graph(spark, root, source, seed=1, version=1):
    runs = []

    def sample(rows, seed):
        runs.append(("sample", seed))
        return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0)

    def count(rows):
        runs.append(("count",))
        return rows.agg(F.count("*").alias("n"))

    graph = stages.Graph(spark, root, {"pool": source})
    graph.add("sampled", sample, ["pool"], seed=seed).add("counted", count, ["sampled"], version=version).add("whole", count, ["pool"])
    return graph, runs


def test_stages_are_made_once(spark, tmp_path):
    source, root = str(tmp_path / "pool"), str(tmp_path / "runs")
    spark.range(100).write.parquet(source)
    graph, runs = _graph(spark, root, source)
    assert [(n, d) for n, _, d in graph.plan()] == [("sampled", False), ("counted", False), ("whole", False)] and runs == []
    first = graph.table("counted").first().n
    assert graph.table("whole").first().n == 100 and runs == [("sample", 1), ("count",), ("count",)] and graph.reused == []
    again, runs = _graph(spark, root, source)
    assert again.table("counted").first().n == first and again.table("whole").first().n == 100
    assert runs == [] and again.made == [] and again.reused == ["counted", "whole"]
    other, runs = _graph(spark, root, source, seed=2)  # what follows the seed is made anew, the rest isn't
    other.table("counted"), other.table("whole")
    assert other.made == ["sampled", "counted"] and other.reused == ["whole"]
    newer, runs = _graph(spark, root, source, version=2)
    newer.table("counted")
    assert newer.made == ["counted"] and newer.reused == ["sampled"]
    spark.range(60).write.mode("overwrite").parquet(source)
    changed, runs = _graph(spark, root, source)
    assert changed.table("whole").first().n == 60


def test_refusals(spark, tmp_path):
    source, root = str(tmp_path / "pool"), str(tmp_path / "runs")
    spark.range(5).write.parquet(source)
    graph, _ = _graph(spark, root, source)
    graph.table("whole")
    graph._text(f"{graph.folder('whole')}/_identity.json", '{"stage": "else"}')
    with pytest.raises(stages.StageError):
        graph.table("whole")
    with pytest.raises(stages.StageError):
        graph.add("x", lambda a: a, ["nothing"])
    with pytest.raises(stages.StageError):
        stages.Graph(spark, root, {"none": str(tmp_path / "none")}).add("x", lambda a: a, ["none"]).table("x")


def test_a_broken_stage_leaves_nothing(spark, tmp_path):
    source, root = str(tmp_path / "pool"), str(tmp_path / "runs")
    spark.range(5).write.parquet(source)
    graph = stages.Graph(spark, root, {"pool": source}).add("bad", lambda rows: rows.select(F.raise_error(F.lit("no")).alias("x")), ["pool"])
    with pytest.raises(Exception, match="no"):
        graph.table("bad")
    assert not graph.done("bad")


def test_feasibility(spark):
    pool = spark.createDataFrame([(2,)] * 5 + [(3,)] * 2 + [(None,)] * 4, "hop int")
    queries = spark.createDataFrame([("f", 2, False), ("f", 3, True), ("f", 3, False), ("g", 4, False), ("g", None, False), ("g", 2, True)], "file string, hop int, inside boolean")
    plan = feasibility.candidates(queries, pool, ["file"], "hop", 2, F.col("inside"))
    got = {(r.file, r.hop): (r.n_queries, r.n_candidates, r.feasible, r.problem) for r in plan.collect()}
    assert got == {("f", 2): (1, 5, True, None), ("f", 3): (2, 1, False, "too_few"), ("g", 4): (1, 0, False, "empty_bucket"), ("g", None): (1, 0, False, "no_bucket"), ("g", 2): (1, 4, True, None)}
    total = {(r.file, r.is_total): (r.n_queries, r.fewest, r.most, r.n_infeasible) for r in feasibility.summary(plan, ["file"]).collect()}
    assert total == {("f", False): (3, 1, 5, 2), ("g", False): (3, 0, 4, 2), (None, True): (6, 0, 5, 4)}
