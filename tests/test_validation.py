"""Result files of both versions, and validation that reports everything it finds."""

import json

import pytest
from pyspark.sql import functions as F

from hopframe.operators import validation
from hopframe.sources import result_files

WEIGHTS = {"composite_score_weights": {"step_f1": 0.4}, "composite_step_count_error_scale": 3.0}


@pytest.fixture
def folder(tmp_path):
    sound = {"schema": "v2", **WEIGHTS, "items": [{"item_id": "a", "m": 1, "k": 0.5}, {"item_id": "b", "m": 2.25, "k": True}, {"item_id": "a", "m": 3, "k": 1}, {"m": 1, "k": 1}, 7, {"item_id": "c", "m": None, "k": "1"}, {"item_id": "d", "k": 1}, {"item_id": "e", "m": 1e3, "k": -1}]}
    files = {"sound.json": sound, "old.json": [{"question": " Who  Is it?", "m": 1, "k": 2}, {"question": "who is it?", "m": 1, "k": 2}, {"question": "", "m": 1, "k": 2}, {"question": "Why?", "m": 4, "k": 5, "item_id": "own"}], "bare.json": {"schema": "v2", "items": []}, "none.json": {"schema": "v2", **WEIGHTS}, "empty.json": []}
    for name, what in files.items():
        (tmp_path / name).write_text(json.dumps(what, indent=1))
    (tmp_path / "broken.json").write_text('{"schema": "v2", "items": [')
    return str(tmp_path)


def _plain(results):
    name = lambda f: f.rsplit("/", 1)[1]
    rows = {(name(r.file), r["row"], r.form, r.item_id, r.m, r.k) for r in results.rows.collect()}
    problems = {(name(r.file), r["row"], r.problem, r.detail) for r in results.problems.collect()}
    return rows, problems, {name(r.file): (r.form, r.n_rows, r.stated, r.scale) for r in results.headers.collect()}


VERSIONED = {
    ("sound.json", 1, "not_a_number", "k"), ("sound.json", 2, "repeated_id", "a of row 0"), ("sound.json", 3, "no_id", "item_id"), ("sound.json", 4, "not_an_object", "BIGINT"),
    ("sound.json", 5, "not_a_number", "m"), ("sound.json", 5, "not_a_number", "k"), ("sound.json", 6, "missing", "m"), ("bare.json", None, "no_weights", None), ("none.json", None, "no_items", None), ("broken.json", None, "not_json", None),
}


def test_versions(spark, folder):
    rows, problems, headers = _plain(result_files.read(spark, folder, ["m", "k"]))
    assert rows == {("sound.json", 7, "versioned", "e", 1000.0, -1.0)}
    assert problems == VERSIONED | {("old.json", None, "legacy_without_alignment", None), ("empty.json", None, "legacy_without_alignment", None)}
    assert headers["sound.json"] == ("versioned", 8, True, 3.0) and headers["broken.json"][0] is None


def test_legacy_by_question_and_position(spark, folder):
    rows, problems, headers = _plain(result_files.read(spark, folder, ["m", "k"], "question", {"step_f1": 1.0}, 2.0))
    assert {r for r in rows if r[2] == "legacy"} == {("old.json", 3, "legacy", "why?", 4.0, 5.0)}
    more = problems - VERSIONED
    assert {(f, r, p) for f, r, p, _ in more} == {("old.json", 1, "repeated_id"), ("old.json", 2, "no_question")}
    assert not any("who" in str(d) for *_, d in more) and headers["old.json"] == ("legacy", 4, False, 2.0)
    rows, problems, _ = _plain(result_files.read(spark, folder, ["m", "k"], "position"))
    assert sorted(r[3] for r in rows if r[2] == "legacy") == [f"row_0000000{i}" for i in range(4)] and problems == VERSIONED
    with pytest.raises(ValueError):
        result_files.read(spark, folder, ["m"], "name")


def test_all_problems_of_gold_at_once(spark):
    rows = [("a", ["x", "y"], 2), ("b", ["x"], 2), ("c", [], None), ("d", ["x", "y", "z"], None), ("d", ["x"], 1), (None, ["x"], 1), ("e", ["x", "y"], 0), ("f", None, 1), ("g", ["x"], 1)]
    df = spark.createDataFrame(rows, "id string, steps array<string>, hops int").repartition(3)
    pinned = spark.createDataFrame([("a",), ("d",), ("zz",), ("a",)], "id string")
    report = validation.gold(df, "id", "steps", "hops", {2: 3, 1: 9}, pinned)
    told = {(r["key"], r.problem, r.detail) for r in report.problems.collect()}
    assert {t for t in told if t[1] != "declared_count"} == {("b", "denominators_differ", "2 hops, 1 steps"), ("c", "no_steps", None), ("f", "no_steps", None), ("d", "repeated_key", "2"), (None, "no_key", None), ("zz", "pinned_but_missing", None)}
    assert {t[2] for t in told if t[1] == "declared_count"} == {"gold_hops=0 has 1 declared 0", "gold_hops=1 has 3 declared 9", "gold_hops=3 has 1 declared 0"}
    assert [tuple(r) for r in report.rows.select("id", "gold_hops").collect()] == [("a", 2)]
    assert report.counts == {"rows": 9, "no_steps": 2, "denominators_differ": 1}
    assert {r.problem: r.n for r in report.summary().collect()}["no_steps"] == 2


def test_nothing_to_validate(spark):
    report = validation.validate(spark.createDataFrame([], "id string, v int"), "id", {"v": F.col("v") > 0}, by="v", expected={})
    assert report.rows.collect() == [] and report.problems.collect() == [] and report.counts == {"rows": 0, "v": 0}
