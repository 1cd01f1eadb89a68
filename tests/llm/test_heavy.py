"""Heavy hitters against counting, and the summaries' promises on hostile groups."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopframe.llm import heavy

SCHEMA = "stream string, grp long, item string, weight long, deal int"


def _entries(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _brute(rows, share):
    weights, entries = Counter(), Counter()
    for s, g, i, w, _ in rows:
        if None not in (s, g, i, w) and w >= 0:
            weights[s, g, i] += w
            entries[s, g] += 1
    totals = Counter()
    for (s, g, _), w in weights.items():
        totals[s, g] += w
    return {(s, g, i): (entries[s, g], totals[s, g], w) for (s, g, i), w in weights.items() if share * w > totals[s, g]}


def _hold(spark, rows, share, counters=heavy.COUNTERS):
    got = heavy.heavy_hitters(_entries(spark, rows), share, counters).collect()
    assert {(r.stream, r.grp, r.item): (r.n_entries, r.total, r.w) for r in got} == _brute(rows, share)
    assert len(got) == len({(r.stream, r.grp, r.item) for r in got})
    for r in got:
        assert r.low <= r.w <= r.high and r.low <= r.estimate <= r.high
        assert (counters + 1) * (r.high - r.low) <= r.total
    return got


def test_many_keys_few_counters(spark, monkeypatch):
    """Shards of few sums and two rounds of merging: bounds must hold where much is subtracted."""
    monkeypatch.setattr(heavy, "SLICE", 40)
    monkeypatch.setattr(heavy, "FAN", 3)
    rows = [("a", g, f"k{(i * i) % 301}", 1 + i % 7, i % 4) for g in range(3) for i in range(900)]
    rows += [("a", 1, "hot", 60, i % 4) for i in range(40)] + [("b", 1, f"k{i}", 1, i % 4) for i in range(600)]
    got = _hold(spark, rows, 8, counters=8)
    assert any(r.high > r.low for r in got)


def test_ties_nulls_repeats_and_bounds(spark):
    rows = [("t", 1, f"k{i}", 5, 0) for i in range(50)] * 2  # exactly a fiftieth each: not more, so none
    rows += [("n", None, "x", 1, 0), ("n", 1, None, 1, 0), ("n", 1, "x", None, 0), (None, 1, "x", 1, 0), ("n", 1, "x", -5, 0), ("n", 1, "y", 0, 1), ("n", 1, "x", 3, 2)]
    rows += [("z", 9, "zero", 0, 0)] + [("l", -4, "é" * 5000, 2, i % 4) for i in range(9)]
    got = _hold(spark, rows, 50)
    assert {(r.stream, r.grp) for r in got} == {("n", 1), ("l", -4)}
    assert [r.n_entries for r in got if r.stream == "n"] == [2]


def test_empty_and_refusal(spark):
    assert heavy.heavy_hitters(_entries(spark, []), 50).collect() == []
    with pytest.raises(ValueError):
        heavy.heavy_hitters(_entries(spark, []), 50, 49)


def test_layout_does_not_matter(spark):
    rows = [("a", 1, f"k{i % 400 if i % 3 else 7}", 1 + i % 5, i % 4) for i in range(4000)]
    one = {tuple(r) for r in heavy.heavy_hitters(_entries(spark, rows, 1), 50).collect()}
    assert one == {tuple(r) for r in heavy.heavy_hitters(_entries(spark, rows[::-1], 7), 50).collect()} and one


TEXTS = {
    '{"device": {"os": "ios"}, "tags": ["a", null, "b", "a"], "items": [{"sku": 5}, {"qty": 1}, {"sku": null}]}': ["os=ios", "sku=5", "tag=a", "tag=a", "tag=b"],
    '{"tags": [], "items": null, "device": {"os": null}}': [],
    '{"tags": "a", "items": {"sku": 1}, "device": "x"}': [],
    ' {"device": {"os": "tv"}} ': ["os=tv"],
    '{"device": {"os": "ios"}': [],
    '{"device": {"os": "ios"}} x': [],
    '{"device": {"os": "ios"}},{"device": {"os": "tv"}}': [],
    '{"device": {"os": "ios"}}],[{"device": {"os": "tv"}}': [],
    '{"device": {"os": "ios"}},"w":{"a":1}': [],
    "{'device': {'os': 'ios'}}": [],
    '{"device": {"os": "ios"},}': [],
    "": [],
    "null": [],
    "[1]": [],
}


def test_keys_of_json(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id long, props string")
    got = heavy.json_keys(rows, "props", "id").groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")).collect()
    assert {r.id: r["keys"] for r in got if r["keys"]} == {i: k for i, k in enumerate(TEXTS.values()) if k}
    for text, keys in TEXTS.items():
        if keys:
            json.loads(text)


def test_times_are_read_as_utc(spark):
    times = ["2024-03-31 00:59:59", "2024-03-31 06:00:00", "1969-12-31 23:59:59", "1970-01-01 05:59:59"]
    rows = spark.createDataFrame([(t,) for t in times], "ts string").select(F.expr("cast(ts as timestamp_ntz)").alias("ts"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in rows.select(heavy._quarter_day(rows, "ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [19813 * 4, 19813 * 4 + 1, -1, 0]
