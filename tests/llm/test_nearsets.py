"""Near sets of vectors against all pairs."""

import numpy as np
import pytest

from hopframe.llm import nearsets

SCHEMA = "vec_id long, embedding array<double>, key long, component_id string"


def brute(rows, cosine=0.95):
    sound = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(np.array(v, float)).max()
            sound[i] = x / np.linalg.norm(x)
    label, links = list(range(len(rows))), [0] * len(rows)
    near = {i: [j for j in sound if j != i and len(sound[j]) == len(sound[i]) and sound[i] @ sound[j] >= cosine] for i in sound}
    for i in sound:
        links[i] = len(near[i])
    for start in range(len(rows)):
        stack = [start]
        while stack:
            i = stack.pop()
            for j in near.get(i, ()):
                if label[j] > label[start]:
                    label[j] = label[start]
                    stack.append(j)
    ids = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            ids[label[i]] = min(v, ids.get(label[i], v))
    out = []
    for i, (v, _) in enumerate(rows):
        c = ids.get(label[i])
        out.append((v, links[i], c, v is not None and v == c))
    return sorted(out, key=str)


def _hold(spark, rows, parts=3):
    rows = [(i, None if v is None else list(v)) for i, v in rows]
    docs = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "own") for i, v in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in nearsets.near_sets(docs, 0.95).collect()), key=str)
    want = brute(rows)
    assert got == want
    return got


def test_odd_vectors(spark):
    e = np.eye(4)
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1, None, 0, 0]), (5, [float("nan"), 1, 0, 0]), (6, [float("inf"), 1, 0, 0])]
    rows += [(10, e[0]), (11, e[0] * 1e300), (12, e[0] * 1e-300), (13, -e[0]), (14, [1, 0]), (15, [2, 0]), (16, [-0.0, 1]), (17, [0.0, 1])]
    rows += [(20, e[1]), (20, e[1]), (20, e[2]), (None, e[2]), (None, e[3]), (0, e[3]), (None, None)]
    _hold(spark, rows)


def test_threshold_is_exact(spark):
    at = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), 0.0]
    limit = np.degrees(np.arccos(0.95))
    rows = [(9 - i, at(a)) for i, a in enumerate((0, limit - 1e-5, limit + 1e-5, 2 * limit, 100, 100 + limit / 2, 100 + limit - 1e-5, 100 + limit + 1e-5))]
    _hold(spark, rows)


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_all_kinds(spark, monkeypatch, seed):
    """A third in one tight group, copies, pairs, a loose group without balls, and vectors alone; small blocks and lists."""
    monkeypatch.setattr(nearsets, "BLOCK", 32)
    monkeypatch.setattr(nearsets, "LEFT", 40)
    monkeypatch.setattr(nearsets, "RIGHT", 50)
    rng = np.random.default_rng(seed)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.standard_normal((n, 24)))
    tight = unit(1) + 0.018 * rng.standard_normal((400, 24))
    loose = unit(1) + 0.04 * rng.standard_normal((60, 24))
    alone = unit(500)
    pairs = alone[:80] + 0.045 * rng.standard_normal((80, 24))
    copies = np.repeat(alone[100:103], 40, axis=0)
    every = np.concatenate((tight, loose, alone, pairs, copies)) * rng.uniform(0.1, 9, (1160, 1))
    ids = rng.permutation(len(every))
    _hold(spark, [(int(i), v.tolist()) for i, v in zip(ids, every)], parts=5)


def test_chain_of_links(spark):
    """One component that no ball holds."""
    angle = np.arccos(0.951)
    rows = [(100 - i, [np.cos(i * angle), np.sin(i * angle)]) for i in range(15)]
    got = _hold(spark, rows)
    assert {r[2] for r in got} == {86}


def test_lists_grow_where_they_are_saturated(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "LIST", 2)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    rows = [(i, (centre / np.linalg.norm(centre) + 0.035 * rng.standard_normal(32)).tolist()) for i in range(90)]
    _hold(spark, rows)


def test_no_rows(spark):
    assert nearsets.near_sets(spark.createDataFrame([], SCHEMA), 0.95).collect() == []
    assert [tuple(r) for r in nearsets.near_sets(spark.createDataFrame([(7, None, 1, "x")], SCHEMA), 0.95).collect()] == [(7, 0, 7, True)]
