import random
import re

import numpy as np
import pytest

from hopframe.llm import components, jaccard, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))))
    return out


def brute_components(rows, words, percent):
    sets = []
    for t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_components_against_brute_force(spark, tmp_path, seed, words, percent):
    rows = [*texts(seed), None, "", " \t", "Same Words", "same words", "same words"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, component string").repartition(3)
    df.write.parquet(path := f"{tmp_path}/docs")
    got = jaccard.similar(spark.read.parquet(path), words, percent).collect()
    want, sizes = brute_components(rows, words, percent)
    names = {}
    for r in got:
        names[r.component] = min(names.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: (r.n_shingles, names[r.component]) for r in got} == {i: (sizes[i], want[i]) for i in range(len(rows))}


@pytest.mark.parametrize("size", [120, 240])
def test_large_group_of_near_copies_without_its_original(spark, tmp_path, monkeypatch, size):
    """Copies with one to three words changed, so that many share rare shingles without a link: exact all the same, and
    the last join makes a few pairs, not the square of the group."""
    rng = random.Random(size)
    original = [f"w{i}" for i in range(150)]

    def changed(k):
        out = list(original)
        for i in range(k):
            out[rng.randrange(150)] = f"x{rng.random()}"
        return " ".join(out)

    rows = [changed(1 + i % 3) for i in range(size)] + [" ".join(f"{w}{i}" for w in original) for i in range(5)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.parquet(path := f"{tmp_path}/docs")
    made = []
    real = jaccard.common.stage
    monkeypatch.setattr(jaccard.common, "stage", lambda df, tag, *more: made.append((tag, real(df, tag, *more))) or made[-1][1])
    got = jaccard.similar(spark.read.parquet(path), 4, 85).collect()
    want, _ = brute_components(rows, 4, 85)
    names = {}
    for r in got:
        names[r.component] = min(names.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: names[r.component] for r in got} == dict(enumerate(want))
    assert sum(df.count() for tag, df in made if tag == "rest") < 4 * size


def brute_links(rows, words, percent):
    sets = []
    for t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    linked = lambda a, b: len(a & b) > 0 and 100 * len(a & b) >= percent * len(a | b)
    return {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}


@pytest.mark.parametrize(("seed", "members", "columns", "dense"), [(1, jaccard.MEMBERS, jaccard.COLUMNS, jaccard.DENSE), (2, 7, 50, 10**6), (3, 7, 50, 0)])
def test_all_links_are_counted(spark, tmp_path, monkeypatch, seed, members, columns, dense):
    """A group of near copies, all linked with each other, a chain whose ends aren't linked, copies and odd texts."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rng = random.Random(seed)
    original = [f"w{i}" for i in range(120)]
    group = [" ".join(f"x{rng.random()}" if i == k * 3 else w for i, w in enumerate(original)) for k in range(40)]
    chain = [" ".join(f"c{i}" for i in range(k * 4, k * 4 + 100)) for k in range(30)]
    rows = [*texts(seed, 30), *group, *chain, *group[:3], group[4].upper(), None, "", "one two", "One two"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.parquet(path := f"{tmp_path}/docs")
    got = {r.doc_id: r.n_links for r in jaccard.similar(spark.read.parquet(path), 4, 85).collect()}
    assert got == brute_links(rows, 4, 85) and got[30] > 40


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string").coalesce(1)
    assert len({r.component for r in jaccard.similar(df).collect()}) == 1
    assert jaccard.similar(df.limit(0)).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_cut(docs, length):
    seen = {}
    for b in docs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in docs:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append(mark)
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdé "
    rand = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, line = rand(350), rand(205)
    rows = [rand(rng.randint(0, 900)) for _ in range(12)]
    rows += [rand(50) + passage + rand(60), rand(120) + passage[:260], passage[90:] + rand(10), line + rand(30) + line, "ab" * 300, "z" * 230, "z" * 199, None, "", "q" * 200]
    rows += [rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, substrings.HOT_BYTES), (2, substrings.HOT_BYTES), (3, 400)])
def test_repeats_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_bytes int").coalesce(2)
    got = {r.doc_id: r for r in substrings.remove_repeats(df, 200, hot).collect()}
    raw = [(t or "").encode() for t in rows]
    for i, mark in enumerate(brute_cut(raw, 200)):
        r = got[i]
        edge = np.diff(np.concatenate(([0], mark.astype(int), [0])))
        assert bytes(r.kept) == np.frombuffer(raw[i], np.uint8)[~mark].tobytes(), i
        assert (r.n_bytes, r.n_removed) == (len(raw[i]), int(mark.sum()))
        assert [(s["from"], s["to"]) for s in r.spans] == list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def test_windows_in_suffix_order():
    rng = np.random.default_rng(0)
    parts = [rng.integers(97, 100, rng.integers(30, 400)).astype(np.uint8) for _ in range(8)]
    parts += [parts[0][10:], np.concatenate((parts[1], parts[1]))]
    data, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    got = substrings.repeated_windows(data, bounds, 40)
    seen = {}
    for p in parts:
        for i in range(len(p) - 39):
            seen[p[i : i + 40].tobytes()] = seen.get(p[i : i + 40].tobytes(), 0) + 1
    for k, p in enumerate(parts):
        assert [bool(x) for x in got[bounds[k] : bounds[k + 1]]] == [i <= len(p) - 40 and seen[p[i : i + 40].tobytes()] > 1 for i in range(len(p))]


def test_long_text_in_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 3000, 5000])
    whole = [(r, a, a + k) for _, _, rows, at, n, _ in substrings.phrases(data, offsets, 200) for r, a, k in zip(rows, at, n)]
    cut = [(r, a, a + k) for _, _, rows, at, n, _ in substrings.phrases(data, offsets, 200, 700) for r, a, k in zip(rows, at, n)]
    cover = lambda x: sorted((r, i) for r, a, b in x for i in range(a, b))
    assert cover(whole) == cover(cut) == [(1, i) for i in range(2801)] + [(2, i) for i in range(1801)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).count() == 0
