"""Periodic runs against a search of all stretches, and the query's contract against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from hopframe.llm import periodic

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """(start, length, period) of all runs: every maximal stretch of every period, kept where no smaller one fits."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(kept)))


@pytest.mark.parametrize("seed", range(30))
def test_scan_against_all_stretches(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(12):
        n, kinds = int(rng.integers(0, 260)), int(rng.integers(1, 5))
        words = rng.integers(0, kinds, n).tolist()
        if seed % 3 == 0 and n > 40:
            unit = rng.integers(0, 50, int(rng.integers(1, 40))).tolist()
            words[10:] = (unit * n)[: n - 10]
            words[int(rng.integers(0, n))] = 99
        docs.append(words)
    counts = np.array([len(d) for d in docs])
    got = list(zip(*(x.tolist() for x in periodic.scan(np.concatenate([np.array(d, np.int32) for d in docs]).astype(np.int32), counts))))
    assert got == [(i, *r) for i, d in enumerate(docs) for r in brute(d)]


def test_scan_by_ranges_of_lags():
    rng = np.random.default_rng(5)
    words = ([1] * 700 + rng.integers(0, 2, 300).tolist() + [1, 2, 3] * 100 + list(range(200)) * 3) * 2
    ids, counts = np.array(words, np.int32), np.array([len(words)])
    whole = set(zip(*(x.tolist() for x in periodic.scan(ids, counts)[1:])))
    parts: dict = {}
    for low in range(1, len(words) // 2 + 2, 97):
        for s, n, p in zip(*(x.tolist() for x in periodic.scan(ids, counts, low, low + 97)[1:])):
            parts[s, n] = min(p, parts.get((s, n), p))
    assert {(s, n, p) for (s, n), p in parts.items()} == whole == set(brute(words))


def _texts():
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 6 + k, int(rng.integers(0, 90)))) for k in range(60)]
    odd = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "\x0ba\x0ca\ra\na\ta" + " a" * 9, "é É é É é É é É é É é É é", "a b " * 14, "A a " * 10 + "x", ("x y z " * 9 + "q ") * 5]
    return base + odd + base[:5]


def _rows(spark, texts, parts):
    rows = [(i if i % 9 else i // 2, t, "runs", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, start long").repartition(parts), rows


@pytest.mark.parametrize("limits", [{}, {"long_bytes": 40, "lags": 7}])
def test_query_contract(spark, limits):
    docs, rows = _rows(spark, _texts(), 4)
    got = periodic.digests(periodic.collapse(periodic.planted(docs, "doc_id", "text"), "text", "doc_id", **limits), "doc_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *expected(i, t))) for i, t, *_ in rows)


def test_own_columns_and_words(spark):
    docs, rows = _rows(spark, ["a b " * 8 + "c", None], 1)
    got = {r.start: r for r in periodic.collapse(docs, "text", "start", "text").collect()}
    assert bytes(got[0].collapsed) == b"a b c" and [tuple(x) for x in got[0].runs] == [(0, 16, 2)] and got[0].n_words == 17
    assert got[1].collapsed == b"" and got[1].runs == [] and got[1].n_words == 0


def test_very_long_text(spark):
    text = "x y z w " * 150_000
    docs = spark.createDataFrame([(3, text), (4, "q " * 300_000 + text), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapse(docs, "text", "doc_id", long_bytes=1 << 20, lags=1 << 16).collect()}
    assert [tuple(x) for x in got[3].runs] == [(0, 600_000, 4)] and bytes(got[3].collapsed) == b"x y z w"
    assert [tuple(x) for x in got[4].runs] == [(0, 300_000, 1), (300_000, 600_000, 4)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.collapse(periodic.planted(docs, "doc_id", "text"), "text", "doc_id"), "doc_id").collect() == []
