import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import ann, decontaminate, language, lm, resample

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def best_path(s, penalty):
    def worth(p):
        return sum(s[t][k] for t, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))

    return max(worth(p) for p in itertools.product(range(s.shape[1]), repeat=len(s))), worth


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(0, 2, (7, 3))
    best, worth = best_path(s, 2.0)
    assert worth(tuple(language.path(s, 2.0))) == pytest.approx(best)


def test_mixed_languages_and_scripts(spark):
    en, fr, ru = "the cat sat on that mat with this hat ", "le chat est dans la maison avec une souris ", "кошка сидит на окне и смотрит в сад "
    train = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), (ru * 5, "ru"), ("nothing", None), (None, "en")], "text string, lang string")
    model = language.learn(train)
    docs = spark.createDataFrame([(1, en), (2, fr), (3, ru), (4, en * 3 + fr * 2), (5, None), (6, "12 !!"), (7, ""), (8, ru + "mat")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.label(docs, model, "doc_id").collect()}
    assert [got[i].lang_pred for i in range(1, 9)] == ["en", "fr", "ru", "en", "und", "und", "und", "ru"]
    assert [s.lang for s in got[4].spans] == ["en", "fr"] and got[4].spans[0].last == len(en.split()) * 3 - 1
    assert got[5].score == 0 and 0 < got[4].score < 1
    none = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.label(docs, none, "doc_id").collect()} == {"und"}
    assert language.label(docs.limit(0), model, "doc_id").count() == 0


def test_scores_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("a b c dd ee Ff g".split()) for _ in range(rng.randint(0, 20)))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen words only"), (3, "a b"), (None, "a b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").coalesce(3)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 2
    df.write.parquet(path := f"{tmp_path}/docs")
    got = lm.score(spark.read.parquet(path), train).collect()
    token = lambda t: [*WORD.findall((t or "").encode().lower()), b""]
    used = [token(t) for i, t in rows if (i or 0) % 5 != 2]
    one = Counter(w for ws in used for w in ws)
    two = Counter(p for ws in used for p in zip(ws, ws[1:]))
    n, v = sum(one.values()), len(one)
    n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    m = lm.WEIGHT

    def score(ws):
        total = 0.0
        for i, w in enumerate(ws):
            root = (one[w] - d) / n if one[w] else d * v / n
            h = one[ws[i - 1]] if i else 0
            total += math.log10((two[ws[i - 1], w] + m * root) / (h + m) if i else root)
        return total

    want = sorted((str(i), len(token(t)), sum(one[w] > 0 for w in token(t)), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in token(t)), 8), round(score(token(t)), 8)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in got) == want
    total = sum(10 ** score([w])  for w in one) + d * v / n  # one state's arcs: a distribution
    assert total == pytest.approx(1.0)


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(df, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def vectors(seed, n=400, d=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(1000, None), (1100, [0.0] * d), (1200, [1.0] * (d - 1) + [float("nan")]), (1300, [1.0] * (d - 1) + [None]), (1400, [1.0]), (None, rows[0][1])]
    return rows


def test_neighbours_against_brute_force(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, books, d = ann.build(df, 6, books=4, words=64)
    got = ann.search(index, books, d, df.where("vec_id % 20 = 0"), 5).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 1000}
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in good if i % 20 == 0}
    for q, found in by.items():
        want = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:5]
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and all(s == pytest.approx(np.sqrt(((good[q] - good[i]) ** 2).sum()), abs=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want})
        total += 5
    assert hit / total >= 0.95


def test_neighbours_with_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index, books, d = ann.build(df, 11)
    assert [(r["rank"], r.vec_id) for r in ann.search(index, books, d, df.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    index, books, d = ann.build(df.limit(0), 11)
    assert ann.search(index, books, d, df, 10).count() == 0


def test_neighbours_in_a_dense_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16))
    x[:3000] = x[0] + rng.normal(size=(3000, 16)) * 0.01
    x[7], x[5000] = x[8], x[5001]
    ids = np.arange(6000)
    ids[100:150] = 99  # one id, many vectors
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    index, books, d = ann.build(df, 11, books=4, words=32)
    got = {}
    for r in ann.search(index, books, d, df.where("vec_id % 100 in (0, 8, 99)"), 10, shortlist=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) == len({i for i in ids.tolist() if i % 100 in (0, 8, 99)})
    for q, found in got.items():
        v = x[ids == q]
        v = v[np.lexsort(v.T[::-1])[0]]  # the smallest
        near = np.sqrt(((x - v) ** 2).sum(axis=1))
        least = {}
        for i, s in zip(ids.tolist(), near.tolist()):
            if i != q:
                least[i] = min(s, least.get(i, s))
        want = sorted(least, key=lambda i: (least[i], i))[:10]
        assert [i for _, i in sorted(found)] == want, q


def test_encoding_beats_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    c = ann.Codebooks(x, 6, 16)
    codes, norm = c.encode(x, 8)
    rebuilt = sum(c.books[j][codes[:, j]] for j in range(6))
    greedy, _ = c.encode(x, 1)
    error = lambda k: ((x - sum(c.books[j][k[:, j]] for j in range(6))) ** 2).sum()
    assert norm == pytest.approx((rebuilt**2).sum(axis=1), rel=1e-3) and error(codes) < error(greedy)


def test_top_by_key(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=3000), *[0.5] * 1500]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "row_id long, key double")
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    for k in (0, 1, 700, 1200, 2500, 4500, 9999):
        assert sorted(r.row_id for r in resample.top(df, "key", k).collect()) == sorted(order[:k])


def test_resampling_drops_what_targets_lack(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    text = lambda bad: " ".join(rng.choice(words) if not bad or rng.random() > 0.3 else "vile" for _ in range(60))
    rows = [(i, text(i % 5 == 0)) for i in range(1500)] + [(None, text(False)), (9999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    labels = spark.createDataFrame([(i, i % 5 != 0) for i in range(0, 1500, 2)] + [(7, True), (7, True), (9998, True)], "doc_id long, target boolean")
    got = resample.resample(docs, labels, 1150).collect()
    assert len(got) == 1150
    bad = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 5 == 0]
    assert len(bad) < 12
    assert [r.doc_id for r in resample.resample(docs, labels, 1150).collect()] == [r.doc_id for r in got]
    assert {r.log_weight for r in resample.resample(docs, labels.limit(0)).collect()} == {0.0}
    assert resample.resample(docs.limit(0), labels).count() == 0


def test_weights_against_counting(spark):
    """Log ratios of the two models, n-gram by n-gram, without hashing."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 21]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None), (3, "w1 W2"), (None, "w1")]
    targets = {i for i in range(200) if i % 21 > 8 and i % 2}
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, log_weight double").coalesce(2)
    labels = spark.createDataFrame([(i, i in targets) for i in range(200)], "doc_id long, target boolean")
    got = resample.weights(docs, labels).collect()

    def grams(t):
        w = [x.lower() for x in (t or "").split()]
        return w + list(zip(w, w[1:]))

    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in targets for g in grams(t))
    share = sum(target.values()) / sum(raw.values())

    def ratio(g):
        t, e = target[g], raw[g] * share
        return math.log((t + resample.PRIOR) / (e + resample.PRIOR)) if abs(t - e) >= resample.DEVIATIONS * math.sqrt(e + 1) else 0.0

    want = sorted(round(sum(map(ratio, grams(t))), 6) for _, t in rows)
    assert sorted(round(r.log_weight, 6) + 0.0 for r in got) == pytest.approx(want, abs=1e-5) and any(want)


def test_sample_does_not_depend_on_layout(spark):
    rows = [(i % 90, f"a b c{i % 90}") for i in range(180)] + [(None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, True), (2, False)], "doc_id long, target boolean")
    one, two = (sorted(map(str, ((r.doc_id, round(r.key, 9)) for r in resample.resample(df.repartition(n), labels, 50).collect()))) for n in (1, 5))
    assert one == two


def test_words_have_their_marks():
    assert language.words_of("\u0928\u092e\u0938\u094d\u0924\u0947 Caf\u0065\u0301 x_y 12") == ["\u0928\u092e\u0938\u094d\u0924\u0947", "cafe\u0301", "x", "y"]


def test_closures_carry_no_worker_state():
    from pyspark import cloudpickle

    from hopframe.llm import common

    common.powers(10)
    assert len(cloudpickle.dumps(common.tidy(lambda b: b))) < 5000


def test_lcs_bits():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert decontaminate.lcs(np.array(a), np.array(b)) == row[-1]


def test_leaks_and_paraphrases(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(30) for _ in range(20)] + [say(70), None, "too short"]
    soft = items[1].split()
    soft[3:5] = ["x1", "x2"]
    soft[20] = "x3"
    rows = [say(200) for _ in range(40)]
    rows += [say(60) + " " + items[0].upper() + " " + say(50), say(11) + " " + " ".join(soft) + " " + say(300), items[20], say(20) + " " + " ".join(items[2].split()[:8]), None, "", items[0]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, item_id int").coalesce(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(40, 0), (41, 1), (42, 20), (46, 0)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_leaks_of_a_full_block(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(15, 59)) for _ in range(400)] + [say(16 * 700)]
    rows = [f"{say(40)} {t} {say(40)}" for t in items[:400]] + [say(100), items[400]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(got) == [(i, i) for i in range(400)] + [(401, 400)]


def test_leaks_of_short_items(spark):
    rng = random.Random(11)
    common, rare = [f"c{i}" for i in range(200)], [f"r{i}" for i in range(5000)]
    say = lambda n, share=0.5: " ".join(rng.choice(rare if rng.random() < share else common) for _ in range(n))
    items = [say(rng.randint(3, 16), 0.3) for _ in range(120)] + ["r1 r2", "  ", "r3"]
    soft = [t.split() for t in items[:120] if len(t.split()) >= 7]
    for t in soft:
        t[len(t) // 2] = "x"
    rows = [f"{say(40)} {t.upper()} {say(40)}" for t in items[:120]] + ["c1 r1 r2", "r1 c1 r2", "", None]
    rows += [f"{say(40)} {' '.join(t)} {say(40)}" for t in soft]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontaminate.contaminated(docs, bench).collect()}
    plain = [f" {(t or '').lower()} " for t in rows]
    want = {(d, i) for i, t in enumerate(items) if t.strip() for d, text in enumerate(plain) if f" {t} " in text}
    assert {x for x, share in got.items() if share == 1} >= want and (120, 120) in want and (121, 120) not in got
    kept = [i for i, t in enumerate(items[:120]) if len(t.split()) >= 7]
    assert sum((124 + k, i) in got for k, i in enumerate(kept)) >= 0.9 * len(kept)


def _best_windows(items, texts):
    """The best shares of every text and item over all windows, whatever their cosine."""
    best = {}
    for d, h in enumerate(texts):
        for k, item in enumerate(items):
            n = len(item.words)
            w = decontaminate.window_of(n)
            for start in range(0, max(len(h) - w // 2, 1), w // 2) if n >= decontaminate.LEAST else ():
                if found := item.matches(h[max(0, start - n) : min(start + w, len(h)) + n]):
                    best[d, k] = max(best.get((d, k), found), found)
    return best


def _rare_ones_replaced(seed, n_items):
    """Items, and texts that hold them with the rarest half of their answer's words and others of the rare ones replaced."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    say = lambda n, share: [rng.choice(rare if rng.random() < share else common) for _ in range(n)]
    items = [say(5 + i * 7 % 60, 0.35) for i in range(n_items)]
    soft = [[rng.choice(rare) if x[0] == "r" and rng.random() < 0.6 else x for x in t] for t in items]
    long = [y for t in soft for y in say(30, 0.5) + t]
    rows = [say(40, 0.5) + t + say(40, 0.5) for t in soft] + [say(200, 0.1) for _ in range(20)] + [t[: len(t) // 2] for t in items[::5]] + [long, [], ["c1"]]
    return [" ".join(t) for t in items] + ["c1 r1 c2"], [" ".join(t) for t in rows]


def test_leaks_below_the_cosine(spark):
    items, rows = _rare_ones_replaced(13, 45)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    idf = decontaminate._weights(docs)
    words = lambda t: decontaminate.Item(0, t, idf).words
    want = _best_windows([decontaminate.Item(i, t, idf) for i, t in enumerate(items)], [words(t) for t in rows])
    got = {(r.doc_id, r.item_id): (r.lcs_share, r.answer_share) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("pairs", [1 << 19, 300])
def test_rest_loses_no_window(monkeypatch, pairs):
    """Also in small runs, whose stretches of words begin and end within texts; every window comes once."""
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    items, rows = _rare_ones_replaced(14, 24)
    rng = np.random.default_rng(14)
    for idf in (np.ones(1 << decontaminate.BITS), rng.uniform(0.1, 8, 1 << decontaminate.BITS)):
        held = [decontaminate.Item(i, t + (" answer: c1 c2" if i % 7 == 0 else ""), idf) for i, t in enumerate(items)]
        texts = [decontaminate.Item(0, t, idf).words for t in rows]
        offsets = np.cumsum([0, *map(len, texts)])
        best, seen = {}, []
        for row, start, end, k, n in decontaminate.Rest(held, idf).candidates(np.concatenate(texts), offsets):
            seen.append((start, k))
            region = texts[row][max(0, start - offsets[row] - len(held[k].words)) : end - offsets[row] + len(held[k].words)]
            assert n == np.isin(region, held[k].words).sum()
            if found := held[k].matches(region):
                best[row, k] = max(best.get((row, k), found), found)
        assert best == _best_windows(held, texts) and len(best) > 20
        assert pairs < 1000 or len(seen) == len(set(seen))
    none = decontaminate.Rest([decontaminate.Item(0, "too short", idf)], idf)
    assert list(none.candidates(texts[0], np.array([0, len(texts[0])]))) == [] == list(none.candidates(texts[0][:0], np.array([0, 0])))


def test_passages_keep_their_norm(spark):
    rng = random.Random(10)
    idf = np.ones(1 << decontaminate.BITS)
    items = [decontaminate.Item(i, " ".join(f"t{rng.randint(0, 2000)}" for _ in range(40)), idf) for i in range(200)]
    (group,) = decontaminate.groups(items)
    index = decontaminate.Index(spark, group, idf)
    ids = [np.unique(np.searchsorted(index.vocabulary, p), return_counts=True) for _, p in group]
    own = np.stack([n @ index.words[i] / np.linalg.norm(n) for i, n in ids])
    assert len(group) > 256 and np.linalg.norm(own, axis=1).min() > 0.999


def test_the_bound_loses_no_window(spark):
    rng = random.Random(12)
    idf = np.random.default_rng(12).uniform(0.5, 6, 1 << decontaminate.BITS)
    say = lambda n: " ".join(f"t{int(rng.paretovariate(0.4)) % 400}" for _ in range(n))
    items = [decontaminate.Item(i, say(40), idf) for i in range(200)]
    (group,) = decontaminate.groups(items)
    index = decontaminate.Index(spark, group, idf)
    h = np.concatenate([decontaminate.Item(0, say(3000), idf).words, *(np.concatenate([x.words[:9], x.words[20:]]) for x in items[:40])])
    got = {(start, item) for _, _, start, _, item in index.candidates(h, np.array([0, len(h)]))}
    want = {}
    for start in range(0, len(h) - decontaminate.STRIDE, decontaminate.STRIDE):
        x = h[start : start + decontaminate.WINDOW]
        known = np.unique(x[np.isin(x, index.vocabulary)])
        near = index.words[np.searchsorted(index.vocabulary, known)].sum(axis=0) @ index.passages.T / np.sqrt((idf[decontaminate.bucket(x)] ** 2).sum())
        for p, c in enumerate(near):
            want[start, int(index.owner[p])] = max(float(c), want.get((start, int(index.owner[p])), -1.0))
    sure = {k for k, c in want.items() if c > decontaminate.COSINE + 1e-4}
    assert len(group) > 256 and len(sure) > 100 and sure <= got <= {k for k, c in want.items() if c > decontaminate.COSINE - 1e-4}


def test_randomised_svd(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 25))
    rows = spark.createDataFrame([(list(range(25)), [float(x) for x in r]) for r in a], "ids array<int>, weights array<double>").repartition(3)
    v = decontaminate.randomised_svd(rows, 25, 4).astype(np.float64)
    assert np.abs(a - a @ v @ v.T).max() < 1e-4


def test_letters_are_those_of_unicode():
    """Numerals, marks and symbols are no words, whatever else is in the text; lower-casing may change a character."""
    import unicodedata

    for c in map(chr, range(0x3000)):
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        low = c.lower()
        assert bool(language.words_of(c)) == any(unicodedata.category(x)[0] == "L" for x in low), hex(ord(c))
    assert language.words_of("½ ² Ⅷ ① x² áb 12 _c") == ["x", "áb", "c"]
    assert language.words_of("½ ²") == language.words_of("́") == []


def test_more_languages_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    words = {"aa": "zeta zola", "bb": "mimo memo", "cc": "pulu pilu", "dd": "kraka kroko"}
    rows = [(w, k) for k, w in words.items() for _ in range(1 if k == "bb" else 5)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["aa", "cc", "dd"]
    got = language.label(spark.createDataFrame([("x", "pulu pilu"), ("y", "½"), ("z", None)], "lang_pred string, text string").select("text", "lang_pred"), model, "text").collect()
    assert sorted(str(r["lang_pred"]) for r in got) == ["cc", "und", "und"]


@pytest.mark.parametrize("kind", ["great", "small", "mixed", "wide"])
def test_nearest_whatever_the_norms(spark, kind, monkeypatch):
    """Against brute force in exact scales, beside vectors of 1e200 and 1e-200."""
    monkeypatch.setattr(ann, "SAMPLE", 300)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8))
    if kind == "great":
        x[0] *= 1e200
    elif kind == "small":
        x *= 1e-200
    elif kind == "mixed":
        x *= 10.0 ** rng.integers(-200, 200, (700, 1))
    else:
        x[:40] *= 3e306
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, books, d = ann.build(rows, 11)
    got = {}
    for r in ann.search(index, books, d, rows.where("vec_id % 20 = 0"), 10, shortlist=30).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact = x.astype(np.longdouble)  # of a wider range
    for q in range(0, 700, 20):
        apart = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        near = np.delete(apart, q)
        assert np.allclose([got[q][k + 1][1] for k in range(10)], np.sort(near)[:10].astype(float), rtol=1e-12, atol=0)
        assert np.allclose(apart[[got[q][k + 1][0] for k in range(10)]].astype(float), [got[q][k + 1][1] for k in range(10)], rtol=1e-12, atol=0)
