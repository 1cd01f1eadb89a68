"""Clashing extra columns, repeated rows, ties, nulls and very long texts, operator by operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import ann, common, decontaminate, jaccard, language, lm, packing, resample

WORDS = "the quick brown fox jumps over a lazy dog near that old stone bridge while rain falls".split()


def _long(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i % len(WORDS)]}{i % 97}" for i in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def docs(spark):
    item = "which mason carved the seven grey lions that guard the northern gate of the old harbour town"
    long = _long(200_000)
    texts = [" ".join(WORDS[i:] + WORDS[:i]) + f" {item if i == 3 else i}" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, texts[5]), (None, texts[3]), (20, None), (21, ""), (22, long), (22, long), (23, long + " " + item + " " + _long(50_000, 1))]
    table = spark.createDataFrame([(i, t, "en" if t and i != 7 else None, 1) for i, t in rows], "doc_id long, text string, lang string, other int")
    return common.stage(table.repartition(3), "docs"), item  # stored, as rows are told apart by their place


def _clash(df):
    """Columns with names that operators use themselves."""
    return df.withColumns({c: F.lit(7) for c in ("row_id", "pid", "train", "score", "h", "component", "label", "length", "start", "identity", "key")})


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_decontaminate(docs, spark):
    rows, item = docs
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.contaminated(rows, bench).drop("row_id")
    assert sorted({(str(r.doc_id), str(r.item_id)) for r in found.collect()}) == sorted((d, i) for d in ("3", "None", "23") for i in ("1", "None"))
    _same(decontaminate.contaminated(_clash(rows), _clash(bench)).drop("row_id"), found)


def test_language(docs):
    rows, _ = docs
    model = language.learn(rows)
    got = language.label(rows, model, "doc_id")
    assert {str(r.doc_id) for r in got.collect() if r.lang_pred == "und"} == {"20", "21"} and got.count() == rows.count()
    again = language.learn(_clash(rows))
    assert again.languages == model.languages and (again.table == model.table).all()
    _same(language.label(_clash(rows), model, "doc_id"), got)


def test_lm_scores(docs):
    rows, _ = docs
    train = F.coalesce(F.col("doc_id") != 22, F.lit(True))
    got = lm.score(rows, train)
    long = [r for r in got.collect() if r.doc_id == 22]
    assert len(long) == 2 and long[0] == long[1] and long[0].n_tokens == 200_001 and got.count() == rows.count()
    _same(lm.score(_clash(rows), train), got)


def test_resampling(docs, spark):
    rows, _ = docs
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)] + [(22, True), (None, True)], "doc_id long, target boolean")
    got = resample.resample(rows, labels, 8)
    assert got.count() == 8
    _same(resample.resample(_clash(rows), labels, 8).drop("row_id"), got.drop("row_id"))
    assert resample.resample(rows, labels, 100).count() == rows.count() and resample.resample(rows, labels, 0).count() == 0


def test_near_duplicates(docs):
    rows, _ = docs
    got = jaccard.similar(rows, 5, 80)
    by = {}
    for r in got.join(rows.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.length("text").alias("n")), "row_id").select("component", "n").collect():
        by.setdefault(r.component, []).append(r.n)
    assert sorted(len(v) for v in by.values() if max(x or 0 for x in v) > 1_000_000) in ([1, 2], [3])  # 22 twice, and 23, which holds much of it
    assert sorted(by_text := [len(v) for v in by.values()])[-1] >= 2 and sum(by_text) == rows.count()
    _same(jaccard.similar(_clash(rows), 5, 80), got)


def test_nearest_with_clashing_columns(spark):
    x = np.random.default_rng(2).standard_normal((60, 4)).round(1)
    rows = spark.createDataFrame([(i % 50, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = []
    for some in (rows, _clash(rows).withColumns({"ids": F.lit(1), "norm": F.lit(2), "codes": F.lit("x"), "d": F.lit(3)})):
        index, books, d = ann.build(some, 6, books=2, words=8)
        found.append(ann.search(index, books, d, some.where("vec_id % 10 = 0"), 5, shortlist=8))
    _same(*found)


def test_packing_ties_and_long_texts(docs):
    """Equal lengths are told apart, a long text is cut into pieces, and sequences have neither gap nor overlap."""
    rows, _ = docs
    from hopframe.llm import encoding

    packed = packing.pack(_clash(rows), encoding.public_path("byte_bpe_50k.json"), 0, 2048, with_ids=False).collect()
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert len(places) <= -(-total // 2048) + 1
    long = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 23)
    assert [p for p, *_ in long] == list(range(len(long))) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:])) and len(long) > 100
