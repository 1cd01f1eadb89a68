"""The automaton of names against search by every name at every place."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hopframe.functions import automaton, masking
from hopframe.functions.automaton import Automaton


def taken(names, text):
    low, out, at = automaton.lowered(text), [], 0
    names = {automaton.lowered(n) for n in names if n}
    while at < len(low):
        longest = max((len(n) for n in names if low.startswith(n, at)), default=0)
        if not longest:
            at += 1
            continue
        end = at + longest
        if (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
            out.append((at, end))
        at = end
    return out


@pytest.mark.parametrize("seed", range(15))
def test_against_every_name_at_every_place(seed, tmp_path):
    rng = random.Random(seed)
    letters = "ab c" if seed % 2 else "aÉ İ𝔘é"
    for _ in range(12):
        names = ["".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 14))]
        texts = ["".join(rng.choices(letters + "B", k=rng.choice([0, 5, 40, 1400]))) for _ in range(4)]
        known = Automaton.build(names)
        assert [[x[:2] for x in spans] for spans in known.chosen(texts)] == [taken(names, t) for t in texts]
        low = {automaton.lowered(n) for n in names if n}
        assert known.occurring(texts) == {n for n in low if any(n in automaton.lowered(t) for t in texts)}
    known.save(str(tmp_path / "a.arrow"))
    assert Automaton.load(str(tmp_path / "a.arrow")).replace(texts, ["#"]) == known.replace(texts, ["#"])


def test_nested_and_long_names():
    deep = "x" * 3000
    known = Automaton.build(["x", "xx", deep, "y " + deep], [0, 1, 2, 3])
    assert known.replace([f"({deep}) x xx xxx y {deep}!", deep + "x"], ["1", "2", "3", "4"]) == ["(3) 1 2 xxx 4!", deep + "x"]


def test_boundary_is_looked_at_after_the_longest():
    known = Automaton.build(["Ann", "Ann Lee", "Glass"], [0, 0, 1])
    tags = ["[PERSON]", "[MOVIE]"]
    assert known.replace(["ann lee met Ann.", "Ann Leeds", "_Glass_ glasses"], tags) == ["[PERSON] met [PERSON].", "Ann Leeds", "_[MOVIE]_ glasses"]


def test_many_names_in_linear_time():
    rng = random.Random(5)
    names = [f"{rng.getrandbits(48):x}" for _ in range(60_000)]
    known = Automaton.build(names)
    text = " ".join(rng.choices([*names[:50], "other", "zzz", "aaaa"], k=40_000))
    known.chosen([text])
    began = time.perf_counter()
    one = len(known.chosen([text])[0])
    middle = time.perf_counter()
    four = len(known.chosen([" ".join([text] * 4)])[0])
    assert four == 4 * one and time.perf_counter() - middle < 10 * (middle - began)


def test_masker_from_a_configuration(spark):
    triples = spark.createDataFrame([("Ann", "directed_by", "Bo Li"), ("Glass House", "starred_actors", "Ann"), ("Zoo", "has_genre", "Noir")], "src string, rel string, dst string")
    corpus = spark.createDataFrame([("Ann saw the GLASS HOUSE with Bo Lint",), (None,)], "text string")
    config = {"movie_placeholder": "<M>", "person_placeholder": "<P>"}
    texts = spark.createDataFrame([("ann in Glass House, a Zoo; Bo Li",), (None,)], "text string")
    assert [r[0] for r in texts.select(masking.masker(config, triples)(F.col("text"))).collect()] == ["<P> in <M>, a <M>; <P>", ""]
    assert [r[0] for r in texts.select(masking.masker(config, triples, corpus)(F.col("text"))).collect()] == ["<P> in <M>, a Zoo; <P>", ""]
    for bad in ({}, {"movie_placeholder": "<M>"}, {**config, "movie_placeholder": " "}, {**config, "more": "x"}):
        with pytest.raises(ValueError):
            masking.masker(bad, triples)


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(masking, "MOST_NAMES", 2)
    with pytest.raises(ValueError):
        masking.stored_names(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"))


def test_texts_are_read_in_runs(monkeypatch):
    """A batch of any size is worked on by runs of RUN letters, with the results of the whole."""
    monkeypatch.setattr(automaton, "RUN", 100)
    known = automaton.Automaton.build(["red", "Red Ring", "bolt"], [0, 1, 0])
    texts = ["a red ring and a bolt", "", "x" * 250 + " bolt", "redred red"] * 20
    sizes = []
    real = automaton.Automaton.find
    monkeypatch.setattr(automaton.Automaton, "find", lambda self, some: sizes.append((len(some), sum(map(len, some)))) or real(self, some))
    assert known.replace(texts, ["[T]", "[P]"]) == ["a [P] and a [T]", "", "x" * 250 + " [T]", "redred [T]"] * 20
    assert known.occurring(texts) == {"red", "red ring", "bolt"} and known.replace([], ["", ""]) == []
    assert len(sizes) > 40 and all(n == 1 or size <= 100 for n, size in sizes)
