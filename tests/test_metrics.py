import math

import random

import pytest
from pyspark.sql import functions as F

from hopframe.functions import graphs, masking, metrics, text
from hopframe.operators import stats
from hopframe.plans import evaluation

GOLD = ["Which union organised the Marlow Bay strike?", "Who leads [#1]?"]
THREE = ["Where does the River Anwen rise?", "Which country contains [#1]?", "What is the capital of [#2]?"]


def score(spark, pred, gold, question="Who leads the union that organised the Marlow Bay strike?"):
    rows = spark.createDataFrame([(question, pred, gold)], "question string, steps array<string>, gold_steps array<string>")
    return evaluation.score(rows).first()


def test_identical(spark):
    r = score(spark, GOLD, GOLD)
    assert (r.break_exact, r.sari, r.ged, r.chain_validity, r.step_f1, r.exact_match) == (1, 1, 0, 1, 1, 1)


def test_reversed(spark):
    r = score(spark, THREE[::-1], THREE)
    assert r.step_f1 == 1 and r.ordered_accuracy == pytest.approx(1 / 3) and r.chain_validity == 0.5
    assert r.ged == pytest.approx(0.4)


def test_empty_prediction(spark):
    r = score(spark, [], GOLD)
    assert (r.ged, r.chain_validity, r.reference_validity, r.step_f1, r.rouge_l_f1) == (1, 0, 1, 0, 0)
    assert r.sari == pytest.approx(((1 / 9 + 4 / 9 + 5 / 8 + 5 / 7) / 4) / 3)


def test_extra_step(spark):
    r = score(spark, [*GOLD, "Which city is the union based in?"], GOLD)
    assert r.ged == pytest.approx(0.25) and r.count_error == 1


def test_node_cap(spark):
    r = score(spark, ["zzz"] * 17, GOLD)
    assert r.ged == pytest.approx(18 / 17) and r.ged_fallback == "node_cap"


def test_long_searches(spark):
    """Eight steps reversed are searched to the end; a search that is ended says so."""
    gold = [f"find thing {i} of [#{max(i - 1, 1)}]" for i in range(1, 9)]
    assert score(spark, gold[::-1], gold).ged_fallback is None
    a, b = (graphs.graph([s.replace("[#", "@@").replace("]", "@@") for s in x]) for x in (gold[::-1], gold))
    cost, proven = graphs.search(a, b, limit=1)
    assert not proven and cost >= graphs.search(a, b)[0]


def test_words_for_references(spark):
    r = score(spark, [THREE[0], "Which country contains it?", "What is the capital of that?"], THREE)
    assert (r.chain_validity, r.reference_validity) == (0, 1)
    r = score(spark, [THREE[0], "Which country contains [#3]?", THREE[2]], THREE)
    assert (r.chain_validity, r.reference_validity) == (0.5, 0.5)


def test_punctuation_only(spark):
    r = score(spark, ["Which board approved the Rill Valley permit.", "Who chairs [#1]"], ["Which board approved the Rill Valley permit?", "Who chairs [#1]?"])
    assert r.rouge_l_f1 == pytest.approx(0.8) and r.exact_match == 1 and r.break_exact == 0


ITEMS = [
    ("m1", "Who painted the mural in the harbour hall of the guild?", ["Which guild has a harbour hall?", "Who painted the mural of [#1]?"], ["Which guild has a harbour hall?", "Who painted the mural of [#1]?"]),
    ("m2", "Who governs the state that holds the poet's birthplace?", ["Where was the poet born?", "Which state holds [#1]?", "Who governs that place?"], ["Where was the poet born?", "Which state holds [#1]?", "Who governs [#2]?"]),
    ("m3", "When did the school of the founder of the press of Low Tide open?", ["Who printed Low Tide?", "Who founded [#1]?", "Which school did [#2] go to?", "When did [#3] open?"], ["Who printed Low Tide?", "Who founded [#1]?", "Which school did [#2] go to?", "When did [#3] open?"]),
    ("m4", "Who led the guild that built the mill?", ["Which guild built the mill.", "Who led [#1]"], ["Which guild built the mill?", "Who led [#1]?"]),
]


def test_all_groups_of_the_fixture(spark):
    """m2: steps and order 2/3, its one reference valid, no count error, so 0.4 * 2/3 + 0.3 * 2/3 + 0.2 + 0.1;
    11 of its 13 tokens in order against 12."""
    rows = spark.createDataFrame(ITEMS, "item_id string, question string, steps array<string>, gold_steps array<string>")
    got = {r.gold_hops: r for r in evaluation.summarize(evaluation.score(rows)).collect()}
    assert set(got) == {None, 2, 3, 4}
    r = got[3]
    assert (r.n_items, r.exact_match, r.count_exact_rate, r.hop_count_exact_rate, r.hop_count_mae) == (1, 0, 1, 1, 0)
    assert (r.step_f1, r.rouge_l_f1, r.composite) == pytest.approx((2 / 3, 22 / 25, 23 / 30))
    every = {k: (g.n_items, g.exact_match, g.step_f1, g.rouge_l_f1, g.composite, g.count_exact_rate) for k, g in got.items()}
    assert every[None] == pytest.approx((4, 0.75, 0.916667, 0.9075, 0.941667, 1.0), abs=1e-6)  # m4: other punctuation, 6 of 8 tokens
    assert every[2] == pytest.approx((2, 1.0, 1.0, 0.875, 1.0, 1.0)) and every[4] == pytest.approx((1, 1, 1, 1, 1, 1))


@pytest.mark.parametrize(
    ("gold", "pred", "f1"),
    [("Harbour Union", "the Harbour Union of Marlow", 2 / 3), ("New York New York", "New York", 2 / 3), ("", "", 1), ("the", "", 1), ("Dara Volkov", "", 0)],
)
def test_answer_f1(spark, gold, pred, f1):
    assert spark.createDataFrame([(gold, pred)], "g string, p string").select(metrics.answer_f1(F.col("g"), F.col("p"))).first()[0] == pytest.approx(f1)


def test_gold_answers(spark):
    got = spark.createDataFrame([("1871", [None, "1871", "  ", "MDCCCLXXI"])], "a string, b array<string>").select(metrics.gold_answers(F.col("a"), F.col("b")).alias("g"))
    assert got.first()[0] == ["1871", "MDCCCLXXI"]
    assert tuple(got.select(metrics.score_answer(F.lit("mdccclxxi."), F.col("g"))).first()[0]) == (1, 1)
    assert tuple(spark.range(1).select(metrics.score_answer(F.lit("x"), F.array().cast("array<string>"))).first()[0]) == (0, 0)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(metrics.lcs_length("a", "b"), "a", "b").collect()
    assert all(n == brute_lcs(a, b) for n, a, b in got)


def test_alignment_is_not_lcs():
    assert graphs.alignment_matches(["a", "b"], ["b", "a"]) == 0
    assert graphs.alignment_matches(["a", "b"], ["a", "b"]) == 2
    assert graphs.label_distance("", "") == 0


def _cheapest(a, b, loose):
    """Over all mappings."""
    best = float("inf")

    def extend(to):
        nonlocal best
        if len(to) == len(a[0]):
            best = min(best, graphs.mapping_cost(a, b, to, loose))
            return
        for j in [*range(len(b[0])), None]:
            if j is None or j not in to:
                extend([*to, j])

    extend([])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_distance_is_the_least_of_all_mappings(seed):
    rng = random.Random(seed)
    make = lambda most: graphs.graph([" ".join([*rng.choices("abcd", k=rng.randint(1, 3)), *(f"@@{rng.randint(1, 5)}@@" for _ in range(rng.randint(0, 2)))]) for _ in range(rng.randint(1, most))])
    for _ in range(12):
        a, b = make(5), make(4)
        if max(len(a[0]), len(b[0])) > 6:
            continue
        for loose in (False, True):
            cost, proven = graphs.search(a, b, loose=loose)
            assert proven and cost == pytest.approx(_cheapest(a, b, loose))


def test_least_assignment():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)) * 5:
        c = np.round(rng.random((n, m)), 1)
        total, to = graphs.least_assignment(c)
        assert total == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)))
        assert len(set(to)) == n


# Hand-worked: identical, reversed (three steps, two), one step too many, none, too many nodes for the search.
UNION = ["Which union runs the Low Fell depot?", "Where is @@1@@ based?"]
MILL = ["Who built the mill?", "Which town bore @@1@@?", "What county holds @@2@@?"]
WORKED = [(UNION, UNION, 0.0, None), (MILL[::-1], MILL, 0.4, None), (UNION[::-1], UNION, 0.0, None), ([*UNION, "Which lake is near it?"], UNION, 0.25, None), ([], UNION, 1.0, None), (["zzz"] * 17, UNION, 18 / 17, "node_cap"), ([], [], 0.0, None)]


@pytest.mark.parametrize(("pred", "gold", "distance", "why"), WORKED)
def test_worked_distances(pred, gold, distance, why):
    got, reason = graphs.normalized(pred, gold)
    assert (reason, got) == (why, pytest.approx(distance))
    if pred == UNION[::-1]:  # a loop costs what its edits cost where it isn't paired with an edge
        assert graphs.normalized(pred, gold, loose=False)[0] == pytest.approx(2 / 3)


def test_policy():
    assert graphs.policy({"max_nodes": 3, "loose_loops": False}) == {"most": 3, "loose": False}
    assert graphs.normalized([*UNION, "x"], UNION, **graphs.policy({"max_nodes": 2, "loose_loops": True})) == (pytest.approx(0.25), "node_cap")
    for bad in ({}, {"max_nodes": 0, "loose_loops": True}, {"max_nodes": True, "loose_loops": True}, {"max_nodes": 2, "loose_loops": 1}, {"max_nodes": 2, "loose_loops": True, "seconds": 3}):
        with pytest.raises(ValueError):
            graphs.policy(bad)


def test_sixteen_nodes_are_searched_to_the_end():
    gold = ["Who founded the press?", "Where was @@1@@ born?", "When did @@2@@ join?", "Which river crosses @@2@@ and @@3@@?"]
    for name in graphs.SHAPES:
        assert graphs.normalized(graphs.shape(name, 16, gold), gold)[1] is None


def test_distance_is_at_most_the_bound():
    for name in graphs.SHAPES:
        a, b = graphs.graph(graphs.shape(name, 5, ["x", "y @@1@@"])), graphs.graph(["x", "y @@1@@", "z @@2@@"])
        assert graphs.edit_distance(a, b) <= graphs.positional_cost(a, b) + 1e-9


def test_jaccard_and_ladder(spark):
    e = F.array().cast("array<string>")
    ladder = metrics.score_ladder(F.lit(2), F.array(F.lit(1), F.lit(2), F.lit(3)), [(1, 5), (3, 3), (5, 1)])
    null = metrics.score_ladder(F.lit(None).cast("int"), F.array(F.lit(1)), [(1, 5)])
    bonus = metrics.unique_best_bonus({"a": F.lit(1.0), "b": F.lit(1.0), "c": F.lit(0.0)}, 2)
    row = spark.range(1).select(metrics.jaccard(e, e), metrics.jaccard(e, F.array(F.lit("x"))), ladder, null, bonus["a"], metrics.best_mode({"a": F.lit(1.0), "b": F.lit(1.0)})).first()
    assert tuple(row) == (1.0, 0.0, 3, 0, 0, "a")


def test_p_values():
    assert stats.binomial_two_sided(82, 133) == pytest.approx(0.0006164, abs=5e-8)
    assert stats.binomial_two_sided(12, 9) == pytest.approx(0.6636, abs=5e-5)
    assert stats.binomial_two_sided(0, 0) == 1 and stats.binomial_two_sided(900, 900) == 1
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5) and stats.t_two_sided(0.5, 2) == pytest.approx(2 / 3)
    assert stats.t_two_sided(1.2115, 599) == pytest.approx(0.2262, abs=1e-4)


def test_paired_t(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 1.0)], "k int, a double, b double")
    r = stats.paired_t(df, {"s": (F.col("a"), F.col("b")), "none": (F.col("a"), F.col("a"))}).orderBy("statistic").collect()
    assert (r[0].statistic, r[0].t, r[0].p_value) == ("none", None, None)
    assert (r[1].t, r[1].dof) == (1.0, 1) and r[1].p_value == pytest.approx(0.5)


def test_bootstrap_and_mcnemar(spark):
    df = spark.range(400).select(F.col("id").alias("k"), ((F.col("id") % 10) < 7).cast("double").alias("a"), ((F.col("id") % 10) < 4).cast("double").alias("b"))
    r = stats.bootstrap(df, "k", F.col("a") - F.col("b"), 300).first()
    assert r.mean_diff == pytest.approx(0.3) and r.ci_low < 0.3 < r.ci_high and r.ci_high - r.ci_low < 0.2 and r.significant
    assert stats.bootstrap(df, "k", F.col("a") - F.col("b"), 300).first() == r
    m = stats.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (m.only_a, m.only_b, m.significant, m.underpowered) == (120, 0, True, False)
    assert math.isclose(m.p_value, 2 * 0.5**120)


def test_masking(spark):
    ents = [(0, 3, "B-ORG", 0.9), (5, 24, "ORG", 0.8)]
    rows = [("Torquay Lifeboat Station was built on May 5, 1890 for 3 million.", ents), ("In 1990s, 12/3/1999", None), ("", None), (None, None), ("He saw 12", None), ("pi 3.1999 or 1999,5 or 3,1990s", None), ("a [NUM] b 7 , c", None)]
    df = spark.createDataFrame(rows, f"text string, ents {masking.ENTITIES}")
    got = [(r.m.typed, r.m.uniform) for r in df.select(masking.mask_both(F.col("text"), F.col("ents")).alias("m")).collect()]
    assert got == [
        ("[ORG] was built on [DATE] for [NUM].", "[MASK] was built on [MASK] for [MASK]."), ("In [DATE]", "In [MASK]"), ("", ""), ("", ""), ("He saw [NUM]", "He saw [MASK]"),
        ("pi 3.[DATE] or [DATE],5 or 3,[DATE]", "pi 3.[MASK] or [MASK],5 or 3,[MASK]"), ("a [NUM] b [NUM], c", "a [MASK] b [MASK], c"),
    ]


def test_recognizer_spans(spark):
    text = "Ann Lee met the senate in New-York, x"
    spans = [(0, 7, "PER", 0.5), (4, 7, "ORG", 0.99), (16, 22, "ORG", 0.9), (26, 29, "LOC", 0.4), (30, 34, "ORG", 0.9), (36, 37, "ORG", 0.9), (30, 99, "ORG", 1.0)]
    df = spark.createDataFrame([(text, spans)], f"text string, ents {masking.ENTITIES}")
    got = df.select(masking.settled(F.col("text"), F.col("ents"), masking.Rules()).alias("s")).first().s
    assert [(x.s, x.e, x.tag) for x in got] == [(0, 7, "[PERSON]"), (26, 34, "[ORG]")]  # longer wins; generic, lower-case, out of range go; inside a word


def test_recognizer_hook(spark):
    find = lambda texts: [[{"start": 0, "end": 3, "entity_group": "PER", "score": "0.5"}] if t.startswith("Bob") else [] for t in texts]
    df = spark.createDataFrame([("Bob ran 5 miles",), (None,), ("nobody",)], "text string")
    assert [r.m for r in df.select(masking.mask(F.col("text"), True, masking.recognize(find)("text")).alias("m")).collect()] == ["[PERSON] ran [NUM] miles", "", "nobody"]


def test_rules_from_json():
    assert masking.load_rules('{"gap": 2, "keep": ["x"]}').gap == 2
    for bad in ('{"nope": 1}', '{"uniform": "[WHAT]"}'):
        with pytest.raises(ValueError):
            masking.load_rules(bad)


def test_names_in_corpus(spark):
    names = spark.createDataFrame([("art",), ("???",), ("Glass House of Kings",), ("zebra",), ("",)], "name string")
    corpus = spark.createDataFrame([("The party ??? was",), ("glass house of kings",), (None,)], "text string")
    assert {r[0] for r in masking.names_in_corpus(names, corpus).collect()} == {"art", "???", "Glass House of Kings"}


def test_tokenize_keeps_punctuation(spark):
    assert spark.range(1).select(text.tokenize(F.lit(" A  b, c"))).first()[0] == ["a", "b,", "c"]


def test_labels_of_many_graphs_are_compared_once_and_together(monkeypatch):
    """The distances of a batch are those of pairs by themselves, and a pair of labels is compared once in a batch."""
    import random

    rng = random.Random(5)
    words = ["a", "b", "B", "c", "d", "@@1@@", "@@2@@"]
    steps = lambda: [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]
    pred, gold = [steps() for _ in range(150)], [steps() for _ in range(150)]
    labels = {x for s in (*pred[:30], *gold[:30]) for x in s}
    got = graphs.label_distances((x, y) for x in labels for y in labels)
    assert got == pytest.approx({(x, y): graphs.label_distance(x, y) for x in labels for y in labels})
    alone = [graphs.normalized(p, g) for p, g in zip(pred, gold)]
    filled = []
    real = graphs._alignments
    monkeypatch.setattr(graphs, "_alignments", lambda pairs: filled.append(len(pairs)) or real(pairs))
    together = [graphs._normalized(*x) for x in graphs.compared(pred, gold, graphs.MAX_NODES)]
    assert [x[0] for x in together] == pytest.approx([x[0] for x in alone]) and [x[1] for x in together] == [x[1] for x in alone]
    filled.clear()
    list(graphs.compared([["a b", "b a"]] * graphs.TOGETHER, [["b c"]] * graphs.TOGETHER))
    assert filled == [2]
