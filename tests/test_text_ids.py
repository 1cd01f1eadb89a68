import pytest
from pyspark.sql import functions as F

from hopframe.functions import ids, plans, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("2hop__a", ("2hop", 2, 2, 2)), ("3hop1__b_2", ("3hop1", 3, 3, 3)), ("x", ("unknown", -1, None, None)), ("4hop", ("unknown", -1, 4, None)), ("", ("unknown", -1, None, None)), (None, ("unknown", -1, None, None)), ("12hop__z", ("12hop", 1, 12, 12))],
)
def test_id_grammars(spark, value, expected):
    c = F.col("v")
    got = spark.createDataFrame([(value,)], "v string").select(ids.stratum(c), ids.coarse_hop(c), ids.hop(c), ids.hop_strict(c)).first()
    assert tuple(got) == expected


def test_trimmed_hop_and_bucket(spark):
    c = F.col("v")
    got = spark.createDataFrame([(" 2hop__a",)], "v string").select(ids.hop(c), ids.hop_trimmed(c), ids.bucket(F.trim(c), ["2hop"])).first()
    assert tuple(got) == (None, 2, "2hop")


@pytest.mark.parametrize(("s", "slug"), [("2hop", "2_hop"), ("3hop1", "3_hop_1"), ("a b-c", "a_b_c")])
def test_slugs(spark, s, slug):
    assert one(spark, ids.questions_slug(F.col("v")), v=s) == slug


def test_model_names(spark):
    assert one(spark, ids.model_slug(F.col("v")), v="org/some.model-name-that-is-long") == "some_model-name-that"
    assert one(spark, ids.model_short_name(F.col("v"), ["-Instruct", "-v1"]), v="org/m-v1-Instruct") == "m"


@pytest.mark.parametrize(
    ("raw", "steps"),
    [("1. a\n2. b", ["a", "b"]), ("  \n3.\n x ", ["x"]), ("", []), ("a\x1cb\x85c\u2028d\r\ne", ["a", "b", "c", "d", "e"]), ("10.5 is a number", ["5 is a number"])],
)
def test_split_steps(spark, raw, steps):
    assert one(spark, text.split_steps(F.col("v")), v=raw) == steps


def test_normalizers(spark):
    assert one(spark, text.normalize_step(F.col("v")), v=" Who ?") == "who "
    assert one(spark, text.normalize_step(F.col("v")), v="Na\u00efve [#1]!") == "na\u00efve #1"
    assert one(spark, text.normalize_question(F.col("v")), v="  A\t b\u00a0C ") == "a b c"
    assert one(spark, text.normalize_answer(F.col("v")), v="The  Harbour-Union, a union!") == "harbourunion union"


@pytest.mark.parametrize(("raw", "n"), [("a\nb", 1), ("a\nb\n", 2), ("\n\n", 0), ("<think>x\ny\n", 0), ("<think>x</think>a\nb\n", 2)])
def test_completed_lines(spark, raw, n):
    assert one(spark, text.completed_step_count(F.col("v")), v=raw) == n


def test_generation_cleanup(spark):
    assert one(spark, text.post_process(F.col("v"), True, ["Q:"]), v="<think>no\n</think> yes Q: more") == "yes"
    assert one(spark, text.trim_to_steps(F.col("v"), 2), v="1. a\n2.\n3. b\n4. c") == "1. a\n3. b"
    got = spark.createDataFrame([("\n Answer: the long one\nx",)], "v string").select(text.clean_answer(F.col("v"), True, ["answer:"], 8).alias("x")).first()[0]
    assert tuple(got) == ("the long", True)


def test_break_steps(spark):
    assert one(spark, text.break_string(F.col("v")), v=[" a  b ", "", "c #1 [#2]"]) == "a b @@SEP@@ c @@1@@ [@@2@@]"


def test_refine_and_completion(spark):
    assert one(spark, text.refine_line(F.col("v")), v="who acted in [Glass Harbor]\tx|y") == "who acted in Glass Harbor"
    assert one(spark, text.format_completion(F.col("v")), v=["a", "b #1", "c [#2]"]) == "1. a\n2. b [#1]\n3. c [#2]"


@pytest.mark.parametrize(
    ("step", "expected"),
    [
        ("1. Who directed Glass Harbor?", ("VALUES_OF_MOVIE", "directed_by", "Glass Harbor", None, None)),
        ("What other movies were directed by [#1]?", ("MOVIES_WITH_VALUE", "directed_by", None, 1, None)),
        ("Who starred in [#2]?", ("PROJECT_VALUES_FROM_MOVIES", "starred_actors", None, 2, None)),
        ("What films did Cyril Danner star in?", ("MOVIES_WITH_VALUE", "starred_actors", "Cyril Danner", None, None)),
        ("What movies did Bo Fenwick write?", (None, None, None, None, "cannot_infer_relation")),
        ("What movies did Ada Mireles direct?", ("MOVIES_WITH_VALUE", "directed_by", "Ada Mireles", None, None)),
        ("Which genre?", (None, None, None, None, "unsupported_step_template")),
        ("Who is the director of Winter Marbles?", ("VALUES_OF_MOVIE", "directed_by", "Winter Marbles", None, None)),
    ],
)
def test_compile(spark, step, expected):
    got = spark.createDataFrame([(step,)], "v string").select(plans.step_op(text.normalize_step_line(F.col("v"))).alias("o")).first()[0]
    assert tuple(got) == expected


@pytest.mark.parametrize(
    ("raw", "answers", "expected"),
    [
        ("Who leads [#1]?", ["Harbour Union"], ("Who leads Harbour Union?", [1], [])),
        ("A #2 and [#1", ["x", "#1"], ("A #1 and [#1", [2], [1])),
        ("[#3] [#1]", [" "], ("[#3] [#1]", [], [3, 1])),
        ("C#1 ##1 #1a", ["x"], ("C#1 ##1 #1a", [], [])),
    ],
)
def test_substitution(spark, raw, answers, expected):
    got = spark.createDataFrame([(raw, answers)], "t string, a array<string>").select(plans.substitute(F.col("t"), F.col("a")).alias("s")).first()[0]
    assert tuple(got) == expected


@pytest.mark.parametrize(("said", "expected"), [("A: 3", (3, True)), ("<think>1</think>it is two hop", (2, True)), ("none", (1, False)), ("9 or 2", (2, True))])
def test_parse_hop(spark, said, expected):
    got = spark.createDataFrame([(said,)], "v string").select(plans.parse_hop(F.col("v"), [1, 2, 3], 1, r"A:\s*(\d)").alias("x")).first()[0]
    assert tuple(got) == expected


def test_templates(spark):
    fine = ["- The number of steps MUST equal the hop count.", "Hop count: {hop_count}", "Hop count: 3", "Use 2-hop style"]
    mixed = ["- The number of steps MUST equal the hop count. Output ONLY the steps.", "- Use the hop count and output ONLY the steps.", "Hop count: {hop_count}, and do NOT explain", "MUST equal the hop count, and output ONLY the steps"]
    rows = spark.createDataFrame([(t, t in mixed) for t in fine + mixed], "t string, mixed boolean")
    for r in rows.select("t", "mixed", plans.mixed_hop_line_column(F.col("t")).alias("m")).collect():
        assert r.m == ([r.t] if r.mixed else [])
    pairs = [
        ("a\r\nHop count: {hop_count}\r\nUse 2-hop style\r\n", "a\r\nUse 2-hop style\r\n", "same"), ("a\nhop-count: 3\nb\n", "a\nb\n", "same"), ("a\nhop-count: 3\nb\n", "a\nb\nc\n", "different"),
        ("Use {question}\nIt has {hop_count} hops\nEnd", "Use {question}\nEnd", "same"), ("Answer shortly. Use {hop_count} steps.", "", "mixed"), (None, "x", "missing"), ("x", None, "missing"),
    ]
    got = spark.createDataFrame(pairs, "a string, b string, want string").select("want", plans.unguided_status(F.col("a"), F.col("b")).alias("is")).collect()
    assert all(r["is"] == r.want for r in got)


def test_reader_prompts(spark):
    def said(template, style, **slots):
        return [tuple(x) for x in spark.range(1).select(plans.reader_prompt(template, style, "<<>>", **slots).alias("m")).first()[0]]

    slots = {"context": F.lit("C"), "question": F.lit("why")}
    whole = "Use {context} well<<>>{context}\nQ: {question}"
    assert said(whole, "chat", **slots) == [("system", "Use {context} well"), ("user", "C\nQ: why")]
    assert said(whole, "plain", **slots) == [("user", "Use C well\n\nC\nQ: why")]
    assert said("{context} {question}", "plain", **slots) == [("user", "C why")]
    for template, style in (("{context} {question}", "chat"), ("{context}<<>>{question}", "chat"), ("{context}<<>>x", "plain"), (whole, "other")):
        with pytest.raises(ValueError):
            said(template, style, **slots)


def test_chat_fills_both_halves(spark):
    got = spark.range(1).select(plans.chat("Be good<<>>Q: {question}", "<<>>", question=F.lit("why")).alias("m")).first()[0]
    assert [tuple(x) for x in got] == [("system", "Be good"), ("user", "Q: why")]
