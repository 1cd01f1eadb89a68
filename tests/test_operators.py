import pytest
from pyspark.sql import functions as F

from hopframe.functions import plans
from hopframe.operators import aggregate, checks, joins, kg, models, results, sampling, topk
from hopframe.plans import evaluation, sweep
from hopframe.sources import readers, sinks

TRIPLES = """Glass Harbor|directed_by|Ada Mireles
Glass Harbor|written_by|Bo Fenwick
Glass Harbor|starred_actors|Cyril Danner
Winter Marbles|directed_by|Ada Mireles
Winter Marbles|starred_actors|Dara Volkov

The Tin Compass|directed_by|Ada Mireles
The Tin Compass|starred_actors|Cyril Danner"""


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("kb") / "kb.txt"
    p.write_text(TRIPLES)
    return kg.parse_triples(readers.lines(spark, str(p))).cache()


def test_triples(spark, triples, tmp_path):
    ids = {r.name: r.id for r in kg.entity_ids(triples).collect()}
    assert ids["Glass Harbor"] == 0 and ids["Ada Mireles"] == 1 and ids["Winter Marbles"] == 4 and sorted(ids.values()) == list(range(len(ids)))
    bad = tmp_path / "bad.txt"
    bad.write_text("a|b\n")
    with pytest.raises(Exception, match="malformed"):
        kg.parse_triples(readers.lines(spark, str(bad))).collect()


def test_execute(spark, triples):
    texts = [("a", "1. Who directed Glass Harbor?\n2. What other movies were directed by [#1]?"), ("b", "Who directed Nothing?"), ("c", "Who starred in [#2]?"), ("d", "Who directed Glass Harbor?\nWhat other movies were directed by [#1]?\nWho starred in [#2]?")]
    compiled = spark.createDataFrame(texts, "item_id string, t string").select("item_id", plans.compile_steps(F.col("t")).alias("ops"))
    answers, status = kg.execute(compiled, triples)
    got = {}
    for r in answers.collect():
        got.setdefault(r.item_id, set()).add(r.answer)
    assert got == {"a": {"Glass Harbor", "Winter Marbles", "The Tin Compass"}, "d": {"Cyril Danner", "Dara Volkov"}}
    assert {(r.item_id, r.status, r.reason) for r in status.collect()} == {("a", "executed", None), ("b", "exec_fail", "entity_not_in_kb"), ("c", "exec_fail", "bad_reference_or_plan"), ("d", "executed", None)}
    gold = spark.createDataFrame([("a", ["Glass Harbor", "Winter Marbles", "The Tin Compass"]), ("b", []), ("c", ["x"])], "item_id string, gold array<string>")
    assert {r.item_id: (r.jaccard, r.exact) for r in kg.score_answers(answers, gold).collect()} == {"a": (1, True), "b": (1, True), "c": (0, False)}
    assert {(r.status, r.n) for r in evaluation.coverage(status).groupBy("status").agg(F.sum("n").alias("n")).collect()} == {("executed", 2), ("exec_fail", 2)}


def test_empty_plans(spark, triples):
    none = spark.createDataFrame([], "item_id string, ops array<struct<op:string,relation:string,entity:string,ref_step:int>>")
    answers, status = kg.execute(none, triples)
    assert answers.count() == 0 and status.count() == 0


def test_joins(spark):
    gold = spark.createDataFrame([("Who?", "x", 0), ("who? ", "y", 1), ("What", "z", 2)], "question string, a string, o int")
    pred = spark.createDataFrame([(" WHO?",), ("when",)], "question string")
    got = {r.question: (r.gold_a, r.gold_found) for r in joins.by_question(pred, gold, ordinal="o").collect()}
    assert got == {" WHO?": ("y", True), "when": (None, False)}
    items = spark.createDataFrame([("1", "q1", "A", 0), ("1", "q2", "B", 1), ("2", "q1", "C", 2)], "id string, question string, v string, o int")
    rows = spark.createDataFrame([("1", "zz"), ("9", "Q1"), ("8", "none")], "id string, question string")
    assert {r.id: r.match and r.match.v for r in joins.with_fallback(rows, items, "id", "question", "o").collect()} == {"1": "B", "9": "A", "8": None}
    fill = joins.fill_empty(spark.createDataFrame([("1", ""), ("2", "x"), ("3", None), (None, "")], "id string, f string"), spark.createDataFrame([("1", "new")], "id string, f string"), "id", "f")
    assert {(r.id, r.f, r.status) for r in fill.collect()} == {("1", "new", "enriched"), ("2", "x", "pre_existing"), ("3", None, "unknown"), (None, None, "no_id")}
    with pytest.raises(checks.ConstraintError):
        joins.complete(items, rows, "id")
    one = joins.concat_first_wins([items.select("id", "v", "o"), spark.createDataFrame([("3", "D", 0), ("1", "E", 1)], "id string, v string, o int")], "id", "o")
    assert [(r.id, r.v, r["index"]) for r in one.orderBy("index").collect()] == [("1", "A", 0), ("2", "C", 1), ("3", "D", 2)]
    merged = joins.merge_intervals(spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("a", 6, 7), ("b", 1, 1)], "g string, s int, e int"), "g", "s", "e")
    assert {tuple(r) for r in merged.collect()} == {("a", 0, 4, 2), ("a", 6, 7, 1), ("b", 1, 1, 1)}


def test_checks(spark):
    df = spark.createDataFrame([("1", 1.0), ("1", None), (None, float("nan"))], "id string, v double")
    with pytest.raises(checks.ConstraintError, match="v: 2 rows"):
        checks.require(df, {"v": checks.usable_number(F.col("v"))}, F.col("id"))
    checks.require(df.limit(0), {"v": F.lit(False)}, F.col("id"))
    with pytest.raises(checks.ConstraintError):
        checks.require_unique(df, "id")
    with pytest.raises(checks.ConstraintError):
        checks.require_disjoint(df, df, "id")
    with pytest.raises(checks.ConstraintError, match="nothing"):
        checks.require_disjoint(df, df.limit(0), "id")
    checks.require_same_keys(df.where("id is not null"), df.where("id is not null"), "id")
    with pytest.raises(checks.ConstraintError):
        checks.require_counts(df, "id", {"1": 1})
    with pytest.raises(checks.ConstraintError):
        checks.require_witness(df.where("v = 1"), df.where("id = '1' and v is null"), "id", ["v"])
    assert checks.available(df, df.where("v is not null"), ["id", "v", "zz"]) == []


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "e int, p int")
    assert {r.e: (r.total, r.correct, r.recall) for r in aggregate.accuracy_by_class(df, "e", "p", [1, 2, 3]).collect()} == {1: (2, 1, 0.5), 2: (1, 1, 1.0), 3: (0, 0, 0.0)}
    one = aggregate.sweep(spark.createDataFrame([("a", 1.0)], "k string, m double"), ["k"], ["m"]).first()
    assert (one["mean"], one["std"], one["n"]) == (1.0, 0.0, 1)
    row = df.where("e > 5").agg(aggregate.micro(F.col("e"), F.col("p"))).first()[0]
    assert row == 1.0
    assert aggregate.truthy(F.lit(0), F.lit(3)) is not None and spark.range(1).select(aggregate.truthy(F.lit(0), F.lit(3))).first()[0] == 3
    with pytest.raises(ValueError):
        aggregate.multi_label(spark.createDataFrame([(["zz"],)], "f array<string>"), "f", ["a"])


def test_samples(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    a = [r.k for r in sampling.exact(df, "k", 10, "s").collect()]
    assert len(set(a)) == 10 and a == [r.k for r in sampling.exact(df.repartition(7), "k", 10, "s").collect()]
    with pytest.raises(ValueError):
        sampling.exact(df, "k", 101)
    assert sorted(r["count"] for r in sampling.balanced(df, "g", "k", 10, [0, 1, 2]).groupBy("g").count().collect()) == [3, 3, 4]
    with pytest.raises(ValueError):
        sampling.balanced(df, "g", "k", 200, [0, 1, 2])
    assert sampling.water_fill({"a": 2, "b": 50, "c": 50}, 22) == {"a": 2, "b": 10, "c": 10}
    assert sampling.capped(df, "g", "k", 30).count() == 30
    f = sampling.folds(df, "g", "k", 5).groupBy("g", "fold").count().collect()
    assert {r["count"] for r in f} <= {6, 7} and len(f) == 15
    v = df.withColumn("v", F.array((F.col("g") * 10 + F.rand(1)).cast("float"), F.rand(2).cast("float")))
    r = sampling.representatives(v, "v", "k", 5, 2).collect()
    assert len({x.k for x in r}) == 5 and len({x.cluster for x in r}) == 3


def test_topk(spark):
    rows = [(i, [float(i % 4), 1.0], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>, b int")
    got = {}
    for r in topk.similar(df, df, "id", "v", 3, "b").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.pool_id, r.score))
    for i, v, b in rows:
        want = sorted(((-(v[0] * w[0] + 1), j) for j, w, c in rows if j != i and c == b))[:3]
        assert [(x[1], x[2]) for x in sorted(got[i])] == [(j, -s) for s, j in want]
    ranked = topk.similar(df, df, "id", "v", 3).join(df.select(F.col("id").alias("pool_id"), F.col("b").alias("label")), "pool_id")
    assert topk.vote(ranked, "label", 3).count() == 12
    n = F.array(F.struct(F.lit("1").alias("pool_id"), F.lit("x").alias("pool_question")), F.struct(F.lit("2").alias("pool_id"), F.lit("Q ").alias("pool_question")), F.struct(F.lit("3").alias("pool_id"), F.lit("z").alias("pool_question")))
    assert [x.pool_id for x in spark.range(1).select(topk.without_self(n, F.lit("1"), F.lit("q"), 2)).first()[0]] == ["3"]


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    rows = [(i, [float(i * 7 % 11), 1.0], None if i % 5 == 0 else "hot" if i % 3 else "cold") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, b string")
    queries = df.where("id % 2 = 0").union(spark.createDataFrame([(99, [1.0, 1.0], "alone")], df.schema))
    got = {}
    for r in topk.similar(queries, df, "id", "v", 4, "b").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.pool_id, r.score))
    for i, v, b in rows[::2]:
        want = sorted((-(v[0] * w[0] + 1), j) for j, w, c in rows if j != i and c == b)[:4]
        assert [(x[1], x[2]) for x in sorted(got.pop(i))] == [(j, -s) for s, j in want]
    assert not got
    assert topk.similar(df.limit(0), df, "id", "v", 4).count() == 0


def test_question_files(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    a, b = d / "x_questions_1.jsonl", d / "x_questions_all.jsonl"
    a.write_text('{"id": "2hop__a", "question": " Who? ", "n": 1}\n\n{"id": "3hop__b", "question": "Where?"}\n')
    b.write_text('{"id": "nohop", "question": 5}\n')
    (d / "q.txt").write_text("One?\n\n Two? \n")
    got = readers.retrieval(spark, str(a), "id").orderBy("line_no").collect()
    assert [(r.query_id, r.question, r.expected_hop) for r in got] == [("2hop__a", "Who?", 2), ("3hop__b", "Where?", 3)]
    assert [r.question for r in readers.questions(spark, str(d / "q.txt"), "lines").orderBy("line_no").collect()] == ["One?", "Two?"]
    with pytest.raises(Exception, match="no usable question"):
        readers.questions(spark, str(b), "jsonl").collect()
    with pytest.raises(readers.ConfigError):
        readers.questions(spark, str(a), "csv")
    (d / "bad.jsonl").write_text('{"id": "x", "question": "Q"}\n')
    with pytest.raises(Exception, match="no hop"):
        readers.retrieval(spark, str(d / "bad.jsonl"), "id").collect()
    names = lambda x: [p.rsplit("/", 1)[1] for p in x]
    assert names(readers.files(spark, str(tmp_path), "**/x_questions_*.jsonl", "_questions_all.jsonl")) == ["x_questions_1.jsonl"]
    assert names(readers.files(spark, str(tmp_path), "in/deep/x_*.jsonl")) == ["x_questions_1.jsonl", "x_questions_all.jsonl"]
    assert readers.files(spark, str(tmp_path), "in/none_*") == []
    with pytest.raises(readers.ConfigError):
        readers.files(spark, str(tmp_path), "**/none_*", "_all.jsonl")


def test_joined_sink_probe_and_groups(spark, tmp_path):
    results = spark.createDataFrame([("a", 'say "x", y'), ("b", "q")], "query_id string, question string")
    gold = spark.createDataFrame([("a", ["s1", "s2"])], "query_id string, steps array<string>")
    sinks.joined_csv(results, gold, str(tmp_path / "csv"), "query_id", "steps")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("query_id").collect()
    assert [tuple(r) for r in back] == [("a", 'say "x", y', "s1 | s2"), ("b", "q", None)]
    spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>").write.parquet(str(tmp_path / "v"))
    assert sinks.probe(spark, str(tmp_path / "v"), "v", 2, 2).count() == 2
    assert [sinks.probe(spark, str(tmp_path / p), "v", n, d) for p, n, d in (("v", 3, 2), ("v", 2, 3), ("none", 2, 2))] == [None] * 3
    arms = spark.createDataFrame([("r", '{"a": 1, "b": "x"}'), ("p", '{"b": "x", "a": 1}'), ("o", '{"a": 2}'), ("n", None), ("e", "{}")], "name string, d string")
    assert sorted(r.names for r in aggregate.same_definition(arms, "name", "d").collect()) == [["o"], ["p", "r"]]
    rows = spark.createDataFrame([(1, " Q "), (2, "Q"), (None, "Q"), (1, None)], "hop_count int, question string")
    g = spark.createDataFrame([(1, "Q", ["x"])], "hop_count int, question string, answers array<string>")
    assert sorted(str(r.answers) for r in joins.gold_for(rows, g).collect()) == ["None", "None", "None", "['x']"]


def test_step_execution(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def ask(prompts):
            if len(prompts) > 1 and any("boom" in p for p in prompts):
                raise RuntimeError("whole batch")
            if "boom" in prompts[0]:
                raise RuntimeError("boom")
            seen.add(len(prompts))
            return [p.rstrip("?") for p in prompts]

        return ask

    items = spark.createDataFrame([(1, ["Who runs it?", "Where is [#1]?", "What of [#9]"]), (2, ["Who runs it?", "boom", "after [#2]", "?"]), (2, ["Who runs it?"]), (3, []), (4, None)], "item_id int, steps array<string>")
    rows = {}
    for r in models.run_steps(items, models.reader(load)).collect():
        rows.setdefault((r.item_id, r.step), []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 1): 2, (2, 2): 1, (2, 3): 1, (2, 4): 1}
    one = lambda *k: rows[k][0]
    assert one(1, 2).prompt == "Where is Who runs it?" and one(1, 2).flags == [] and one(1, 3).flags == ["broken_reference"]
    assert (one(2, 2).error, one(2, 2).flags) == ("boom", ["generation_error"]) and one(2, 3).prompt == "after [#2]" and one(2, 4).flags == ["empty_answer"]
    assert seen.value == 5  # equal prompts of a round are asked once
    assert models.run_steps(items.limit(0), models.reader(load)).collect() == []


def test_hits_of_queries_without_neighbours(spark):
    ranked = spark.createDataFrame([(1, 1, "a", "a"), (1, 2, "b", "a"), (2, 1, "b", "a"), (2, 4, "a", "a")], "query_id int, rank int, label string, own string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "query_id int, own string")
    hit = F.col("label") == F.col("own")
    assert [tuple(r) for r in results.hit_rate(ranked, hit, 3, "own", asked.select("query_id", "own")).collect()] == [("a", 3, 1, 1 / 3)]
    assert tuple(results.hit_rate(ranked, hit, 3).first()) == (2, 1, 0.5)


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [2.0]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.query_id, r.pool_id) for r in topk.similar(df, df, "id", "v", 3).collect())
    assert got == [(1, 2), (2, 1), (5, 6), (6, 5)]


def test_embedding_hook(spark):
    v = spark.createDataFrame([("a b",), (None,)], "t string").select(models.embed_udf()("t").alias("v")).collect()
    assert len(v[0].v) == 64 and abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and sum(map(abs, v[1].v)) == 0
    assert models.needs_prefix("intfloat/e5-small-v2") and not models.needs_prefix("x/me5y")


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1","question":"q"}\n\n{"id":"2"}\n{broken\n{"id":null,"question":null}\n')
    kept, bad = readers.jsonl_permissive(spark, str(p), "id string, question string", ["id", "question"])
    assert [(r.line_no, r.id) for r in kept.orderBy("line_no").collect()] == [(0, "1"), (4, None)] and bad.first().bad_rows == 2
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), "id string, question string").collect()
    q, a = tmp_path / "q.txt", tmp_path / "a.txt"
    q.write_text("one\n\ntwo\n")
    a.write_text("x|y|x\nz\n")
    assert [(r.question, r.answers) for r in readers.zipped(spark, str(q), str(a)).orderBy("at").collect()] == [("one", ["x", "y"]), ("two", ["z"])]
    assert readers.text_questions(spark, str(tmp_path / "none.txt")).count() == 0
    j = tmp_path / "pool.json"
    j.write_text('{"2hop": [{"question": "b"}], "1hop": [{"question": "a"}], "x": 1}')
    assert [(r.hop_key, r.question) for r in readers.pool(spark, str(j), ["1hop", "2hop"], "struct<question:string>").collect()] == [("1hop", "a"), ("2hop", "b")]
    c = tmp_path / "runs.csv"
    c.write_text("size,trial,m\n10,x,0.5\nbad,1,1\n20,2,\n")
    assert [(r.size, r.trial, r.m) for r in readers.csv_runs(spark, str(c), ["m"]).collect()] == [(10, 0, 0.5), (20, 2, None)]
    out = str(tmp_path / "table")
    df = spark.createDataFrame([("k1", "dev", 1.0)], "key string, dev string, v double")
    assert sinks.append_guarded(df, out, "key", ["dev"]) == 1 and sinks.append_guarded(df, out, "key", ["dev"]) == 0
    with pytest.raises(ValueError):
        sinks.append_guarded(df.withColumn("dev", F.lit("other")), out, "key", ["dev"])
    with pytest.raises(ValueError):
        sinks.append_guarded(df.drop("v"), out, "key", ["dev"])
    with pytest.raises(readers.ConfigError):
        readers.Config({"a": {"b": 1}}).require("a.c")
    assert readers.Config({"a": {"b": 1}}).require("a.b") == 1


def test_sweep_and_compare(spark):
    cells = sweep.grid([4, 6], ["imbalanced", "balanced"])
    assert [c.key for c in sweep.only(cells, "size4")] == ["size4_imbalanced_trial0", "size4_balanced_trial0"]
    df = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("g"))
    assert {r.cell: r["count"] for r in sweep.pools(df, cells, "g", "k", [0, 1, 2]).groupBy("cell").count().collect()} == {"size4_imbalanced_trial0": 4, "size4_balanced_trial0": 4, "size6_imbalanced_trial0": 6, "size6_balanced_trial0": 6}
    a = spark.range(50).select("id", F.lit(1.0).alias("exact_match"))
    b = spark.range(50).select("id", (F.col("id") % 2).cast("double").alias("exact_match"))
    out = evaluation.compare(a, b, "id", ["exact_match"], 100)
    assert out["bootstrap"].first().favours == "a" and out["mcnemar"].first().only_a == 25 and out["t_test"].first().n == 50


def test_streaming_scores(spark, tmp_path):
    from hopframe.streaming import incremental

    src = tmp_path / "in"
    spark.createDataFrame([("Who?", ["a b"]), ("none", ["x"])], "question string, steps array<string>").write.json(str(src))
    gold = spark.createDataFrame([("who?", ["a b"])], "question string, steps array<string>")
    stream = spark.readStream.schema("question string, steps array<string>").json(str(src))
    q = incremental.score_stream(stream, gold).select("question", "exact_match").writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("scored").collect()] == [("Who?", 1.0)]


def test_schemas_of_any_dataset(spark):
    from hopframe.sources import schemas

    assert spark.createDataFrame([], schemas.enriched("wiki")).columns[-1] == "few_shot_decomposition_wiki"
    lists = spark.createDataFrame([], schemas.retrieval("wiki")).schema["typed_top_k"].dataType.elementType
    assert "pool_few_shot_decomposition_wiki" in lists.names and lists.names[-1] == "score"


def test_batches_of_long_texts_are_small(spark, tmp_path):
    """Queries of whole texts get batches of about a megabyte, not of ten thousand rows."""
    from hopframe import queries, runtime

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256m")
    spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        assert runtime.ready(queries.embed_texts)(spark, str(tmp_path)).count() == 300
        size = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "long")  # rows of the batch
        most = spark.read.parquet(f"{tmp_path}/documents.parquet").select(size("text").alias("k")).agg(F.max("k")).first()[0]
        assert most <= 2 * runtime.BATCH_BYTES / 22_000 and int(spark.conf.get(setting)) == runtime.BATCH_BYTES
    finally:
        spark.conf.set(setting, before)


def test_steps_without_references_are_not_looked_through(spark, monkeypatch):
    from hopframe.functions import plans
    from hopframe.operators import models

    real = plans.substitute
    monkeypatch.setattr(plans, "substitute", lambda text, answers: real(F.when(F.contains(text, F.lit("#")), text).otherwise(F.raise_error(F.lit("refers to nothing"))), answers))
    items = spark.createDataFrame([(1, ["who", "where is [#1] of #9", "[#1"]), (2, ["what"])], "item_id long, steps array<string>")
    got = models.run_steps(items, lambda p: p.select("prompt", F.upper("prompt").alias("answer"), F.lit(None).cast("string").alias("error")))
    rows = {(r.item_id, r.step): (r.prompt, r.unresolved) for r in got.collect()}
    assert rows == {(1, 1): ("who", []), (1, 2): ("where is WHO of #9", [9]), (1, 3): ("[#1", [1]), (2, 1): ("what", [])}
