"""Queries of row-level functions and projections over the driver's tables, each with the equivalent DuckDB SQL.

Inputs that the tables lack (step lists, responses, file names) are made from whole tables' keys, the same way on both
sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import ids, metrics, plans, text
from .operators import checks, joins, results, stats, topk, training
from .plans import evaluation
from .queries import ALL_SQL, NSTEP, SAME_SQL, SQL, STEPS, TURNS, labelled, query, r6, ranked, table, turns


def key():
    return F.col("o_orderkey")


def key_text():
    return key().cast("string")


def orders(spark, sf, **columns):
    return table(spark, sf, "orders").select("o_orderkey", *(c.alias(k) for k, c in columns.items()))


def pick(*values):
    """values[o_orderkey % n]; strings and Columns."""
    out = values[-1] if not isinstance(values[-1], str) else F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key() % len(values) == i, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
    return out


def pick_sql(*values: str) -> str:
    """The same of SQL expressions."""
    return f"(case o_orderkey % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end)"


def quoted(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'" for v in values]


# ---- ids ----

NAMES = ["questions_2_hop_chunk_07.jsonl", "questions_13_hop.txt", "part_clean.csv", "chunk_9.clean.json", "notes"]
MODELS = ["org/Some-Model-7B-v0.1-instruct", "plain.model-name", "a/b/c.d.e-4bit"]


@query(f"""
with n as (select o_orderkey, {pick_sql(*quoted(*NAMES))} as f, {pick_sql(*quoted(*MODELS))} as m from orders), b as (select *, regexp_replace(f, '\\.[^.]*$', '') as stem, split_part(m, '/', -1) as last from n)
select o_orderkey, try_cast(nullif(regexp_extract(f, 'questions_([0-9]+)_hop', 1), '') as bigint) as hop, coalesce(nullif(regexp_extract(f, 'chunk_([0-9]+)', 1), ''), stem) as chunk, regexp_replace(stem, '_clean$', '') as unclean,
regexp_replace(f, '[^A-Za-z0-9_]', '_', 'g') as slug, substr(replace(last, '.', '_'), 1, 20) as model, case when ends_with(last, '-instruct') then substr(last, 1, length(last) - 9) when ends_with(last, '-4bit') then substr(last, 1, length(last) - 5) else last end as short_name,
'size' || (o_orderkey % 7) || '_' || (case when o_orderkey % 2 = 0 then 'balanced' else 'imbalanced' end) || '_trial' || (o_orderkey % 3) as cell,
'size' || (o_orderkey % 7) || '_' || (case when o_orderkey % 2 = 0 then 'balanced' else 'imbalanced' end) || '_trial' || (o_orderkey % 3) || '__v' || (o_orderkey % 2) || '__' || o_orderstatus as run_key
from b join (select o_orderkey as k, o_orderstatus from orders) on k = o_orderkey
""")
def names_and_keys(spark, sf):
    """Hops, chunks and slugs of file and model names, keys of cells and runs (key())."""
    f, m = pick(*NAMES), pick(*MODELS)
    stem = F.regexp_replace(f, r"\.[^.]*$", "")
    size, balance, trial = (key() % 7).cast("int"), F.when(key() % 2 == 0, "balanced").otherwise("imbalanced"), (key() % 3).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", ids.hop_of_file(f).cast("long").alias("hop"), ids.chunk_of_file(f).alias("chunk"), ids.strip_clean(stem).alias("unclean"), ids.sanitize(f).alias("slug"), ids.model_slug(m).alias("model"),
        ids.model_short_name(m, ["-4bit", "-instruct"]).alias("short_name"), ids.cell_key(size, balance, trial).alias("cell"), ids.run_key(size, balance, trial, F.concat(F.lit("v"), (key() % 2).cast("string")), F.col("o_orderstatus")).alias("run_key"),
    )


@query("""
select o_orderkey, cast(case when o_orderkey % 3 = 0 then o_custkey % 5 - 1 end as bigint) as given, cast(case when o_orderkey % 3 = 0 and o_custkey % 5 - 1 >= 0 then o_custkey % 5 - 1 when o_orderkey % 2 = 0 then o_orderkey % 9 else -1 end as bigint) as hop,
case when o_orderkey % 4 = 0 then 'q' || o_orderkey when o_orderkey % 4 = 1 then 'i' || o_orderkey else 'what is ' || o_orderkey end as first_id from orders
""")
def first_of_several(spark, sf):
    """A hop count or the id's digit; the first id that isn't blank, else the normalized question (C, key())."""
    given = F.when(key() % 3 == 0, F.col("o_custkey") % 5 - 1)
    rid = F.when(key() % 2 == 0, F.concat((key() % 9).cast("string"), F.lit("hop__x"))).otherwise("none")
    blank = F.lit("  ")
    qid, own = F.when(key() % 4 == 0, F.concat(F.lit(" q"), key_text())).otherwise(blank), F.when(key() % 4 <= 1, F.concat(F.lit("i"), key_text())).when(key() % 4 == 2, blank)
    return table(spark, sf, "orders").select("o_orderkey", given.cast("long").alias("given"), ids.coarse_hop_of(given, rid).cast("long").alias("hop"), ids.first_id(qid, own, F.concat(F.lit(" What  IS "), key_text())).alias("first_id"))


# ---- text ----

RESPONSES = ["1. Who?\n2. Where is #1", "<think>no end\n1. A", "<think>x</think>\n1. A\n\n2. B\n", "plain", "1. \n2. Two [#1]\nSTOP 3. Three\n", "a\tb [c] d"]
UNTHOUGHT = "split_part(regexp_replace(t, '(?s)<think>.*?</think>\\s*', '', 'g'), 'STOP', 1)"


@query(f"""
with r as (select o_orderkey, {pick_sql(*quoted(*RESPONSES))} as t from orders), a as (select *, {UNTHOUGHT} as d, (length(t) - length(replace(t, '<think>', ''))) / 7 > (length(t) - length(replace(t, '</think>', ''))) / 8 as open from r)
select o_orderkey, open as think_open, regexp_replace(d, '^\\s+|\\s+$', '', 'g') as processed, cast(case when open or not contains(d, chr(10)) then 0 else len({STEPS.format("regexp_extract(d, '(?s)^(.*)\\n', 1)")}) end as bigint) as n_finished,
array_to_string(list_slice(list_filter(list_filter(list_transform(regexp_split_to_array(t, '\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\s*[0-9]+\\.\\s*', '') <> ''), 1, 2), chr(10)) as first_two,
regexp_replace(t, '\\[([^\\]]*)\\]', '\\1', 'g') as unbracketed, nullif(regexp_replace(regexp_replace(split_part(t, chr(9), 1), '\\[([^\\]]*)\\]', '\\1', 'g'), '^\\s+|\\s+$', '', 'g'), '') as refined from a
""")
def response_lines(spark, sf):
    """Open think blocks, artifacts, finished lines, the first steps, brackets (L)."""
    t = pick(*RESPONSES)
    return table(spark, sf, "orders").select(
        "o_orderkey", text.open_think(t).alias("think_open"), text.post_process(t, True, ["STOP"]).alias("processed"), text.completed_step_count(t, True, ["STOP"]).cast("long").alias("n_finished"),
        text.trim_to_steps(t, 2).alias("first_two"), text.clean_brackets(t).alias("unbracketed"), text.refine_line(t).alias("refined"),
    )


LIST_SQL = "[' Who is #1? ', '', 'Where  is [#' || (o_orderkey % 3) || '] near #2', '7. x']"
CUT = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def step_list():
    return F.array(F.lit(" Who is #1? "), F.lit(""), F.concat(F.lit("Where  is [#"), (key() % 3).cast("string"), F.lit("] near #2")), F.lit("7. x"))


@query(f"""
with r as (select o_orderkey, {LIST_SQL} as s from orders), c as (select *, {CUT.format("s")} as l from r)
select o_orderkey, array_to_string(l, '|') as items, array_to_string(l, chr(10)) as joined, array_to_string(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '#([0-9]+)', '@@\\1@@', 'g')), ' @@SEP@@ ') as break_string,
array_to_string(list_transform(l, lambda x, i: i || '. ' || replace(regexp_replace(regexp_replace(x, '\\[#', '<<', 'g'), '#([0-9]+)', '[#\\1]', 'g'), '<<', '[#')), chr(10)) as completion,
case when o_orderkey % 2 = 0 then array_to_string(l, '|') else 'other' end as filled, o_orderkey % 2 = 0 as is_filled from c
""")
def step_lists(spark, sf):
    """Lists to steps, joined, as break strings, as completions; the first filled of several (L)."""
    steps = text.steps_of_list(step_list())
    structs = F.transform(step_list(), lambda x: F.struct(x.alias("question")))
    maybe = F.when(key() % 2 == 0, text.steps_of_structs(structs)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(steps, "|").alias("items"), text.join_steps(step_list()).alias("joined"), text.break_string(step_list()).alias("break_string"), text.format_completion(steps).alias("completion"),
        F.array_join(text.first_filled(maybe, F.array(F.lit("other"))), "|").alias("filled"), text.is_filled(maybe, "array").alias("is_filled"),
    )


# ---- templates ----

TEMPLATES = ["Use {question}\n- The number of steps MUST equal the hop count.\nEnd\n", "Hop count: {hop_count}\nUse 2-hop style", "- Use the hop count and output ONLY the steps.\nx", "a\nhop_count: 3\nb\n", "nothing here"]
HOP_SQL = "(?i)\\{hop_count\\}|hop[\\s_-]*count"


@query(f"""
with t as (select o_orderkey, {pick_sql(*quoted(*TEMPLATES))} as t from orders), l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{HOP_SQL}')) as h from t),
m as (select *, list_filter(h, lambda x: len(list_filter(regexp_split_to_array(x, '(?i)[.;:,]|\\band\\b|\\bbut\\b'), lambda c: regexp_matches(c, '[A-Za-z]{{2,}}') and not regexp_matches(c, '{HOP_SQL}'))) > 0) as bad from l)
select o_orderkey, cast(len(h) as bigint) as n_hop_lines, cast(len(bad) as bigint) as n_mixed, case when len(bad) = 0 then regexp_replace(t, '(?im)^[^\\n]*(\\{{hop_count\\}}|hop[\\s_-]*count)[^\\n]*(\\n|\\z)', '', 'g') end as unguided from m
""")
def template_hop_lines(spark, sf):
    """Lines on the hop count, those that say something else too, templates without them (M)."""
    t = pick(*TEMPLATES)
    return table(spark, sf, "orders").select("o_orderkey", F.size(plans.hop_line_column(t)).cast("long").alias("n_hop_lines"), F.size(plans.mixed_hop_line_column(t)).cast("long").alias("n_mixed"), plans.unguided_column(t).alias("unguided"))


@query("""
select conv_id, turn, 'system' as role1, 'Answer ' || coalesce(role, '') as content1, 'user' as role2, 'Q: ' || text as content2, 'Question: ' || text || chr(10) || 'Decomposition:' || chr(10) || coalesce(role, '') || chr(10) || chr(10) || 'Question: ?' || chr(10) || 'Decomposition:' || chr(10) || '1' as examples
from conversations where text is not null
""")
def chat_messages(spark, sf):
    """Messages of the two halves of a template, examples one after the other (M)."""
    c = table(spark, sf, "conversations").where("text is not null")
    m = plans.chat("Answer {role}\n###\nQ: {text}", "###", role=F.coalesce("role", F.lit("")), text=F.col("text"))
    e = F.array(F.struct(F.col("text").alias("question"), F.coalesce("role", F.lit("")).alias("decomposition")), F.struct(F.lit("?").alias("question"), F.lit("1").alias("decomposition")))
    rows = c.select("conv_id", "turn", m.alias("m"), plans.render_examples(e).alias("examples"))
    return rows.select("conv_id", "turn", *(F.get("m", F.lit(i))[k].alias(f"{k}{i + 1}") for i in (0, 1) for k in ("role", "content")), "examples")


# ---- scores ----

PRED_SQL = "['Who is it?', 'Where is [#1] near [#' || (o_orderkey % 4) || ']?', 'Is [#' || (o_orderkey % 5) || '] by #1?']"
GOLD_SQL = "['Who is it?', case when o_orderkey % 2 = 0 then 'Where is [#1]?' else 'WHERE is it?' end]"


def predicted():
    return F.array(F.lit("Who is it?"), F.concat(F.lit("Where is [#1] near [#"), (key() % 4).cast("string"), F.lit("]?")), F.concat(F.lit("Is [#"), (key() % 5).cast("string"), F.lit("] by #1?")))


def golden():
    return F.array(F.lit("Who is it?"), F.when(key() % 2 == 0, "Where is [#1]?").otherwise("WHERE is it?"))


def _valid(steps: str, pattern: str) -> str:
    return f"list_sum(list_transform({steps}, lambda x, i: len(list_filter(regexp_extract_all(x, '{pattern}', 1), lambda k: cast(k as int) >= 1 and cast(k as int) < i))))"


def _total(steps: str, pattern: str) -> str:
    return f"list_sum(list_transform({steps}, lambda x: len(regexp_extract_all(x, '{pattern}', 1))))"


@query(f"""
with s as (select o_orderkey, {PRED_SQL} as p, {GOLD_SQL} as g from orders)
select o_orderkey, cast({_valid("p", "\\[#([0-9]+)\\]")} as bigint) as valid, cast({_total("p", "\\[#([0-9]+)\\]")} as bigint) as total, round({_valid("p", "\\[#([0-9]+)\\]")} / {_total("p", "\\[#([0-9]+)\\]")}, 6) as reference_validity,
round(case when {_total("p", "#([0-9]+)")} > 0 then {_valid("p", "#([0-9]+)")} / {_total("p", "#([0-9]+)")} when {_total("g", "#([0-9]+)")} = 0 then 1.0 else 0.0 end, 6) as chain_validity, case when {_total("g", "\\[#([0-9]+)\\]")} = 0 then 1.0 else {_valid("g", "\\[#([0-9]+)\\]")} / {_total("g", "\\[#([0-9]+)\\]")} end as gold_validity,
cast(len(g) = 2 and lower(g[2]) = 'where is it?' as double) as break_exact from s
""")
def reference_scores(spark, sf):
    """Validity of references, with brackets and bare, and equality of break strings (N)."""
    rows = orders(spark, sf, p=predicted(), g=golden()).select("o_orderkey", metrics.reference_validity(F.col("p")).alias("r"), metrics.chain_validity(F.col("p"), F.col("g")).alias("c"), metrics.reference_validity(F.col("g")).alias("v"), metrics.break_exact(F.array(F.lit("who  is it?"), F.lit("where IS it?")), F.col("g")).alias("break_exact"))
    return rows.select("o_orderkey", F.col("r.valid").cast("long").alias("valid"), F.col("r.total").cast("long").alias("total"), r6(F.col("r.score")).alias("reference_validity"), r6(F.col("c.score")).alias("chain_validity"), F.col("v.score").alias("gold_validity"), "break_exact")


@query("""
with g as (select conv_id, turn, text, list_distinct(list_filter([before1, 'The answer', ' ', before1], lambda x: trim(x) <> '')) as golds, lower(regexp_replace(text, '\\s+', ' ', 'g')) as p from %s)
select conv_id, turn, cast(len(golds) as bigint) as n_golds, coalesce(list_max(list_transform(golds, lambda x: cast(%s = %s as double))), 0.0) as exact from g
""" % (TURNS, "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(x), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t <> '' and t not in ('a', 'an', 'the')), ' ')", "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t <> '' and t not in ('a', 'an', 'the')), ' ')"))
def gold_answer_scores(spark, sf):
    """Answers and aliases, and the best score over them (N)."""
    golds = metrics.gold_answers(F.col("before1"), F.array(F.lit("The answer"), F.lit(" "), F.col("before1")))
    rows = turns(spark, sf).select("conv_id", "turn", golds.alias("g"), "text")
    return rows.select("conv_id", "turn", F.size("g").cast("long").alias("n_golds"), metrics.score_answer(F.col("text"), F.col("g"))["exact"].alias("exact"))


# ---- evaluation ----

EVAL = f"""
s as (select conv_id, turn, {STEPS.format("text")} as ps, {STEPS.format("before1")} as gs from {TURNS}),
n as (select *, {NSTEP.format("ps")} as p, {NSTEP.format("gs")} as g from s),
f as (select *, list_distinct(list_filter(p, lambda x: trim(x) <> '')) as dp, list_distinct(list_filter(g, lambda x: trim(x) <> '')) as dg from n),
c as (select len(gs) as gold_hops, len(ps) as predicted_hops, cast(p = g as double) as exact_match, len(dp) as np, len(dg) as ng, len(list_intersect(dp, dg)) as same,
 case when greatest(len(p), len(g)) = 0 then 1.0 else len(list_filter(list_zip(p, g, true), lambda z: z[1] = z[2])) / greatest(len(p), len(g)) end as ordered_accuracy, len(ps) - len(gs) as e from f)
"""


def scored_turns(spark, sf):
    rows = turns(spark, sf).select("conv_id", "turn", F.col("before1").alias("question"), text.split_steps(F.col("text")).alias("steps"), text.split_steps(F.col("before1")).alias("gold_steps"))
    return evaluation.score(rows, with_ged=False)


@query(f"""
with {EVAL}
select case when grouping(gold_hops) = 1 then 'all' else cast(gold_hops as varchar) end as gold_hops, count(*) as n_items, round(avg(exact_match), 6) as exact_match, round(avg(case when np + ng = 0 then 1.0 when np = 0 then 0.0 else same / np end), 6) as step_precision,
round(avg(case when np + ng = 0 then 1.0 when ng = 0 then 0.0 else same / ng end), 6) as step_recall, round(avg(case when np + ng = 0 then 1.0 when same = 0 then 0.0 else 2.0 * same / (np + ng) end), 6) as step_f1, round(avg(ordered_accuracy), 6) as ordered_accuracy,
round(avg(abs(e)), 6) as count_mae, round(avg(e), 6) as count_signed_error, round(avg(cast(e > 0 as int)), 6) as over_rate, round(avg(cast(e < 0 as int)), 6) as under_rate, round(avg(cast(e = 0 as int)), 6) as count_exact_rate,
round(avg(cast(e = 0 as int)), 6) as hop_count_exact_rate, round(avg(abs(e)), 6) as hop_count_mae from c group by grouping sets ((gold_hops), ())
""")
def evaluate_summary(spark, sf):
    """The evaluation's aggregates, in all and per gold hop (F, N); turns against the ones before, steps being lines."""
    out = evaluation.summarize(scored_turns(spark, sf), with_ged=False).withColumn("gold_hops", F.when(F.col("is_total"), "all").otherwise(F.col("gold_hops").cast("string")))
    names = ["exact_match", "step_precision", "step_recall", "step_f1", "ordered_accuracy", "count_mae", "count_signed_error", "over_rate", "under_rate", "count_exact_rate", "hop_count_exact_rate", "hop_count_mae"]
    return out.select("gold_hops", "n_items", *(r6(F.col(c)).alias(c) for c in names))


@query(f"""
with {EVAL}
select case when grouping(gold_hops) = 1 then 'all' else cast(gold_hops as varchar) end as gold_hops, cast(predicted_hops as bigint) as value, count(*) as n from c group by grouping sets ((gold_hops, predicted_hops), (predicted_hops))
""")
def predicted_hop_distribution(spark, sf):
    """How often each number of steps is predicted, in all and per gold hop (F)."""
    out = evaluation.distribution(scored_turns(spark, sf), "predicted_hops")
    return out.select(F.when(F.col("is_total"), "all").otherwise(F.col("gold_hops").cast("string")).alias("gold_hops"), F.col("value").cast("long").alias("value"), "n")


# ---- training sets and results ----

TRAIN_SQL = "(select o_orderkey as k, case when o_orderkey % 7 = 0 then '  ' else ' ' || (o_orderkey % 3 + 1) || 'hop__' || o_orderkey end as id, case when o_orderkey % 5 <> 0 then ' Q' || o_orderkey || '? ' end as question, case when o_orderkey % 11 = 0 then [] else ['Who is #1?', 'x'] end as steps, case when o_orderkey % 2 = 0 then o_orderkey % 4 end as hop_count from orders)"


def training_rows(spark, sf):
    rid = F.when(key() % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), (key() % 3 + 1).cast("string"), F.lit("hop__"), key_text()))
    steps = F.when(key() % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Who is #1?"), F.lit("x")))
    rows = table(spark, sf, "orders").select(rid.alias("id"), F.when(key() % 5 != 0, F.concat(F.lit(" Q"), key_text(), F.lit("? "))).alias("question"), F.when(key() % 2 == 0, key() % 4).alias("hop_count"), steps.alias("s"))
    return training.examine(rows, F.col("s"))


EXAMINED = f"""(select *, case when trim(id) = '' then 'missing_id' when question is null then 'missing_question' when len(steps) = 0 then 'missing_steps' end as reason, nullif(regexp_extract(trim(id), '^([0-9]+)hop', 1), '') as h from {TRAIN_SQL})"""


@query(f"""
select count(*) as rows_in, count(*) filter (reason = 'missing_id') as dropped_missing_id, count(*) filter (reason = 'missing_question') as dropped_missing_question, count(*) filter (reason = 'missing_steps') as dropped_missing_steps, count(*) filter (reason is null) as kept,
count(*) filter (reason is null and (cast(h as int) <> len(steps) or hop_count > 0 and hop_count <> len(steps))) as hop_disagreements from {EXAMINED}
""")
def training_drops(spark, sf):
    """What a training set drops, and why (C)."""
    return training.drops(training_rows(spark, sf))


@query(f"""
select trim(id) as row_id, 'Hops: ' || case when hop_count > 0 then hop_count else cast(h as bigint) end || chr(10) || trim(question) as prompt, '1. Who is [#1]?' || chr(10) || '2. x' as completion from {EXAMINED} where reason is null
""")
def training_examples(spark, sf):
    """Prompts and completions of the rows that are kept (C, L)."""
    return training.prompt_completion(training.examples(training_rows(spark, sf)), "Hops: {hop_count}\n{question}")


@query("select trim('r' || o_orderkey) as query_id, cast(o_orderkey % 3 + 1 as bigint) as predicted_hop, cast(o_custkey % 3 + 1 as bigint) as expected_hop, o_orderkey % 3 = o_custkey % 3 as correct, o_orderkey % 10 = 0 as parse_fallback from orders")
def prediction_rows(spark, sf):
    """A router's predictions as they are written (C)."""
    out = results.predictions(table(spark, sf, "orders"), F.concat(F.lit(" r"), key_text()), key() % 3 + 1, key() % 10 != 0, F.col("o_custkey") % 3 + 1)
    return out.withColumn("predicted_hop", F.col("predicted_hop").cast("long")).withColumn("expected_hop", F.col("expected_hop").cast("long"))


@query(f"""
with r as (select o_orderkey, o_custkey, {pick_sql(*quoted(*RESPONSES))} as t from orders), x as (select *, o_orderkey % 3 as e, case when o_custkey % 4 < 3 then o_custkey % 4 end as p from r)
select 'q' || o_orderkey as question, regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g') as response, e as expected, p as predicted, e is not distinct from p as correct, case when e is distinct from p then e || ' -> ' || coalesce(cast(p as varchar), 'none') end as pattern from x
""")
def detailed_results(spark, sf):
    """Responses with expected and predicted hops (C)."""
    c = F.col("o_custkey") % 4
    return results.detailed(table(spark, sf, "orders"), F.concat(F.lit("q"), key_text()), pick(*RESPONSES), key() % 3, F.when(c < 3, c))


@query("select 'd' || doc_id as id, trim(text) as question, row_number() over (order by doc_id) - 1 as \"index\" from documents where text is not null and length(trim(text)) > 0")
def clean_rows(spark, sf):
    """Rows with a question, trimmed and numbered (C)."""
    return results.clean(table(spark, sf, "documents"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"), "doc_id")


@query("select c_custkey as id, c_name as name, 'n/a' as model from customer union all select s_suppkey, s_name, 'n/a' from supplier")
def normalized_schema(spark, sf):
    """Tables with other spellings of the same fields as one (C)."""
    spelled = {"id": ["key", "c_custkey", "s_suppkey"], "name": ["c_name", "s_name"], "model": ["model_id"]}
    return results.normalize_schema(table(spark, sf, "customer"), spelled, {"model": "n/a"}).unionByName(results.normalize_schema(table(spark, sf, "supplier"), spelled, {"model": "n/a"}))


# ---- rates and counts ----


@query(f"""
select cast(query_label as bigint) as query_label, count(*) as n_queries, sum(h) as n_hits, round(avg(h), 6) as rate from (select query_id, query_label, max(cast(label = query_label as int)) as h from {ALL_SQL} where rank <= 3 group by all) group by query_label
""")
def hit_in_top_k(spark, sf):
    """Queries with at least one right neighbour among the first three (F)."""
    out = results.hit_rate(labelled(spark, sf, 3), F.col("label") == F.col("query_label"), 3, "query_label")
    return out.select(F.col("query_label").cast("long").alias("query_label"), "n_queries", F.col("n_hits").cast("long").alias("n_hits"), r6(F.col("rate")).alias("rate"))


@query("""
with x as (select o_orderkey % 5 <> 0 as ran, case when o_orderkey % 5 <> 0 then (o_orderkey % 3) / 2.0 else 0.0 end as j from orders)
select count(*) filter (ran) as n_executed, count(*) as n_items, round(avg(case when ran then cast(j = 1 as int) end), 6) as exact_rate_executed, round(avg(cast(j = 1 as int)), 6) as exact_rate, round(avg(case when ran then j end), 6) as mean_jaccard_executed, round(avg(j), 6) as mean_jaccard from x
""")
def both_denominators(spark, sf):
    """Rates over what ran, and over all (F)."""
    ran = key() % 5 != 0
    j = F.when(ran, (key() % 3) / 2.0).otherwise(0.0)
    out = results.over_both(table(spark, sf, "orders"), ran, j == 1, j)
    return out.select("n_executed", "n_items", *(r6(F.col(c)).alias(c) for c in ("exact_rate_executed", "exact_rate", "mean_jaccard_executed", "mean_jaccard")))


@query(f"""
with c as (select conv_id, count(*) as n, list_sum(list_transform(list(text) filter (text is not null), lambda t: len({STEPS.format("t")}))) as s, count(*) filter (role = 'assistant') as a from conversations group by conv_id)
select count(*) as n_items, cast(count(*) filter (coalesce(s, 0) = 0) as bigint) as n_without_steps, count(*) filter (a = 0) as n_without_gold, cast(sum(coalesce(s, 0)) as bigint) as n_steps, min(n) as min_paragraphs, max(n) as max_paragraphs, round(avg(n), 6) as mean_paragraphs, count(*) filter (n < 4) as n_below_expected from c
""")
def run_counters(spark, sf):
    """Counters of a run and of its items' paragraphs (F); conversations as items, turns as paragraphs."""
    c = table(spark, sf, "conversations")
    rows = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.when(F.col("text").isNotNull(), text.split_steps(F.col("text"))))).alias("s"), F.collect_list(F.when(F.col("role") == "assistant", "text")).alias("g"))
    out = results.run_counters(rows, 4, F.col("n"), F.col("s"), F.col("g"))
    return out.withColumn("n_steps", F.col("n_steps").cast("long")).withColumn("mean_paragraphs", r6(F.col("mean_paragraphs")))


@query("select event_type, cast(event_id % 4 as bigint) as fold, case when grouping(event_type) = 0 and grouping(event_id % 4) = 0 then 'event_type x fold' when grouping(event_type) = 0 then 'event_type' else 'fold' end as level, count(*) as n from events group by grouping sets ((event_type, event_id % 4), (event_type), (event_id % 4))")
def cross_tab(spark, sf):
    """Counts by two keys and by each (F)."""
    rows = table(spark, sf, "events").withColumn("fold", F.col("event_id") % 4)
    return results.cross_counts(rows, "event_type", "fold").select("event_type", F.col("fold").cast("long").alias("fold"), "level", "n")


@query("select event_type as bucket, count(*) as n, min(event_id) as first, max(event_id) as last from events group by event_type")
def bucket_rows(spark, sf):
    """Buckets with their rows' range (F)."""
    return results.row_indexes(table(spark, sf, "events"), F.col("event_type"), "event_id")


# ---- checks, joins, samples ----


@query("select count(*) filter (l_quantity is not null) as n_finite, cast(0 as bigint) as n_nan, count(*) filter (l_linenumber >= 1) as n_depths, cast(0 as bigint) as n_fraction_depths, cast(0 as bigint) as n_boolean_depths from lineitem")
def value_predicates(spark, sf):
    """Finite numbers; depths are positive whole numbers, neither fractions nor booleans (D)."""
    c = F.col
    n = F.count_if
    return table(spark, sf, "lineitem").agg(
        n(checks.usable_number(c("l_quantity"))).alias("n_finite"), n(checks.usable_number(F.lit(float("nan")))).alias("n_nan"), n(checks.hop_depth(c("l_linenumber"))).alias("n_depths"),
        n(checks.hop_depth(F.lit(2.7))).alias("n_fraction_depths"), n(checks.hop_depth(c("l_linenumber") > 0)).alias("n_boolean_depths"),
    )


@query("select o_custkey as k, max_by(o_orderkey, o_orderkey) as last_order, min_by(o_orderkey, o_orderkey) as first_order from orders group by o_custkey")
def last_and_first_win(spark, sf):
    """One row per key: the last, the first (E)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderkey").alias("o"))
    one = lambda f, name: f(o, "k", "o").select("k", F.col("o_orderkey").alias(name))
    return joins.complete(one(joins.last_wins, "last_order"), one(joins.first_wins, "first_order"), "k")


@query("""
with r as (select o_custkey as id, max(o_orderkey) as by_id from orders group by 1), q as (select 'customer ' || o_custkey as qn, min(o_orderkey) as by_q from orders group by 1)
select c_custkey as id, coalesce(by_id, by_q) as found from (select c_custkey, c_custkey + case when c_custkey % 3 = 0 then 1000000000 else 0 end as key from customer) left join r on r.id = key left join q on qn = 'customer ' || c_custkey
""")
def fallback_join(spark, sf):
    """Rows by id, else by normalized question (E)."""
    left = table(spark, sf, "customer").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 3 == 0, 10**9).otherwise(0)).alias("id"), F.concat(F.lit(" Customer  "), F.col("c_custkey").cast("string")).alias("question"), "c_custkey")
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("question"), "o_orderkey")
    return joins.with_fallback(left, right.withColumn("o", F.col("o_orderkey")), "id", "question", "o").select(F.col("c_custkey").alias("id"), F.col("match.o_orderkey").alias("found"))


@query(f"select query_id, array_to_string(list(pool_id order by rank), ',') as kept from (select * from {SAME_SQL} where rank <= 5 and pool_id % 10 <> query_id % 10 qualify row_number() over (partition by query_id order by rank) <= 3) group by query_id")
def neighbours_without_self(spark, sf):
    """The first three neighbours that aren't the query by text (H); texts repeat every ten ids."""
    name = lambda c: F.concat(F.lit("Q "), (F.col(c) % 10).cast("string"))
    rows = ranked(spark, sf, 5, "label").withColumn("pool_question", name("pool_id"))
    lists = topk.neighbour_lists(rows, "pool_question")
    out = lists.select("query_id", topk.without_self(F.col("neighbours"), F.col("query_id"), F.concat(F.lit(" q  "), (F.col("query_id") % 10).cast("string")), 3).alias("n"))
    return out.where(F.size("n") > 0).select("query_id", F.array_join(F.transform("n", lambda x: x["pool_id"].cast("string")), ",").alias("kept"))


SQL["sample_waterfill"] = """
with n as (select quality * 2 + toxic as g, count(*) as n from labels group by 1), l as (select max(x) as level from range(0, 201) t(x) where (select sum(least(n, x)) from n) <= 200),
d as (select *, 200 - (select sum(least(n, (select level from l))) from n) as spare from n), q as (select *, least(n, (select level from l)) as base, row_number() over (partition by n > (select level from l) order by n, g) as pos from d),
w as (select g, base + case when n > (select level from l) and pos <= spare then 1 else 0 end as quota from q)
select doc_id, r.g from (select doc_id, quality * 2 + toxic as g, row_number() over (partition by quality * 2 + toxic order by md5('' || doc_id), doc_id) as rank from labels) r join w on w.g = r.g where rank <= quota
"""
SQL["sweep_pools"] = " union all ".join(
    f"select event_id, event_type, 'size{n}_{balance}_trial0' as cell from (select *, row_number() over ({'' if balance == 'imbalanced' else 'partition by event_type '}order by md5('0' || event_id), event_id) as rank from events) where rank <= {n if balance == 'imbalanced' else n // 5}"
    for n in (50, 100) for balance in ("imbalanced", "balanced")
)


def _tail(b: str, c: str) -> str:
    """The exact two-sided p of discordant counts."""
    n = f"({b} + {c})"
    return f"least(1.0, 2.0 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))))"


COUNTED = """
w as (select {by}, count(*) filter (quality = 1 and toxic = 0) as only_a, count(*) filter (quality = 0 and toxic = 1) as only_b, count(*) filter (quality = 1 and toxic = 1) as n_both, count(*) filter (quality = 0 and toxic = 0) as n_neither from labels group by 1),
p as (select *, %s as p, least(1.0, 2.0 * pow(0.5, only_a + only_b)) as least_p from w)
select {out}only_a, only_b, n_both as "both", n_neither as neither, round(p, 6) as p_value, round(least_p, 6) as min_p, p < 0.05 as significant, least_p >= 0.05 as underpowered from p
""" % _tail("only_a", "only_b")
SQL["mcnemar_exact"] = "with " + COUNTED.format(by="0 as one", out="")


@query("with " + COUNTED.format(by="doc_id % 97 as part", out="part, "))
def mcnemar_by_group(spark, sf):
    """Exact tests of many groups at once, some too small to be significant (G)."""
    rows = table(spark, sf, "labels").withColumn("part", F.col("doc_id") % 97)
    out = stats.mcnemar(rows, F.col("quality"), F.col("toxic"), by="part")
    return out.withColumn("p_value", r6(F.col("p_value"))).withColumn("min_p", r6(F.col("min_p")))


SQL["paired_t"] = """
with d as (select 'quantity' as statistic, l_quantity - l_extendedprice / 1000 as d from lineitem union all select 'rates', l_discount - l_tax from lineitem),
a as (select statistic, count(d) as n, avg(d) as m, stddev_samp(d) as sd from d group by 1), t as (select *, m / (sd / sqrt(n)) as t, n - 1 as dof from a),
w as (select *, least(abs(t), 60.0) / 6000 as h, exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(dof * pi()) as f from t),
p as (select *, f * h / 3 * list_sum(list_transform(range(0, 6001), lambda i: (case when i in (0, 6000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-(dof + 1) / 2.0 * ln(1 + (i * h) * (i * h) / dof)))) as half from w)
select statistic, n, round(m, 6) as mean_diff, round(sd, 6) as sd, round(t, 4) as t, dof, round(greatest(0.0, 1 - 2 * half), 5) + 0.0 as p_value from p
"""
