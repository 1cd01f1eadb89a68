"""Queries over the driver's tables, one or more per operator group, each with the equivalent DuckDB SQL where SQL can say it.

All of them read whole tables. Floats are rounded to 6 digits, since sums depend on the order of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .functions import graphs, ids, masking, metrics, plans, text
from .operators import aggregate, joins, kg, models, ordered, sampling, stats, topk, validation
from .plans import evaluation, feasibility, stages, sweep
from .runtime import dealt, spread
from .sources import result_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c.cast("double"), 6)


# ---- graph -------------------------------------------------------------------------------------


def graph(spark, sf) -> DataFrame:
    """Triples of customers, suppliers, nations and regions."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    of = lambda t, key, name, rel: table(spark, sf, t).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col(name).alias("src"), F.lit(rel).alias("rel"), F.col("n_name").alias("dst"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("in_region").alias("rel"), F.col("r_name").alias("dst"))
    return of("customer", "c_nationkey", "c_name", "lives_in").union(of("supplier", "s_nationkey", "s_name", "based_in")).union(up)


def op(kind: str, relation: str, entity=None, ref: int | None = None):
    return F.struct(F.lit(kind).alias("op"), F.lit(relation).alias("relation"), (entity if entity is not None else F.lit(None)).cast("string").alias("entity"), F.lit(ref).cast("int").alias("ref_step"))


def question_plans(spark, sf) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    back, ahead, project = plans.REVERSE, plans.FORWARD, plans.PROJECT
    item = lambda df, prefix, name, *ops: df.select(F.concat(F.lit(prefix), F.col(name)).alias("item_id"), F.array(*ops).alias("ops"))
    n, r = F.col("n_name"), F.col("r_name")
    return (
        item(region, "customers of region ", "r_name", op(back, "in_region", r), op(back, "lives_in", ref=1))
        .union(item(nation, "neighbours of ", "n_name", op(ahead, "in_region", n), op(back, "in_region", ref=1)))
        .union(item(nation, "suppliers around ", "n_name", op(ahead, "in_region", n), op(back, "in_region", ref=1), op(back, "based_in", ref=2)))
        .union(item(region, "regions of the customers of ", "r_name", op(back, "in_region", r), op(back, "lives_in", ref=1), op(project, "lives_in", ref=2), op(project, "in_region", ref=3)))
        .union(item(region, "nowhere near ", "r_name", op(ahead, "in_region", F.concat(r, F.lit("?")))))
        .union(item(region, "too early ", "r_name", op(back, "in_region", ref=2), op(back, "in_region", r)))
    )


@query("""
with g as (select n1.n_name as name, r_name, n2.n_name as other from nation n1 join region on n1.n_regionkey = r_regionkey join nation n2 on n2.n_regionkey = r_regionkey)
select distinct 'customers of region ' || r_name as item_id, c_name as answer from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select distinct 'neighbours of ' || name, other from g
union all select distinct 'suppliers around ' || name, s_name from g join nation on n_name = other join supplier on s_nationkey = n_nationkey
union all select distinct 'regions of the customers of ' || r_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def kg_multihop_execute(spark, sf):
    """Plans of up to four steps, all executed at once (E: graph look-ups, multi-hop execution)."""
    return kg.execute(question_plans(spark, sf), graph(spark, sf), 4)[0]


@query("""
select p || r_name as item_id, s as status, e as reason from region, (values ('customers of region ', 'executed', null), ('regions of the customers of ', 'executed', null), ('nowhere near ', 'exec_fail', 'entity_not_in_kb'), ('too early ', 'exec_fail', 'bad_reference_or_plan')) v(p, s, e)
union all select p || n_name, 'executed', null from nation, (values ('neighbours of '), ('suppliers around ')) v(p)
""")
def kg_status(spark, sf):
    """Which plans ran, and why others didn't."""
    return kg.execute(question_plans(spark, sf), graph(spark, sf), 4)[1]


@query("""
with s as (select 'executed' as status, cast(null as varchar) as reason, count(*) * 2 as n from region union all select 'exec_fail', 'entity_not_in_kb', count(*) from region union all select 'exec_fail', 'bad_reference_or_plan', count(*) from region
union all select 'executed', null, 2 * count(*) from nation)
select status, reason, cast(sum(n) as bigint) as n, round(sum(n) / (select sum(n) from s), 6) as rate from s group by status, reason
""")
def kg_coverage(spark, sf):
    """Rates of statuses and reasons (F: compile/execute coverage)."""
    return evaluation.coverage(kg.execute(question_plans(spark, sf), graph(spark, sf), 4)[1]).withColumn("rate", r6(F.col("rate")))


@query("select 'lives_in' as rel, count(*) as n from customer union all select 'based_in', count(*) from supplier union all select 'in_region', count(*) from nation")
def kg_relation_counts(spark, sf):
    return kg.relation_counts(graph(spark, sf))


@query("""
with t as (select n_nationkey as i, n_name as s, r_name as d from nation join region on n_regionkey = r_regionkey),
e as (select name, min(o) as f from (select s as name, i * 2 as o from t union all select d, i * 2 + 1 from t) group by name)
select name, cast(row_number() over (order by f) - 1 as bigint) as id from e
""")
def kg_entity_ids(spark, sf):
    """Dense ids in order of first appearance (A: triple scan)."""
    lines = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = lines.select(F.col("n_nationkey").cast("long").alias("line_no"), F.concat_ws("|", "n_name", F.lit("in_region"), "r_name").alias("value"))
    return kg.entity_ids(kg.parse_triples(lines))


STEP_SQL = """
(select o_orderkey, o_orderkey % 8 as t, case o_orderkey % 8
 when 0 then '1. Who directed Film ' || o_orderkey || '?' when 1 then 'What movies did Person ' || o_orderkey || ' star in?'
 when 2 then '2. What other movies were directed by [#1]?' when 3 then 'What is the release year of [#2]?'
 when 4 then 'Hello there' when 5 then 'Name a genre.' when 6 then 'Who is the writer of Film ' || o_orderkey || '??' else 'What films was Person ' || o_orderkey || ' in?' end as step from orders)
"""


def order_steps(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    make = [F.concat(F.lit("1. Who directed Film "), s, F.lit("?")), F.concat(F.lit("What movies did Person "), s, F.lit(" star in?")), F.lit("2. What other movies were directed by [#1]?"), F.lit("What is the release year of [#2]?"), F.lit("Hello there"), F.lit("Name a genre."), F.concat(F.lit("Who is the writer of Film "), s, F.lit("??")), F.concat(F.lit("What films was Person "), s, F.lit(" in?"))]
    step = make[-1]
    for i, m in enumerate(make[:-1]):
        step = F.when(k % 8 == i, m).otherwise(step)
    return table(spark, sf, "orders").select("o_orderkey", step.alias("step"))


@query(f"""
select o_orderkey, case t when 0 then 'VALUES_OF_MOVIE' when 1 then 'MOVIES_WITH_VALUE' when 2 then 'MOVIES_WITH_VALUE' when 3 then 'PROJECT_VALUES_FROM_MOVIES' when 6 then 'VALUES_OF_MOVIE' when 7 then 'MOVIES_WITH_VALUE' end as op,
case t when 0 then 'directed_by' when 1 then 'starred_actors' when 2 then 'directed_by' when 3 then 'release_year' when 6 then 'written_by' when 7 then 'starred_actors' end as relation,
case when t in (0, 6) then 'Film ' || o_orderkey when t = 1 then 'Person ' || o_orderkey end as entity,
cast(case t when 2 then 1 when 3 then 2 end as bigint) as ref_step,
case t when 4 then 'cannot_infer_relation' when 5 then 'unsupported_step_template' end as error from {STEP_SQL} where t <> 7
union all select o_orderkey, null, null, null, null, 'cannot_infer_relation' from {STEP_SQL} where t = 7
""")
def kg_compile_steps(spark, sf):
    """Step text to operations (M: relation rules and templates). A step without a relation word fails even if a template fits."""
    ops = order_steps(spark, sf).select("o_orderkey", F.get(plans.compile_steps(F.col("step")), F.lit(0)).alias("o"))
    return ops.select("o_orderkey", "o.op", "o.relation", "o.entity", F.col("o.ref_step").cast("long").alias("ref_step"), "o.error")


@query("""
with a as (select conv_id, string_agg(text, ' ' order by turn) as t from conversations where role = 'user' and text is not null group by conv_id)
select o_orderkey, 'Who leads ' || case when o_orderkey % 3 = 0 then '[#2]' else 'A' || o_orderkey end || ' and ' || 'B' || ' of [#9] [#1?' as text, cast(case when o_orderkey % 3 = 0 then 1 else 2 end as bigint) as n_resolved, cast(case when o_orderkey % 3 = 0 then 3 else 2 end as bigint) as n_unresolved from orders
""")
def substitute_references(spark, sf):
    """[#k] and #k replaced by earlier answers (M)."""
    k = F.col("o_orderkey")
    blank = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("A"), k.cast("string")))
    done = plans.substitute(F.lit("Who leads [#2] and #1 of [#9] [#1?"), F.array(F.lit("B "), blank))
    rows = table(spark, sf, "orders").select("o_orderkey", done.alias("s"))
    return rows.select("o_orderkey", "s.text", F.size("s.resolved").cast("long").alias("n_resolved"), F.size("s.unresolved").cast("long").alias("n_unresolved"))


@query("""
select o_orderkey, cast(case o_orderkey % 5 when 0 then 2 when 1 then 3 when 2 then 2 when 3 then 1 else 3 end as bigint) as hop, o_orderkey % 5 <> 3 as parsed from orders
""")
def parse_hop_responses(spark, sf):
    """Cascade parser of model responses (M)."""
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, F.lit("<think>3 hops</think> A: 2")).when(k % 5 == 1, F.lit("It needs 3 steps")).when(k % 5 == 2, F.lit("a two-hop question")).when(k % 5 == 3, F.lit("no idea")).otherwise(F.lit("Three hop!"))
    out = plans.parse_hop(said, [1, 2, 3], 1, answer_regex=r"A:\s*(\d)")
    return table(spark, sf, "orders").select("o_orderkey", out.alias("o")).select("o_orderkey", F.col("o.hop").cast("long").alias("hop"), "o.parsed")


@query("""
select o_orderkey, list_filter(['broken_reference', 'generation_error', 'empty_answer', 'not_executed'], lambda f: case f when 'broken_reference' then o_orderkey % 2 = 0 when 'generation_error' then o_orderkey % 3 = 0 when 'empty_answer' then o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 = 0 else o_orderkey % 5 = 0 end) as flags_list from orders
""".replace("as flags_list", "::varchar[] as fl").replace("select o_orderkey, list_filter", "select o_orderkey, array_to_string(list_filter").replace("::varchar[] as fl", ", ',') as flags"))
def step_failure_flags(spark, sf):
    """Failure flags of steps (M)."""
    k = F.col("o_orderkey")
    unresolved = F.when(k % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    error = F.when(k % 3 == 0, F.lit("boom"))
    flags = plans.step_flags(F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("x")), unresolved, error, k % 5 != 0)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"))


@query("""
with f as (select case when event_type = 'error' then ['generation_error', 'empty_answer'] when event_type = 'click' then ['broken_reference'] else [] end as flags from events),
d as (select unnest(['broken_reference', 'generation_error', 'empty_answer', 'not_executed']) as flag), c as (select unnest(flags) as flag from f)
select d.flag, count(c.flag) as n from d left join c on c.flag = d.flag group by d.flag
""")
def step_failure_histogram(spark, sf):
    """Flags that aren't exclusive, over a fixed domain (F)."""
    e = F.col("event_type")
    flags = F.when(e == "error", F.array(F.lit("generation_error"), F.lit("empty_answer"))).when(e == "click", F.array(F.lit("broken_reference"))).otherwise(F.array().cast("array<string>"))
    return aggregate.multi_label(table(spark, sf, "events").select(flags.alias("f")), "f", ["broken_reference", "generation_error", "empty_answer", "not_executed"])


# ---- ids and text --------------------------------------------------------------------------------

ID_SQL = "(select o_orderkey, case o_orderkey % 5 when 0 then '2hop__' || o_orderkey when 1 then '3hop1__' || o_orderkey when 2 then ' 4hop' || o_orderkey when 3 then 'x' || o_orderkey else '12hop_' || o_orderkey end as id from orders)"


@query(f"""
select o_orderkey, case when contains(id, '__') then split_part(id, '__', 1) else 'unknown' end as stratum,
cast(coalesce(try_cast(substr(case when contains(id, '__') then split_part(id, '__', 1) else 'unknown' end, 1, 1) as int), -1) as bigint) as coarse_hop,
try_cast(nullif(regexp_extract(id, '^([0-9]+)hop', 1), '') as bigint) as hop, try_cast(nullif(regexp_extract(trim(id), '^([0-9]+)hop', 1), '') as bigint) as hop_trimmed,
try_cast(nullif(regexp_extract(id, '^([0-9]+)hop(?:[0-9]+)?__', 1), '') as bigint) as hop_strict,
case when regexp_extract(id, '^([0-9]+)hop', 1) in ('2', '3', '4') then regexp_extract(id, '^([0-9]+)hop', 1) || 'hop' end as bucket,
substr(sha256(id), 1, 12) as redacted from {ID_SQL}
""")
def hop_id_parse(spark, sf):
    """The hop grammars of ids (K)."""
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rid = F.when(k % 5 == 0, F.concat(F.lit("2hop__"), s)).when(k % 5 == 1, F.concat(F.lit("3hop1__"), s)).when(k % 5 == 2, F.concat(F.lit(" 4hop"), s)).when(k % 5 == 3, F.concat(F.lit("x"), s)).otherwise(F.concat(F.lit("12hop_"), s))
    df = table(spark, sf, "orders").select("o_orderkey", rid.alias("id"))
    c = F.col("id")
    long = lambda x: x.cast("long")
    return df.select("o_orderkey", ids.stratum(c).alias("stratum"), long(ids.coarse_hop(c)).alias("coarse_hop"), long(ids.hop(c)).alias("hop"), long(ids.hop_trimmed(c)).alias("hop_trimmed"), long(ids.hop_strict(c)).alias("hop_strict"), ids.bucket(c, ["2hop", "3hop", "4hop"]).alias("bucket"), ids.redacted(c).alias("redacted"))


@query("""
select distinct p_brand, case when regexp_matches(s, '^[0-9]+hop[0-9]*$') then regexp_replace(regexp_replace(s, '^([0-9]+)hop$', '\\1_hop'), '^([0-9]+)hop([0-9]+)$', '\\1_hop_\\2') else regexp_replace(s, '[^A-Za-z0-9_]', '_', 'g') end as slug from (select p_brand, case when p_size % 2 = 0 then (p_size % 4) || 'hop' || case when p_size % 3 = 0 then '1' else '' end else p_brand end as s from part)
""")
def question_slugs(spark, sf):
    """Strata to file slugs (K)."""
    n = F.col("p_size")
    s = F.when(n % 2 == 0, F.concat((n % 4).cast("string"), F.lit("hop"), F.when(n % 3 == 0, F.lit("1")).otherwise(F.lit("")))).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_brand", ids.questions_slug(s).alias("slug")).distinct()


NORM = "lower(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
with b as (select {NORM.format('text')} as q, min(item_id) as item from benchmark group by 1)
select doc_id, coalesce(item, -1) as item_id, item is not null as gold_found from documents left join b on {NORM.format('documents.text')} = q
""")
def normalize_question_join(spark, sf):
    """Join on a computed key, unmatched rows kept and marked (E, L)."""
    gold = table(spark, sf, "benchmark").select(F.col("text").alias("question"), "item_id", (-F.col("item_id")).alias("o"))
    out = joins.by_question(table(spark, sf, "documents").select("doc_id", F.col("text").alias("question")), gold, ordinal="o")
    return out.select("doc_id", F.coalesce("gold_item_id", F.lit(-1)).cast("long").alias("item_id"), "gold_found")


STEPS = "list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\s*[0-9]+\\.\\s*', '')), lambda x: x <> '')"


@query(f"select doc_id, cast(len(s) as bigint) as n_steps, s[1] as first_step, md5(array_to_string(s, chr(10))) as digest from (select doc_id, {STEPS.format('text')} as s from documents)")
def step_lines(spark, sf):
    """Texts to steps (L)."""
    s = text.split_steps(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_steps"), F.get("s", F.lit(0)).alias("first_step"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query(f"""
select doc_id, case when starts_with(lower(l), 'the ') then regexp_replace(substr(l, 5), '^\\s+|\\s+$', '', 'g') else l end as full_answer,
regexp_replace(substr(case when starts_with(lower(l), 'the ') then regexp_replace(substr(l, 5), '^\\s+|\\s+$', '', 'g') else l end, 1, 40), '^\\s+|\\s+$', '', 'g') as answer,
length(case when starts_with(lower(l), 'the ') then regexp_replace(substr(l, 5), '^\\s+|\\s+$', '', 'g') else l end) > 40 as truncated from (select doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') as l from documents)
""")
def clean_answers(spark, sf):
    """First line, prefix off, cut to a length, with a mark (L)."""
    whole, cut = (text.clean_answer(F.col("text"), True, ["The "], n) for n in (0, 40))
    return table(spark, sf, "documents").select("doc_id", whole["answer"].alias("full_answer"), cut["answer"].alias("answer"), cut["truncated"].alias("truncated"))


# ---- scores ------------------------------------------------------------------------------------


def turns(spark, sf, n: int = 1) -> DataFrame:
    """Each turn with the n turns before it, by equi-joins on the turn's number."""
    one = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    out = dealt(one, "conv_id", "turn")
    for i in range(1, n + 1):
        out = out.join(dealt(one.select("conv_id", (F.col("turn") + i).alias("turn"), F.col("text").alias(f"before{i}")), "conv_id", "turn"), ["conv_id", "turn"])
    return out


TURNS = "(select a.conv_id, a.turn, coalesce(a.text, '') as text, coalesce(b.text, '') as before1 from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1)"
ANSWER = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda t: t <> '' and t not in ('a', 'an', 'the'))"
OVERLAP = "coalesce(list_sum(list_transform(list_intersect(list_distinct({0}), list_distinct({1})), lambda t: least(len(list_filter({0}, lambda x: x = t)), len(list_filter({1}, lambda x: x = t))))), 0)"


@query(f"""
with t as (select conv_id, turn, {ANSWER.format('before1')} as g, {ANSWER.format('text')} as p from {TURNS}), o as (select *, {OVERLAP.format('g', 'p')} as n from t)
select conv_id, turn, cast(g = p as double) as exact, round(case when len(g) = 0 or len(p) = 0 then cast(len(g) = len(p) as double) when n = 0 then 0.0 else 2.0 * n / (len(g) + len(p)) end, 6) as f1 from o
""")
def answer_em_f1(spark, sf):
    """Normalized answers: equality and multiset token F1 (N)."""
    return turns(spark, sf).select("conv_id", "turn", metrics.answer_exact(F.col("before1"), F.col("text")).alias("exact"), r6(metrics.answer_f1(F.col("before1"), F.col("text"))).alias("f1"))


PAIRS = "(select a.doc_id, a.text, b.text as other from documents a join documents b on b.doc_id = a.doc_id + 1)"


def neighbours(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return dealt(d, "doc_id").join(dealt(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id"), "doc_id")


NSTEP = "list_transform({0}, lambda x: regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s#]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
with s as (select doc_id, {NSTEP.format(STEPS.format('text'))} as p, {NSTEP.format(STEPS.format('other'))} as g from {PAIRS}),
c as (select *, len(list_distinct(p)) as np, len(list_distinct(g)) as ng, len(list_intersect(list_distinct(p), list_distinct(g))) as n, len(list_filter(list_zip(p, g, true), lambda z: z[1] = z[2])) as same from s)
select doc_id, round(case when np + ng = 0 then 1.0 when np = 0 then 0.0 else n / np end, 6) as step_precision, round(case when np + ng = 0 then 1.0 when ng = 0 then 0.0 else n / ng end, 6) as step_recall,
round(case when np + ng = 0 then 1.0 when n = 0 then 0.0 else 2.0 * n / (np + ng) end, 6) as step_f1, round(case when greatest(len(p), len(g)) = 0 then 1.0 else same / greatest(len(p), len(g)) end, 6) as ordered_accuracy, cast(p = g as double) as exact_match from c
""")
def step_scores(spark, sf):
    """Set F1 of steps, positional accuracy, exact match (N, J)."""
    p, g = F.col("p"), F.col("g")
    rows = neighbours(spark, sf).select("doc_id", text.split_steps(F.col("text")).alias("p"), text.split_steps(F.col("other")).alias("g"))
    rows = rows.select("doc_id", metrics.step_scores(p, g).alias("s"))
    return rows.select("doc_id", *(r6(F.col(f"s.{k}")).alias(f"step_{k}") for k in ("precision", "recall", "f1")), r6(F.col("s.ordered_accuracy")).alias("ordered_accuracy"), "s.exact_match")


@query(f"""
with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(other), '\\s+'), lambda x: x <> '')) as b from {PAIRS})
select doc_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from w
""")
def jaccard_sets(spark, sf):
    """Jaccard of word sets (J)."""
    w = lambda c: F.array_distinct(text.tokenize(F.col(c)))
    return neighbours(spark, sf).select("doc_id", r6(metrics.jaccard(w("text"), w("other"))).alias("jaccard"))


@query()
def rouge_l(spark, sf):
    """Longest common subsequence of turns' tokens (N)."""
    out = metrics.rouge_l(text.tokenize(F.col("text")), text.tokenize(F.col("before1")))
    return turns(spark, sf).select("conv_id", "turn", out.alias("r")).select("conv_id", "turn", *(r6(F.col(f"r.{k}")).alias(k) for k in ("precision", "recall", "f1")))


def _sari_sql() -> str:
    grams = lambda c, n: f"list_distinct(list_transform(range(1, greatest(len({c}) - {n} + 2, 1)), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), chr(1))))"
    cols, score = [], []
    for n in (1, 2, 3, 4):
        cols += [f"{grams('s', n)} as s{n}", f"{grams('p', n)} as p{n}", f"{grams('t', n)} as t{n}"]
        inter = lambda a, b: f"list_intersect({a}, {b})"
        minus = lambda a, b: f"list_filter({a}, lambda x: not list_contains({b}, x))"
        beta = lambda h, a, b: f"(case when len({h}) = 0 and (len({a}) > 0 or len({b}) > 0) and not (len({a}) = 0 and len({b}) = 0) then 0.0 else 2.0 * (case when len({a}) = 0 then 1.0 else len({h}) / len({a}) end) * (case when len({b}) = 0 then 1.0 else len({h}) / len({b}) end) / ((case when len({a}) = 0 then 1.0 else len({h}) / len({a}) end) + (case when len({b}) = 0 then 1.0 else len({h}) / len({b}) end)) end)"
        sp, st = inter(f"s{n}", f"p{n}"), inter(f"s{n}", f"t{n}")
        score.append(beta(inter(sp, st), sp, st))
        ns, nt = minus(f"s{n}", f"p{n}"), minus(f"s{n}", f"t{n}")
        score.append(f"(case when len({ns}) = 0 then 1.0 else len({inter(ns, nt)}) / len({ns}) end)")
        ad, need = minus(f"p{n}", f"s{n}"), minus(f"t{n}", f"s{n}")
        score.append(beta(inter(ad, f"t{n}"), ad, need))
    three = "(select a.conv_id, a.turn, string_split(coalesce(a.text, ''), ' ') as s, string_split(coalesce(b.text, ''), ' ') as p, string_split(coalesce(c.text, ''), ' ') as t from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1 join conversations c on a.conv_id = c.conv_id and a.turn = c.turn + 2)"
    return f"with g as (select conv_id, turn, {', '.join(cols)} from {three}) select conv_id, turn, round(({' + '.join(score)}) / 12.0, 6) as sari from g"


@query(_sari_sql())
def sari(spark, sf):
    """Keep, add and delete n-grams over three turns (N)."""
    return turns(spark, sf, 2).select("conv_id", "turn", r6(metrics.sari(F.col("text"), F.col("before1"), F.col("before2"))).alias("sari"))


@query()
def evaluate_conversations(spark, sf):
    """Every score of every turn against the turn before it, steps being lines (N; the graph distance by pandas UDF)."""
    rows = turns(spark, sf).select("conv_id", "turn", F.col("before1").alias("question"), text.split_steps(F.col("text")).alias("steps"), text.split_steps(F.col("before1")).alias("gold_steps"))
    return evaluation.score(rows).drop("steps", "gold_steps", "question")


@query()
def ged_bound_gap(spark, sf):
    """How far the distance of steps paired in order is from the least one, by made shape and size, each shape made of every
    turn's sentences (N)."""
    sentences = F.slice(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.?!]\s*"), lambda x: F.trim(x)), lambda x: x != ""), 1, 4)
    gold = table(spark, sf, "conversations").select("conv_id", "turn", sentences.alias("s")).where(F.size("s") > 0)
    gold = gold.select("conv_id", "turn", F.transform("s", lambda x, i: F.when(i == 0, x).otherwise(F.concat(x, F.lit(" @@"), i.cast("string"), F.lit("@@")))).alias("gold"))
    gold = runtime.dealt(gold, "gold").groupBy("gold").agg(F.count("*").alias("k"))  # equal ones are searched for once
    each = gold.crossJoin(spark.createDataFrame([(s, n) for s in ("chain", "gold_repeat", "all_pairs", "nonsense_refs") for n in (3, 6)], "shape string, n int"))  # eight rows
    made = {
        "chain": lambda i: F.when(i > 1, F.concat(F.lit("do @@"), (i - 1).cast("string"), F.lit("@@"))).otherwise(F.lit("do it")),
        "gold_repeat": lambda i: F.element_at("gold", ((i - 1) % F.size("gold") + 1).cast("int")),
        "all_pairs": lambda i: F.concat_ws(" ", F.lit("join"), F.transform(F.when(i > 1, F.sequence(F.lit(1), i - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("@@"), k.cast("string"), F.lit("@@")))),
        "nonsense_refs": lambda i: F.lit(graphs.NONSENSE + " @@1@@"),
    }
    steps = F.coalesce(*(F.when(F.col("shape") == s, F.transform(F.sequence(F.lit(1), F.col("n")), f)) for s, f in made.items()))
    gaps = each.select("shape", "n", "k", graphs.bound_gap(steps, F.col("gold")).alias("g")).select("shape", "n", "k", "g.*")
    mean = lambda c: r6(F.sum(F.col(c) * F.col("k")) / F.sum("k"))
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0).cast("long"))
    return gaps.groupBy("shape", "n").agg(F.sum("k").alias("n_pairs"), mean("bound").alias("mean_bound"), mean("exact").alias("mean_exact"), r6(F.max(F.col("bound") - F.col("exact"))).alias("largest_gap"), number(F.col("bound") - F.col("exact") < 1e-9).alias("n_tight"), number(~F.col("proven")).alias("n_unproven"))


# ---- aggregates --------------------------------------------------------------------------------


@query("""
select l_returnflag as grp, grouping(l_returnflag) = 1 as is_total, count(*) as n, round(avg(l_discount), 9) as macro, round(sum(l_discount) / sum(l_tax), 9) as micro, cast(count(*) filter (l_discount > l_tax) as bigint) as n_over
from lineitem group by grouping sets ((l_returnflag), ())
""")
def macro_micro_rollup(spark, sf):
    """Groups and grand total in one pass, mean of values and ratio of sums (F)."""
    out = aggregate.grouped_and_total(table(spark, sf, "lineitem"), "l_returnflag", F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("macro"), F.round(aggregate.micro(F.col("l_discount"), F.col("l_tax")), 9).alias("micro"), F.count_if(F.col("l_discount") > F.col("l_tax")).alias("n_over"))
    return out.withColumnRenamed("l_returnflag", "grp")


@query("""
select l_linestatus, round(0.4 * avg(l_discount) + 0.6 * avg(l_tax) + 0.1 * greatest(0.0, 1 - avg(abs(l_linenumber - 3)) / 3.0), 6) as composite from lineitem group by l_linestatus
""")
def composite_score(spark, sf):
    agg = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg(F.abs(F.col("l_linenumber") - 3)).alias("e"))
    return agg.select("l_linestatus", r6(metrics.composite([(F.col("a"), 0.4), (F.col("b"), 0.6)], F.col("e"), 0.1, 3.0)).alias("composite"))


@query("""
with d as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) as p) select p as o_orderpriority, count(o_orderkey) as n from d left join orders on o_orderpriority = p group by p
""")
def histogram_over_domain(spark, sf):
    domain = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
    return aggregate.over_domain(table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", domain, {"n": 0})


@query("""
select l_returnflag, l_linestatus, metric, n, round(mean, 6) as mean, round(std, 6) as std from (
select l_returnflag, l_linestatus, 'l_discount' as metric, count(l_discount) as n, avg(l_discount) as mean, coalesce(stddev_samp(l_discount), 0.0) as std from lineitem group by all
union all select l_returnflag, l_linestatus, 'l_tax', count(l_tax), avg(l_tax), coalesce(stddev_samp(l_tax), 0.0) from lineitem group by all)
""")
def sweep_mean_std(spark, sf):
    """Long format of means and deviations (B, F)."""
    out = aggregate.sweep(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"])
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query("select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F') - avg(o_totalprice) filter (o_orderstatus = 'O'), 2) as delta from orders group by o_orderpriority having count(*) filter (o_orderstatus = 'F') > 0 and count(*) filter (o_orderstatus = 'O') > 0")
def pivot_delta(spark, sf):
    return aggregate.delta(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice").withColumn("delta", F.round("delta", 2))


@query("select count(value) as n_measured, round(avg(value), 6) as mean, round(median(value), 6) as median, round(sum(value), 2) as total from events")
def median_cost(spark, sf):
    return aggregate.cost_summary(table(spark, sf, "events"), "value").select("n_measured", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), F.round("total", 2).alias("total"))


@query("""
with l as (select event_type, 'value' as statistic, value as v from events union all select event_type, 'user', cast(user_id as double) from events)
select event_type, statistic, count(v) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.1), 6) as p10, round(median(v), 6) as median, round(quantile_cont(v, 0.99), 6) as p99 from l where v is not null and isfinite(v) group by event_type, statistic
""")
def quantiles_by_type(spark, sf):
    """Exact quantiles of several columns by group, without any group's values in one place (F)."""
    rows = table(spark, sf, "events").select("event_type", "value", F.col("user_id").alias("user"))
    out = ordered.quantiles(rows, ["event_type"], ["value", "user"], {"p10": 0.1, "median": 0.5, "p99": 0.99})
    return out.select("event_type", "statistic", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "p10", "median", "p99")))


@query("select source, arg_max(lang, (n, lang)) as lang from (select source, lang, count(*) as n from documents group by all) group by source")
def mode_per_source(spark, sf):
    """Most frequent value, ties by a priority (F)."""
    return aggregate.mode_with_priority(table(spark, sf, "documents"), "source", "lang", F.lit(0))


@query("select sha256(string_agg(n_regionkey || chr(9) || n_name, chr(10) order by n_regionkey || chr(9) || n_name)) as sha256 from nation")
def set_fingerprint(spark, sf):
    """Digest of a pinned set (C)."""
    return aggregate.sorted_fingerprint(table(spark, sf, "nation"), F.concat(F.col("n_regionkey").cast("string"), F.lit("\t"), F.col("n_name")))


# ---- statistics --------------------------------------------------------------------------------


@query()
def mcnemar_exact(spark, sf):
    """Discordant pairs and the exact test (G); SQL in row_queries."""
    out = stats.mcnemar(table(spark, sf, "labels"), F.col("quality"), F.col("toxic"))
    return out.withColumn("p_value", r6(F.col("p_value"))).withColumn("min_p", r6(F.col("min_p")))


@query()
def paired_t(spark, sf):
    """Paired t-tests of several statistics at once (G); SQL in row_queries, its p by Simpson's rule."""
    out = stats.paired_t(table(spark, sf, "lineitem"), {"quantity": (F.col("l_quantity"), F.col("l_extendedprice") / 1000), "rates": (F.col("l_discount"), F.col("l_tax"))})
    return out.select("statistic", "n", r6(F.col("mean_diff")).alias("mean_diff"), r6(F.col("sd")).alias("sd"), F.round("t", 4).alias("t"), "dof", (F.round("p_value", 5) + F.lit(0.0)).alias("p_value"))


POISSON_SQL = " + ".join(f"cast(u > {c:.17e} as int)" for c in stats.STEPS)
DRAWN_SQL = f"""select *, {POISSON_SQL} as w from (select *, ((y2 * y2 + 13 * y2 + x) % {stats.PRIME} + 0.5) / {stats.PRIME} as u from (select *, (y1 * y1 + 7 * y1 + r) % {stats.PRIME} as y2
from (select *, (x * 48271 + r * 69621 + 42) % {stats.PRIME} as y1 from (select *, {{key}} % {stats.PRIME} as x from {{rows}}) one, (select unnest(range({{n}})) as r) two) three) four) five"""


@query(f"""
with rows_ as (select doc_id, cast(quality as double) - toxic as d from labels where quality is not null and toxic is not null), drawn as ({DRAWN_SQL.format(key="doc_id", rows="rows_", n=1000)}),
means as (select r, sum(d * w) / sum(w) as m from drawn group by r), ends as (select quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from means)
select (select count(*) from rows_) as n, round((select avg(d) from rows_), 9) as mean_diff, round(lo, 9) as ci_low, round(hi, 9) as ci_high, lo > 0 or hi < 0 as significant from ends
""")
def bootstrap_ci(spark, sf):
    """Percentile interval of a paired difference, Poisson resampling (G)."""
    out = stats.bootstrap(table(spark, sf, "labels"), "doc_id", F.col("quality") - F.col("toxic"), 1000)
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("mean_diff", "ci_low", "ci_high")), "significant")


@query(f"""
with rows_ as (select o_orderkey, o_custkey % 5 + o_orderkey % 7 as a, o_orderkey % 11 as b, case when o_orderkey % 5 > 0 then o_orderkey % 3 end as c from orders), drawn as ({DRAWN_SQL.format(key="o_orderkey", rows="rows_", n=100)}),
sums as (select r, sum(w * (a - b)) / sum(w) as ab, cast(sum(w * (c - b)) as double) / sum(case when c is not null then w end) as cb, sum(w * a * 1.0) / sum(w * b) - sum(w * coalesce(c, 0) * 1.0) / sum(w * b) as ratio from drawn group by r),
long as (select r, 'ab' as statistic, cast(ab as double) as v from sums union all select r, 'cb', cb from sums union all select r, 'ratio', ratio from sums)
select statistic, round(quantile_cont(v, 0.025), 6) as ci_low, round(quantile_cont(v, 0.975), 6) as ci_high from long group by statistic
""")
def resample_many(spark, sf):
    """Intervals of means with nulls and of a difference of ratios, all from one pass (G)."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5 + F.col("o_orderkey") % 7).alias("a"), (F.col("o_orderkey") % 11).alias("b"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 3).alias("c"))
    sums = stats.resampled(rows, "o_orderkey", {"ab": F.col("a") - F.col("b"), "n": F.lit(1), "cb": F.col("c") - F.col("b"), "cn": F.col("c").isNotNull().cast("int"), "a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, 100)
    out = stats.intervals(sums, {"ab": F.col("ab") / F.col("n"), "cb": F.col("cb") / F.col("cn"), "ratio": F.col("a") / F.col("b") - F.col("c") / F.col("b")})
    return out.select("statistic", r6(F.col("ci_low")).alias("ci_low"), r6(F.col("ci_high")).alias("ci_high"))


# ---- neighbours --------------------------------------------------------------------------------

DOT = "list_dot_product(cast(q.embedding as double[]), cast(p.embedding as double[]))"
RANKED = "(select q.vec_id as query_id, q.label as query_label, p.vec_id as pool_id, p.label, {dot} as score, row_number() over (partition by q.vec_id order by {dot} desc, p.vec_id) as rank from embeddings q join embeddings p on q.vec_id <> p.vec_id{more})"
ALL_SQL, SAME_SQL = RANKED.format(dot=DOT, more=""), RANKED.format(dot=DOT, more=" and q.label = p.label")


def ranked(spark, sf, k: int, bucket: str | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return topk.similar(e, e, "vec_id", "embedding", k, bucket)


def labelled(spark, sf, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    out = ranked(spark, sf, k).join(e.select(F.col("vec_id").alias("pool_id"), "label"), "pool_id")
    return out.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"select query_id, rank, pool_id, round(score, 6) as score from {ALL_SQL} where rank <= 10")
def topk_similarity(spark, sf):
    """Nearest by dot product, itself left out before the cut (E, H)."""
    return ranked(spark, sf, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "pool_id", F.round("score", 6).alias("score"))


@query(f"select query_id, rank, pool_id, round(score, 6) as score from {SAME_SQL} where rank <= 5")
def topk_hop_matched(spark, sf):
    """Candidates restricted to the query's bucket before the cut (E, H)."""
    return ranked(spark, sf, 5, "label").select("query_id", F.col("rank").cast("long").alias("rank"), "pool_id", F.round("score", 6).alias("score"))


VOTE_SQL = f"(select query_id, arg_min(label, (-n, label)) as predicted from (select query_id, label, count(*) as n from {ALL_SQL} where rank <= 5 group by all) group by query_id)"


def voted(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    return topk.vote(labelled(spark, sf, 5), "label", 5).join(e, "query_id")


@query(f"select query_id, cast(predicted as bigint) as predicted from {VOTE_SQL}")
def knn_majority_vote(spark, sf):
    return voted(spark, sf).select("query_id", F.col("predicted").cast("long").alias("predicted"))


@query(f"""
select cast(d.label as bigint) as expected, count(e.vec_id) as total, cast(count(*) filter (e.vec_id is not null and predicted = e.label) as bigint) as correct, round(coalesce(count(*) filter (predicted = e.label) / nullif(count(e.vec_id), 0), 0.0), 6) as recall
from (select unnest(range(0, 11)) as label) d left join embeddings e on e.label = d.label left join {VOTE_SQL} on query_id = e.vec_id group by d.label
""")
def accuracy_per_class(spark, sf):
    out = aggregate.accuracy_by_class(voted(spark, sf), "expected", "predicted", list(range(11)))
    return out.select(F.col("expected").cast("long").alias("expected"), "total", "correct", r6(F.col("recall")).alias("recall"))


@query(f"select cast(label as bigint) as expected, {', '.join(f'cast(count(*) filter (predicted = {i}) as bigint) as p{i}' for i in range(10))} from embeddings join {VOTE_SQL} on query_id = vec_id group by label")
def confusion_matrix(spark, sf):
    out = aggregate.confusion(voted(spark, sf), "expected", "predicted", list(range(10)))
    return out.select(F.col("expected").cast("long").alias("expected"), *(F.col(str(i)).alias(f"p{i}") for i in range(10)))


@query(f"select label || ' -> ' || predicted as pattern, count(*) as \"count\" from embeddings join {VOTE_SQL} on query_id = vec_id where label <> predicted group by all")
def error_patterns(spark, sf):
    return aggregate.error_patterns(voted(spark, sf), "expected", "predicted")


@query(f"""
select cast(query_label as bigint) as query_label, round(avg(score) filter (rank <= 1), 6) as mean_top1, round(avg(score) filter (rank <= 3), 6) as mean_top3, round(avg(score) filter (rank <= 6), 6) as mean_top6, round(min(score) filter (rank = 1), 6) as min_top1, round(max(score) filter (rank = 1), 6) as max_top1,
cast(count(*) filter (rank = 1) as bigint) as n_queries, cast(count(*) filter (rank = 1 and score < 0.5) as bigint) as below_50, cast(count(*) filter (rank = 1 and score < 0.6) as bigint) as below_60, cast(count(*) filter (rank = 1 and score < 0.7) as bigint) as below_70 from {ALL_SQL} group by query_label
""")
def pool_coverage(spark, sf):
    out = topk.coverage(labelled(spark, sf, 6), "query_label")
    return out.select(F.col("query_label").cast("long").alias("query_label"), *(r6(F.col(c)).alias(c) for c in ("mean_top1", "mean_top3", "mean_top6", "min_top1", "max_top1")), "n_queries", "below_50", "below_60", "below_70")


@query(f"""
select query_id, cast(case when bool_or(rank <= 1 and label = query_label) then 5 when bool_or(rank <= 3 and label = query_label) then 3 when bool_or(rank <= 5 and label = query_label) then 1 else 0 end as bigint) as points, round(avg(score) filter (rank <= 3), 6) as mean3 from {ALL_SQL} where rank <= 10 group by query_id
""")
def score_ladder(spark, sf):
    """Points for the first window with the query's bucket, mean of the first scores (N, H)."""
    lists = labelled(spark, sf, 10).groupBy("query_id", "query_label").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("n"))
    return lists.select("query_id", metrics.score_ladder(F.col("query_label"), F.col("n.label"), [(1, 5), (3, 3), (5, 1)]).cast("long").alias("points"), r6(metrics.mean_of_first(F.col("n.score"), 3)).alias("mean3"))


@query("""
with s as (select l_orderkey, l_linenumber, l_discount as a, l_tax as b, round(l_quantity / 1000, 2) as c from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when a = greatest(a, b, c) and b < greatest(a, b, c) and c < greatest(a, b, c) then 1 else 0 end as bigint) as bonus_a, case when a = greatest(a, b, c) then 'a' when b = greatest(a, b, c) then 'b' else 'c' end as best from s
""")
def similarity_bonus(spark, sf):
    """A bonus to the only best mode; the best mode, ties to the first (N, H)."""
    modes = {"a": F.col("l_discount"), "b": F.col("l_tax"), "c": F.round(F.col("l_quantity") / 1000, 2)}
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), metrics.unique_best_bonus(modes, 1)["a"].cast("long").alias("bonus_a"), metrics.best_mode(modes).alias("best"))


@query(f"""
with r as (select query_id, rank as bi_rank, pool_id, score as bi, round(-abs(label - query_label) + score / 10, 6) as s from {ALL_SQL} where rank <= 10)
select query_id, rank, pool_id, score, bi_encoder_score from (select query_id, row_number() over (partition by query_id order by s desc, bi_rank) as rank, pool_id, s as score, round(bi, 6) as bi_encoder_score from r) where rank <= 3
""")
def rerank(spark, sf):
    """A second score, rounded before the sort (H)."""
    out = topk.rerank(labelled(spark, sf, 10), -F.abs(F.col("label") - F.col("query_label")) + F.col("score") / 10, 3)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "pool_id", "score", F.round("bi_encoder_score", 6).alias("bi_encoder_score"))


# ---- samples -----------------------------------------------------------------------------------


@query("select doc_id from labels order by md5('7' || doc_id), doc_id limit 50")
def sample_imbalanced(spark, sf):
    return sampling.exact(table(spark, sf, "labels"), "doc_id", 50, "7").select("doc_id")


TYPES = ["signup", "error", "click", "view", "purchase"]


@query("""
select event_id, event_type, rank as sample_rank from (select event_id, event_type, row_number() over (partition by event_type order by md5('s' || event_id), event_id) as rank from events) where rank <= case when event_type in ('signup', 'error') then 11 else 10 end
""")
def sample_balanced(spark, sf):
    return sampling.balanced(table(spark, sf, "events"), "event_type", "event_id", 52, TYPES, "s").select("event_id", "event_type", F.col("sample_rank").cast("long").alias("sample_rank"))


@query("""
select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by md5('' || event_id), event_id) as rank from events) where rank <= 20
""")
def sample_per_group(spark, sf):
    return sampling.per_group(table(spark, sf, "events"), "event_type", "event_id", 20).select("event_id", "event_type")


@query()
def sample_waterfill(spark, sf):
    """A cap filled up evenly, small groups whole (I); SQL in row_queries."""
    return sampling.capped(table(spark, sf, "labels").withColumn("g", F.col("quality") * 2 + F.col("toxic")), "g", "doc_id", 200).select("doc_id", "g")


@query("select o_orderkey, cast((row_number() over (partition by o_orderpriority order by md5('k' || o_orderkey), o_orderkey) - 1) % 5 as bigint) as fold from orders")
def stratified_kfold(spark, sf):
    return sampling.folds(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 5, "k").select("o_orderkey", F.col("fold").cast("long").alias("fold"))


@query()
def kmeans_representatives(spark, sf):
    return sampling.representatives(table(spark, sf, "embeddings"), "embedding", "vec_id", 50).select("vec_id", "cluster", r6(F.col("distance")).alias("distance"))


@query()
def sweep_pools(spark, sf):
    """Pools of a grid of sizes and balances as one relation (Q)."""
    cells = sweep.grid([50, 100], ["imbalanced", "balanced"])
    return sweep.pools(table(spark, sf, "events").select("event_id", "event_type"), cells, "event_type", "event_id", TYPES)


# ---- joins and sets -----------------------------------------------------------------------------


@query("""
with u as (select 0 as s, event_id as o, user_id, event_type from events where event_type = 'purchase' union all select 1, event_id, user_id, event_type from events),
f as (select user_id, arg_min(event_type, (s, o)) as event_type, min((s, o)) as k from u where user_id is not null group by user_id)
select user_id, event_type, cast(row_number() over (order by k) - 1 as bigint) as "index" from f
""")
def dedup_first_wins(spark, sf):
    """Base and extra rows, later repeats dropped, indexed again (E, J)."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("o")).where("user_id is not null")
    return joins.concat_first_wins([e.where("event_type = 'purchase'"), e], "user_id", "o").select("user_id", "event_type", "index")


@query("""
with u as (select 0 as s, event_id as o from events where event_type = 'click' union all select 1, event_id from events) select o as event_id, cast(row_number() over (order by s, o) - 1 as bigint) as "index" from u
""")
def union_keep_all(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("o"), "event_type")
    return joins.concat_keep_all([e.where("event_type = 'click'"), e], "o").select(F.col("o").alias("event_id"), "index")


@query("""
select d.doc_id, case when d.doc_id % 3 = 0 then 'old' else cast(l.quality as varchar) end as quality, case when d.doc_id % 3 = 0 then 'pre_existing' when l.doc_id is not null then 'enriched' else 'unknown' end as status from documents d left join labels l on d.doc_id = l.doc_id
""")
def enrich_left_fill(spark, sf):
    """Fill what is empty, and say how each row came by its value (E)."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.lit(" ")).alias("quality"))
    return joins.fill_empty(d, table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "quality").select("doc_id", "quality", "status")


@query("""
select 'left' as side, c_custkey as k from customer where c_custkey not in (select o_custkey from orders) union all select 'right', o_custkey from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer)
""")
def except_both_ways(spark, sf):
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return joins.unused(o, c, "k").select(F.lit("left").alias("side"), "k").union(joins.unused(c, o, "k").select(F.lit("right"), "k"))


@query("select count(*) as n_overlap from customer where c_custkey in (select o_custkey from orders)")
def overlap_semi(spark, sf):
    c = table(spark, sf, "customer")
    return c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").agg(F.count("*").alias("n_overlap"))


@query("""
with d as (select o_custkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 60 as e from orders), b as (select *, case when s <= max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as b from d),
g as (select *, sum(b) over (partition by o_custkey order by s, e rows unbounded preceding) as g from b) select o_custkey, cast(min(s) as varchar) as s, cast(max(e) as varchar) as e, count(*) as n from g group by o_custkey, g
""")
def interval_merge(spark, sf):
    """Overlapping intervals as one (O: interval coalescing). Orders without a date stand by themselves, as in the SQL.

    The SQL's two windows leave the order of equal intervals open; where they order them differently, DuckDB tears a merged
    interval apart. With equal ones in one order in both, it gives what this gives."""
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("s")).withColumn("e", F.date_add("s", 60))
    merged = joins.merge_intervals(o.where("s is not null"), "o_custkey", "s", "e").select("o_custkey", "s", "e", "n")
    every = merged.union(o.where("s is null").select("o_custkey", "s", "e", F.lit(1).cast("long")))
    return every.select("o_custkey", F.col("s").cast("string").alias("s"), F.col("e").cast("string").alias("e"), "n")


@query("select doc_id, lang, cast(row_number() over (partition by lang order by doc_id) - 1 as bigint) as \"index\" from documents")
def partitioned_export(spark, sf):
    """Ordinals per stratum, found by ranges rather than one sort per stratum (C)."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    every = joins.reindex(d, ["lang", "doc_id"], "i")
    first = every.groupBy("lang").agg(F.min("i").alias("lo"))
    return every.join(first, "lang").select("doc_id", "lang", (F.col("i") - F.col("lo")).alias("index"))


@query("select doc_id, cast(row_number() over (order by doc_id) - 1 as bigint) as line_no from documents qualify (row_number() over (order by doc_id) - 1) in (0, 5, 17, 99, 150)")
def line_number_lookup(spark, sf):
    """Rows by place, and places that aren't there (D)."""
    from .sources.readers import by_line_number

    every = joins.reindex(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "line_no")
    return by_line_number(every, spark.createDataFrame([(x,) for x in (0, 5, 17, 99, 150, 10**9)], "line_no long"))[0].select("doc_id", "line_no")


# ---- prompts and masks ---------------------------------------------------------------------------


@query("""
select conv_id, string_agg(turn || '. ' || role || ': ' || text, chr(10) || chr(10) order by turn) as prompt from conversations where text is not null and role is not null group by conv_id
""")
def few_shot_prompt(spark, sf):
    """Exemplars of a conversation in order (M)."""
    c = table(spark, sf, "conversations").where("text is not null and role is not null")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    form = lambda x: plans.fill("{n}. {role}: {text}", n=x["turn"], role=x["role"], text=x["text"])
    return rows.select("conv_id", F.array_join(F.transform("t", form), "\n\n").alias("prompt"))


@query("""
select conv_id, string_agg('[' || i || '] ' || role || chr(10) || text, chr(10) || chr(10) order by turn) as context from (select *, row_number() over (partition by conv_id order by turn) as i from conversations where text is not null and role is not null) group by conv_id
""")
def context_render(spark, sf):
    """Paragraphs with their place as number (M)."""
    c = table(spark, sf, "conversations").where("text is not null and role is not null")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lit(None).cast("long").alias("idx"), F.col("role").alias("title"), F.col("text").alias("paragraph_text")))).alias("p"))
    return rows.select("conv_id", plans.render_context(F.col("p")).alias("context"))


@query()
def mask_documents(spark, sf):
    """Dates, numbers and hinted names of whole texts, typed and uniform (O)."""
    return spread(table(spark, sf, "documents"), "doc_id").select("doc_id", masking.mask_both(F.col("text")).alias("m")).select("doc_id", "m.typed", "m.uniform")


def part_words(spark, sf) -> DataFrame:
    """Words of part names and names of nations."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return words.union(table(spark, sf, "nation").select("n_name")).where("name <> ''").distinct()


@query("""
with names as (select distinct name from (select unnest(string_split(p_name, ' ')) as name from part union all select n_name from nation) where name <> ''), texts as materialized (select lower(text) as t from documents where text is not null)
select name, exists (select 1 from texts where contains(t, lower(name))) as occurs from names
""")
def names_in_documents(spark, sf):
    """Which names occur anywhere in the documents, in any case (O)."""
    names = part_words(spark, sf)
    found = masking.names_in_corpus(names, spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")).withColumn("occurs", F.lit(True))
    return names.join(found, "name", "left").select("name", F.coalesce("occurs", F.lit(False)).alias("occurs"))


@query()
def mask_names(spark, sf):
    """Names of nations, and words of part names, masked in whole documents (O; an automaton that workers map)."""
    names = part_words(spark, sf).withColumn("placeholder", F.when(F.upper("name") == F.col("name"), "[PLACE]").otherwise("[THING]"))
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", masking.name_mask(names)("text").alias("masked"))


@query("""
with o as (select o_orderkey, o_custkey, c_nationkey, n_regionkey from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey), x as (
select o_orderkey as item_id, 1 as step, 'customer of order ' || o_orderkey as prompt, coalesce(cast(o_custkey as varchar), '') as answer, 0 as n_unresolved from o
union all select o_orderkey, 2, 'nation of customer ' || coalesce(cast(o_custkey as varchar), '[#1]'), coalesce(cast(c_nationkey as varchar), ''), case when o_custkey is null then 1 else 0 end from o
union all select o_orderkey, 3, 'region of nation ' || coalesce(cast(c_nationkey as varchar), '#2'), coalesce(cast(n_regionkey as varchar), ''), case when c_nationkey is null then 1 else 0 end from o where o_orderkey % 2 = 0
union all select o_orderkey, 4, 'capital of [#3] and [#7]', '', 2 from o where o_orderkey % 2 = 0 and n_regionkey is null union all select o_orderkey, 4, 'capital of ' || n_regionkey || ' and [#7]', '', 1 from o where o_orderkey % 2 = 0 and n_regionkey is not null)
select item_id, step, prompt, answer, n_unresolved, concat_ws(',', case when n_unresolved > 0 then 'broken_reference' end, case when answer = '' then 'empty_answer' end) as flags from x
""")
def run_step_plans(spark, sf):
    """Steps run in rounds over a table of facts: who ordered, where they live, in which region (P); the last has no answer."""
    orders, customers, nations = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    fact = lambda df, about, key, value: df.select(F.concat(F.lit(about), F.col(key).cast("string")).alias("prompt"), F.col(value).cast("string").alias("answer"))
    facts = fact(orders, "customer of order ", "o_orderkey", "o_custkey").union(fact(customers, "nation of customer ", "c_custkey", "c_nationkey")).union(fact(nations, "region of nation ", "n_nationkey", "n_regionkey"))
    order = F.concat(F.lit("customer of order "), F.col("o_orderkey").cast("string"))
    short = F.array(order, F.lit("nation of customer [#1]"))
    steps = F.when(F.col("o_orderkey") % 2 == 0, F.concat(short, F.array(F.lit("region of nation #2"), F.lit("capital of [#3] and [#7]")))).otherwise(short)
    out = models.run_steps(orders.select(F.col("o_orderkey").alias("item_id"), steps.alias("steps")), lambda prompts: prompts.join(facts, "prompt").withColumn("error", F.lit(None).cast("string")))
    return out.select("item_id", "step", "prompt", "answer", F.size("unresolved").alias("n_unresolved"), F.array_join("flags", ",").alias("flags"))


@query()
def embed_texts(spark, sf):
    """Stand-in embeddings of whole texts (P)."""
    return table(spark, sf, "documents").select("doc_id", models.embed_udf()("text").alias("embedding"))


# ---- sources and validation --------------------------------------------------------------------


@query("""
with i as (select conv_id // 50 as b, conv_id, turn, conv_id // 50 % 2 = 0 as versioned, text is null as lacks, case when turn % 7 <> 3 then conv_id || '_' || turn // 2 end as id from conversations where conv_id is not null and turn is not null),
twice as (select b, id, count(*) as n from i where versioned and id is not null group by b, id having count(*) > 1)
select 'missing' as problem, count(*) as n from i where lacks group by 1 union all select 'no_id', count(*) from i where versioned and id is null group by 1 union all select 'repeated_id', cast(sum(n - 1) as bigint) from twice group by 1
union all select 'good', count(*) from i where not lacks and (not versioned or id is not null and not exists (select 1 from twice t where t.b = i.b and t.id = i.id)) group by 1
""")
def versioned_results(spark, sf):
    """Result files of both versions, written from the conversations (fifty to a file) and read back: rows that are sound, and
    all problems of the others (A)."""
    rows = table(spark, sf, "conversations").where("conv_id is not null and turn is not null").withColumn("b", F.expr("conv_id div 50"))
    item_id = F.when((F.col("b") % 2 == 0) & (F.col("turn") % 7 != 3), F.concat_ws("_", "conv_id", F.expr("turn div 2")))
    item = F.to_json(F.struct(item_id.alias("item_id"), F.length("text").alias("m"), F.col("turn").alias("k")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", item.alias("j")))), lambda x: x["j"]), ",")
    head = '{"schema": "v2", "composite_score_weights": {"step_f1": 0.4}, "composite_step_count_error_scale": 3.0, "items": ['
    files = rows.groupBy("b").agg(listed.alias("items")).select("b", F.when(F.col("b") % 2 == 0, F.concat(F.lit(head), "items", F.lit("]}"))).otherwise(F.concat(F.lit("["), "items", F.lit("]"))).alias("value"))
    folder = runtime.new_folder(spark, "result-files")
    files.write.partitionBy("b").text(folder)
    found = result_files.read(spark, folder, ["m", "k"], "position")
    return found.problems.groupBy("problem").agg(F.count("*").alias("n")).union(found.rows.agg(F.lit("good"), F.count("*")).where("`count(1)` > 0"))


@query("""
with r as (select conv_id, case when turn % 3 > 0 then turn end as hops, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') as steps from conversations),
m as (select *, not coalesce(len(steps) > 0, false) as bare, coalesce(hops > 0 and hops <> len(steps), false) as differ from r), k as (select conv_id, count(*) as n from m where conv_id is not null group by conv_id)
select 'no_steps' as problem, count(*) as n from m where bare group by 1 union all select 'denominators_differ', count(*) from m where differ group by 1 union all select 'repeated_key', count(*) from k where n > 1 group by 1 union all select 'no_key', count(*) from m where conv_id is null group by 1
union all select 'pinned_but_missing', count(*) from (select distinct doc_id from labels where doc_id % 10 = 0) p where not exists (select 1 from k where k.conv_id = p.doc_id) group by 1
union all select 'good', count(*) from m where not bare and not differ and conv_id in (select conv_id from k where n = 1) and conv_id in (select doc_id from labels where doc_id % 10 = 0) group by 1
""")
def validate_gold(spark, sf):
    """Gold with two denominators, repeated keys and pinned ids: all problems from one pass (A, B)."""
    steps = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf, "conversations").select("conv_id", F.when(F.col("turn") % 3 > 0, F.col("turn")).cast("int").alias("hops"), steps.alias("steps"))
    pinned = table(spark, sf, "labels").where("doc_id % 10 = 0").select(F.col("doc_id").alias("conv_id"))
    report = validation.gold(rows, "conv_id", "steps", "hops", pinned=pinned)
    return report.summary().union(report.rows.agg(F.lit("good"), F.count("*")).where("`count(1)` > 0"))


@query("""
with h as (select vec_id, label, vec_id % 7 as file from embeddings), p as (select label, count(*) as n from embeddings where vec_id % 3 = 0 group by label),
a as (select file, label, count(*) as n_queries, max(case when vec_id % 3 = 0 then 1 else 0 end) as own from h where vec_id % 10 = 0 group by file, label)
select file, a.label as label, n_queries, greatest(coalesce(n, 0) - own, 0) as n_candidates, a.label is not null and greatest(coalesce(n, 0) - own, 0) >= 15 as feasible,
case when a.label is null then 'no_bucket' when greatest(coalesce(n, 0) - own, 0) = 0 then 'empty_bucket' when greatest(coalesce(n, 0) - own, 0) < 15 then 'too_few' end as problem from a left join p on a.label = p.label
""")
def candidate_plan(spark, sf):
    """What restricted searches will find, from counts alone (Q: plan-only mode)."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("file"))
    plan = feasibility.candidates(rows.where("vec_id % 10 = 0"), rows.where("vec_id % 3 = 0"), ["file"], "label", 15, F.col("vec_id") % 3 == 0)
    return plan.withColumn("n_candidates", F.col("n_candidates").cast("long"))


@query("""
with sampled as (select doc_id, lang, n_chars from documents where doc_id % 3 <> 1), counted as (select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from sampled group by lang)
select lang, n, chars, n >= 20 as enough from counted
""")
def staged_counts(spark, sf):
    """Two stages over the documents, stored by content and read back (Q); a second graph over the same sources makes none."""
    root = runtime.new_folder(spark, "stages")

    def graph() -> stages.Graph:
        g = stages.Graph(spark, root, {"documents": f"{sf}/documents.parquet"})
        g.add("sampled", lambda docs, left: docs.where(F.coalesce(F.col("doc_id") % 3 != left, F.lit(False))).select("doc_id", "lang", "n_chars"), ["documents"], left=1)
        return g.add("counted", lambda rows: rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), ["sampled"])

    graph().table("counted")
    again = graph()
    return again.table("counted").select("lang", "n", "chars", ((F.col("n") >= 20) & F.lit(not again.made)).alias("enough"))
