"""Triples as an edge table, and execution of many plans at once as joins, one round for each step number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions.plans import REVERSE


def parse_triples(lines: DataFrame, ordinal: str = "line_no") -> DataFrame:
    """(line_no, src, rel, dst) of "a|b|c" lines; blank lines are skipped, others must have three non-empty parts."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    real = lines.where(F.trim("value") != "").withColumn("p", parts)
    good = (F.size("p") == 3) & F.forall("p", lambda x: x != "")
    checked = F.when(good, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("malformed triple: "), F.col("value"))).cast("array<string>"))
    return real.withColumn("p", checked).select(ordinal, *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("src", "rel", "dst"))))


def entity_ids(triples: DataFrame, ordinal: str = "line_no") -> DataFrame:
    """(name, id): dense ids in order of first appearance, subject before object."""
    from .joins import reindex

    both = triples.select(F.col("src").alias("name"), (F.col(ordinal) * 2).alias("o")).union(triples.select("dst", F.col(ordinal) * 2 + 1))
    return reindex(both.groupBy("name").agg(F.min("o").alias("first")), ["first"], "id").select("name", "id")


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("rel").agg(F.count("*").alias("n"))


def execute(plans: DataFrame, triples: DataFrame, max_steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """plans (item_id, ops array<struct<op, relation, entity, ref_step>>) -> answers (item_id, answer), status (item_id,
    status, reason).

    Every round joins all plans' k-th steps to the edges at once. Steps' results are distinct; the last step's are the
    answers. An entity that isn't in the graph, or a reference to a step that isn't before, fails the plan. Each round is
    stored once, so no plan grows with the number of steps and nothing stays cached."""
    edges = triples.select("src", "rel", "dst").distinct()
    ways = F.array(F.struct(F.lit(False).alias("back"), F.col("src").alias("value"), F.col("dst").alias("to")), F.struct(F.lit(True).alias("back"), F.col("dst").alias("value"), F.col("src").alias("to")))
    hops = edges.select(F.col("rel").alias("relation"), F.explode(ways).alias("w")).select("relation", "w.*")
    hops = runtime.stored(hops, "hops")
    steps = plans.select("item_id", F.size("ops").alias("n_steps"), F.posexplode("ops").alias("pos", "o"))
    steps = steps.select("item_id", "n_steps", (F.col("pos") + 1).alias("step"), "o.op", "o.relation", "o.entity", "o.ref_step")
    steps = runtime.stored(steps, "steps")
    last = max_steps or (steps.agg(F.max("step")).first()[0] or 0)

    names = hops.select(F.col("value").alias("entity")).distinct().withColumn("known", F.lit(True))
    seen = steps.join(names, "entity", "left")
    unknown = seen.where(F.col("entity").isNotNull() & F.col("known").isNull()).select("item_id", "step", F.lit("entity_not_in_kb").alias("reason"))
    loose = seen.where(F.col("entity").isNull() & (F.col("ref_step").isNull() | (F.col("ref_step") < 1) | (F.col("ref_step") >= F.col("step")))).select("item_id", "step", F.lit("bad_reference_or_plan").alias("reason"))
    empty = plans.where(F.coalesce(F.size("ops"), F.lit(0)) < 1).select("item_id", F.lit(1).alias("step"), F.lit("bad_reference_or_plan").alias("reason"))
    failed = unknown.unionByName(loose).unionByName(empty).groupBy("item_id").agg(F.min_by("reason", "step").alias("reason"))
    failed = runtime.stored(failed, "failed")
    sound = runtime.stored(steps.join(failed.select("item_id"), "item_id", "left_anti"), "sound")

    done: list[DataFrame] = []
    for k in range(1, last + 1):
        now = sound.where(F.col("step") == k)
        given = now.where(F.col("entity").isNotNull()).select("item_id", "n_steps", "step", "op", "relation", F.col("entity").alias("value"))
        frontier = given
        if done:
            earlier = reduce(DataFrame.unionByName, done).select("item_id", F.col("step").alias("ref_step"), "value")
            refs = now.where(F.col("entity").isNull()).select("item_id", "n_steps", "step", "op", "relation", "ref_step")
            frontier = given.unionByName(refs.join(earlier, ["item_id", "ref_step"]).drop("ref_step"))
        frontier = frontier.withColumn("back", F.col("op") == REVERSE)
        found = frontier.join(hops, ["value", "relation", "back"]).select("item_id", "n_steps", "step", F.col("to").alias("value"))
        done.append(runtime.stored(found.distinct(), f"step-{k}"))  # later steps and the answers read it again
    if not done:
        answers = plans.select("item_id", F.lit("").alias("answer")).limit(0)
    else:
        answers = reduce(DataFrame.unionByName, done).where(F.col("step") == F.col("n_steps")).select("item_id", F.col("value").alias("answer"))
    status = plans.select("item_id").join(failed, "item_id", "left").select("item_id", F.when(F.col("reason").isNull(), "executed").otherwise("exec_fail").alias("status"), "reason")
    return answers, status


def score_answers(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold item (item_id, gold array): jaccard and exact of its distinct answers; items without answers count as
    empty sets."""
    from ..functions.metrics import jaccard

    sets = answers.groupBy("item_id").agg(F.collect_set("answer").alias("pred"))  # one item's answers
    both = gold.join(sets, "item_id", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))
    return both.withColumn("jaccard", jaccard(F.col("pred"), F.array_distinct("gold"))).withColumn("exact", F.col("jaccard") >= 1.0)
