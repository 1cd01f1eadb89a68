"""Training sets of decompositions: rows checked and projected, with what was dropped and why; selections by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import checks

REASONS = ["missing_id", "missing_question", "missing_steps"]


def _filled(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def examine(rows: DataFrame, steps: Column, item_id: str = "id", question: str = "question", hop_count: str = "hop_count") -> DataFrame:
    """Rows with row_id, question, steps, hop, hops_disagree and drop_reason: the first of REASONS that holds, null for
    rows that are kept. The hop is the field's where it is a depth, else the id's, else the number of steps."""
    field = F.when(checks.hop_depth(F.col(hop_count)), F.col(hop_count).try_cast("int"))
    out = rows.select("*", _filled(F.col(item_id)).alias("row_id"), F.trim(question).alias("\x00q"), F.coalesce(steps, F.array().cast("array<string>")).alias("\x00s"), field.alias("\x00f"))
    reason = F.when(F.col("row_id").isNull(), REASONS[0]).when(F.coalesce(_filled(F.col("\x00q")), F.lit("")) == "", REASONS[1]).when(F.size("\x00s") == 0, REASONS[2])
    depths = F.filter(F.array(F.col("\x00f"), ids.hop(F.col("row_id")), F.size("\x00s")), lambda h: h.isNotNull())
    return out.select(
        "row_id", F.col("\x00q").alias("question"), F.col("\x00s").alias("steps"), F.get(depths, F.lit(0)).alias("hop"),
        (reason.isNull() & (F.size(F.array_distinct(depths)) > 1)).alias("hops_disagree"), reason.alias("drop_reason"),
    )


def examples(examined: DataFrame) -> DataFrame:
    return examined.where("drop_reason is null").select("row_id", "question", "steps", "hop", "hops_disagree")


def drops(examined: DataFrame) -> DataFrame:
    """One row of counters: rows_in, dropped_* for each reason, kept, hop_disagreements."""
    return examined.agg(
        F.count("*").alias("rows_in"), *(F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in REASONS),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if("hops_disagree").alias("hop_disagreements"),
    )


def select_hops(rows: DataFrame, hops: list[int]) -> DataFrame:
    """Examples of the given depths; labels that disagree are refused, since the selection rests on them."""
    checks.require(rows, {"hops agree": ~F.col("hops_disagree")}, F.col("row_id"))
    return rows.where(F.col("hop").isin(hops))


def prompt_completion(rows: DataFrame, template: str, bracket: bool = True, numbered: bool = True) -> DataFrame:
    """row_id, prompt, completion; the template has {question} and may have {hop_count}."""
    from ..functions.plans import fill

    prompt = fill(template, question=F.col("question"), hop_count=F.col("hop"))
    return rows.select("row_id", prompt.alias("prompt"), text.format_completion(F.col("steps"), bracket, numbered).alias("completion"))
