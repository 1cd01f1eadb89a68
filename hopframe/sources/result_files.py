"""Per-item result files of two versions as one relation, with all their problems as another.

A versioned file is a JSON object with `schema`, the composite's weights and scale, and `items`; a legacy one is a bare
JSON list, without weights and without ids. Every file is read once, as text; its form is decided by what it parses as,
and its rows stay variants until their fields are cast, so one bad field costs that row and nothing else. What is wrong
is said for every row and field, not for the first alone; a row that has any problem isn't among the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..functions.ids import redacted
from ..functions.text import normalize_question

OBJECT = "schema string, composite_score_weights map<string,double>, composite_step_count_error_scale double, items array<variant>"
ALIGNMENTS = ("question", "position")


@dataclass
class Results:
    rows: DataFrame  # file, form, row, item_id, question, the metrics
    problems: DataFrame  # file, row (null: of the file), problem, detail
    headers: DataFrame  # file, form, n_rows, schema, weights, scale, stated


def _field(name: str) -> Column:
    return F.try_variant_get("item", f"$['{name}']", "variant")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("")), r"^(\w*)", 1)


def read(spark: SparkSession, path: str, metrics: list[str], alignment: str | None = None, weights: dict[str, float] | None = None, scale: float | None = None) -> Results:
    """Rows with all `metrics` as finite numbers (whole numbers, fractions and decimals are; text, truth values and null
    aren't).

    alignment says how legacy rows get their ids: "question" (the normalized text) or "position" (their place in the
    file); without it legacy files are refused. weights and scale are what their composite is to be computed with, which
    the headers mark as not stated by the file. Files that are empty, no JSON or of neither form, objects without items,
    weights or scale, and ids that occur twice in a file are problems; the ids of legacy rows are shown hashed, since they
    are texts of a dataset."""
    if alignment is not None and alignment not in ALIGNMENTS:
        raise ValueError(f"rows are aligned by {' or '.join(ALIGNMENTS)}, not {alignment}")
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = texts.select("file", F.from_json("value", "array<variant>").alias("bare"), F.from_json("value", OBJECT).alias("o"), F.try_parse_json("value").isNotNull().alias("json"))
    stated = F.col("o.composite_score_weights").isNotNull() & F.col("o.composite_step_count_error_scale").isNotNull()
    form = F.when(F.col("bare").isNotNull(), "legacy").when(F.col("o.items").isNotNull(), "versioned")
    wrong = (
        F.when(F.col("bare").isNotNull(), F.lit(None if alignment else "legacy_without_alignment"))
        .when(~F.col("json"), "not_json").when(F.col("o.items").isNull(), "no_items").when(~stated, "no_weights")
    )
    files = parsed.select(
        "file", form.alias("form"), wrong.alias("wrong"), F.col("o.schema").alias("schema"), stated.alias("stated"),
        F.coalesce("o.composite_score_weights", F.create_map(*(F.lit(x) for kv in (weights or {}).items() for x in kv)).cast("map<string,double>")).alias("weights"),
        F.coalesce("o.composite_step_count_error_scale", F.lit(scale).cast("double")).alias("scale"),
        F.when(wrong.isNull(), F.coalesce("bare", "o.items")).alias("items"),
    )
    files = runtime.stored(files.withColumn("stated", F.coalesce("stated", F.lit(False)) & (F.col("form") == "versioned")), "files")

    items = files.select("file", "form", F.posexplode("items").alias("row", "item"))
    question = F.when(_kind(_field("question")) == "STRING", F.trim(F.try_variant_get("item", "$.question", "string")))
    given = F.try_variant_get("item", "$.item_id", "string")
    legacy = F.when(F.length(question) > 0, normalize_question(question)) if alignment == "question" else F.concat(F.lit("row_"), F.lpad(F.col("row").cast("string"), 8, "0"))
    value = {m: F.try_variant_get("item", f"$['{m}']", "double") for m in metrics}
    finite = lambda m: _kind(_field(m)).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT") & ~F.isnan(value[m]) & (F.abs(value[m]) < float("inf"))
    object_ = _kind(F.col("item")) == "OBJECT"
    problem = lambda name, detail: F.struct(F.lit(name).alias("problem"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    said = [
        F.when(~object_, problem("not_an_object", _kind(F.col("item")))),
        F.when(object_ & (F.col("form") == "versioned") & (F.coalesce(given, F.lit("")) == ""), problem("no_id", "item_id")),
        *(F.when(object_ & _field(m).isNull(), problem("missing", m)) for m in metrics),
        *(F.when(object_ & _field(m).isNotNull() & ~F.coalesce(finite(m), F.lit(False)), problem("not_a_number", m)) for m in metrics),
    ]
    if alignment == "question":
        said.append(F.when(object_ & (F.col("form") == "legacy") & legacy.isNull(), problem("no_question", "question")))
    rows = items.select(
        "file", "form", F.col("row").cast("long").alias("row"), F.when(F.col("form") == "legacy", legacy).otherwise(given).alias("item_id"), question.alias("question"),
        *(value[m].alias(m) for m in metrics), F.array_compact(F.array(*said)).alias("\x00said"),
    )
    rows = runtime.stored(rows, "results")
    named = rows.where("item_id is not null")
    twice = named.groupBy("file", "item_id").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    shown = F.when(F.col("form") == "legacy", redacted(F.col("item_id"))).otherwise(F.col("item_id"))
    repeated = named.join(twice, ["file", "item_id"]).where(F.col("row") > F.col("first")).select("file", "row", F.lit("repeated_id").alias("problem"), F.concat(shown, F.lit(" of row "), F.col("first").cast("string")).alias("detail"))
    each = rows.select("file", "row", F.explode("\x00said").alias("s")).select("file", "row", "s.*")
    whole = files.where("wrong is not null").select("file", F.lit(None).cast("long").alias("row"), F.col("wrong").alias("problem"), F.lit(None).cast("string").alias("detail"))
    good = rows.where(F.size("\x00said") == 0).join(twice.select("file", "item_id"), ["file", "item_id"], "left_anti")
    headers = files.select("file", "form", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_rows"), "schema", "weights", "scale", "stated")
    return Results(good.select("file", "form", "row", "item_id", "question", *metrics), whole.union(each).union(repeated), headers)
