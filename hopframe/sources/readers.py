"""Scans of JSON lines, JSON arrays, text, CSV and triples, with the order of lines where it matters.

Line numbers are those of the text files: files in name order, lines by their place. They come from the reader's file
splits, counted range by range, so a file is not read by one task alone."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no from 0 over all files, value) of text files, blank lines included."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"))
    placed = raw.withColumn("i", F.monotonically_increasing_id())
    counts = placed.groupBy("file", "b").agg(F.count("*").alias("n"), F.min("i").alias("lo"))
    before = F.sum("n").over(Window.orderBy("file", "b").rowsBetween(Window.unboundedPreceding, -1))  # one row per split
    starts = counts.select("file", "b", "lo", F.coalesce(before, F.lit(0)).alias("s"))
    return placed.join(starts, ["file", "b"]).select("file", (F.col("s") + F.col("i") - F.col("lo")).alias("line_no"), "value")


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a line that isn't such an object fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_ordered(spark: SparkSession, path: str | list[str], schema: str, limit: int | None = None) -> DataFrame:
    """Rows with line_no, the first `limit` non-blank lines only if that is given."""
    rows = lines(spark, path).where(F.trim("value") != "")
    if limit is not None:
        rows = rows.orderBy("line_no").limit(limit)
    return rows.select("file", "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "line_no", "r.*")


def jsonl_permissive(spark: SparkSession, path: str | list[str], schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required keys, one row bad_rows). A key that is there with null counts as there."""
    rows = lines(spark, path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    good = keys.isNotNull()
    for k in required:
        good = good & F.array_contains(keys, k)
    marked = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    kept = marked.where("good").select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")
    return kept, marked.agg(F.count_if(~F.col("good")).alias("bad_rows"))


def text_questions(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines with line_no; a missing file is empty."""
    try:
        return lines(spark, path).select("line_no", F.trim("value").alias("question")).where(F.col("question") != "")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line_no long, question string")


def per_hop(spark: SparkSession, template: str, hops: list[int]) -> DataFrame:
    """Union of template files, {hop} filled in, tagged with their hop."""
    out = None
    for h in hops:
        part = text_questions(spark, template.replace("{hop}", str(h))).withColumn("hop", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def questions(spark: SparkSession, path: str, form: str, id_field: str = "id", question_field: str = "question") -> DataFrame:
    """(line_no, query_id, question) of "lines" (no ids) or "jsonl". A row without a question that is a text is an error,
    as are a missing file of rows and one without any; a missing file of lines is empty."""
    if form == "lines":
        return text_questions(spark, path).select("line_no", F.lit(None).cast("string").alias("query_id"), "question")
    if form != "jsonl":
        raise ConfigError(f"questions are lines or jsonl, not {form}")
    raw = lines(spark, path).where(F.trim("value") != "").select("line_no", F.try_parse_json("value").alias("row"))
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    field = lambda name: F.try_variant_get("row", f"$['{name}']", "string")
    text = F.schema_of_variant(F.try_variant_get("row", f"$['{question_field}']", "variant")) == "STRING"
    usable = F.when(text & (F.trim(field(question_field)) != ""), F.trim(field(question_field)))
    bad = F.raise_error(F.concat(F.lit(f"{path}: no usable {question_field} in line "), F.col("line_no"))).cast("string")
    return raw.select("line_no", field(id_field).alias("query_id"), F.coalesce(usable, bad).alias("question"))


def retrieval(spark: SparkSession, path: str, id_field: str = "query_id") -> DataFrame:
    """`questions` with expected_hop, which the id begins with; ids without one are an error."""
    rows = questions(spark, path, "jsonl", id_field)
    hop = F.regexp_extract(F.coalesce("query_id", F.lit("")), r"^(\d+)hop", 1).try_cast("int")
    bad = F.raise_error(F.concat(F.lit(f"{path}: no hop in the id of line "), F.col("line_no"))).cast("int")
    return rows.withColumn("expected_hop", F.coalesce(hop, bad))


def files(spark: SparkSession, root: str, pattern: str, but: str | None = None) -> list[str]:
    """Sorted paths that match a pattern below root (absolute patterns as they are); ** is any depth. With `but`, files
    whose names end so are left out, and none left is an error."""
    whole = pattern if pattern.startswith("/") or "://" in pattern else f"{root.rstrip('/')}/{pattern}"
    head, deep, name = whole.partition("/**/")
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", bool(deep))
        df = df.option("pathGlobFilter", name).load(head) if deep else df.load(whole)
        found = sorted(r[0] for r in df.select("path").collect())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    if but is None:
        return found
    found = [f for f in found if not f.endswith(but)]
    if not found:
        raise ConfigError(f"no files match {whole}")
    return found


def zipped(spark: SparkSession, questions: str, answers: str, separator: str = "|") -> DataFrame:
    """Questions and answer sets, line by line after blank lines are dropped; different lengths are refused."""
    from ..operators.joins import reindex

    q = reindex(text_questions(spark, questions), ["line_no"], "at").select("at", "question")
    a = reindex(text_questions(spark, answers), ["line_no"], "at").select("at", F.col("question").alias("raw"))
    both = q.join(a, "at", "full_outer")
    if both.where("question is null or raw is null").limit(1).count():
        raise ValueError(f"{questions} and {answers} differ in length")
    parts = F.transform(F.split("raw", "\\" + separator), lambda x: F.trim(x))
    return both.select("at", "question", F.array_distinct(F.filter(parts, lambda x: x != "")).alias("answers"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_items(spark: SparkSession, path: str, item: str, header: str = "") -> DataFrame:
    """Items of {..., "items": [...]} with the header's fields."""
    names = [x.split()[0] for x in header.split(",") if x.strip()]
    df = spark.read.schema((header + ", " if header else "") + f"items array<struct<{item}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(*names, F.inline("items"))


def pool(spark: SparkSession, path: str, keys: list[str], item: str) -> DataFrame:
    """(hop_key, pos, fields) of {"1hop": [...], ...}; other keys are left out."""
    df = spark.read.schema(", ".join(f"`{k}` array<{item}>" for k in keys)).option("multiLine", True).json(path)
    out = None
    for k in keys:
        part = df.select(F.lit(k).alias("hop_key"), F.posexplode(k).alias("pos", "r")).select("hop_key", "pos", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def csv_runs(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Rows with an integer size; a trial that isn't one is 0, metrics that aren't numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.withColumn("size", F.col("size").try_cast("int")).where("size is not null")
    rows = rows.withColumn("trial", F.coalesce(F.col("trial").try_cast("int"), F.lit(0)))
    return rows.withColumns({m: F.col(m).try_cast("double") if m in raw.columns else F.lit(None).cast("double") for m in metrics})


def run_metrics(spark: SparkSession, root: str, schema: str, name: str = "metrics.json", archived: str = "archived") -> DataFrame:
    """Metrics of all runs below root with run_id (their folder); archived ones are left out."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    path = F.col("_metadata.file_path")
    return df.withColumn("run_id", F.element_at(F.split(path, "/"), -2)).where(~F.contains(path, F.lit(archived))).orderBy("run_id")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, size) of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def by_line_number(df: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose line_no is wanted, and the numbers that aren't there."""
    return df.join(wanted, "line_no", "left_semi"), wanted.join(df, "line_no", "left_anti")


def coerce_question(question: Column) -> Column:
    return F.coalesce(question.cast("string"), F.lit(""))


# ---- configuration (driver side) ----


class ConfigError(ValueError):
    pass


class Config:
    """A JSON object with dotted access and no defaults."""

    def __init__(self, tree: dict):
        self.tree = tree

    @classmethod
    def load(cls, path: str | Path) -> Config:
        tree = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(tree, dict):
            raise ConfigError(f"{path} isn't an object")
        return cls(tree)

    def require(self, key: str):
        node = self.tree
        for part in key.split("."):
            if not isinstance(node, dict) or part not in node:
                raise ConfigError(f"{key} is missing")
            node = node[part]
        return node

    def optional(self, key: str, default=None):
        try:
            return self.require(key)
        except ConfigError:
            return default

    def overlay(self, other: dict, allowed: set[str] | None = None) -> Config:
        unknown = set(other) - (allowed if allowed is not None else set(self.tree))
        if unknown:
            raise ConfigError(f"unknown keys {sorted(unknown)}")
        return Config({**self.tree, **other})


class Catalog:
    """Names of tables to paths, registered as views on demand."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root, names

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            raise ConfigError(f"unknown table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def register(self) -> None:
        for n in self.names:
            self.table(n).createOrReplaceTempView(n)
