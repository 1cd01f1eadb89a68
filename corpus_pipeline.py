"""The corpus pipeline: language ID, near duplicates, repeated substrings, benchmark leaks, packing.

Each stage works on all rows that its predecessor kept and returns the columns of `documents` (the last one: packed
pieces). Stages handle nulls, empty texts, repeated rows and empty tables as their operators' docstrings say. Rows
are told apart by their place in the stored input, so a repeated doc_id is no hindrance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import common, decontaminate, encoding, jaccard, language, packing, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE = 0.5  # of a text's letters in words of one language
SHORTEST = 1  # characters that must be left of a text from which repeats were cut


def _own(docs: DataFrame) -> DataFrame:
    common.make_importable(docs.sparkSession)
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts of which at least half is in one language. The rows' own labels, where they are, train the model. Null and
    empty texts, and texts without a letter, go; repeated rows are judged alike, each by itself."""
    docs = _own(docs)
    labelled = language.label(docs, language.learn(docs), *(c for c in COLUMNS if c != "text"), F.col("text").alias("whole"))
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("doc_id", F.col("whole").alias("text"), "lang", "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id (nulls last), then the first. Groups are
    components of a Jaccard similarity of 0.8 or more of five-word shingles."""
    docs = _own(docs)
    rows = common.stage(jaccard.similar(docs, words=5, percent=80, count=False), "similar")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"))
    return _keep(docs, first.select(F.col("first.row_id").alias("row_id")))


def _keep(docs: DataFrame, wanted: DataFrame, drop: bool = False) -> DataFrame:
    """The rows of docs whose row_id is (drop: isn't) in wanted, filtered where they are scanned."""
    import numpy as np
    import pyarrow as pa

    source = common.with_row_id(docs, *COLUMNS)
    path = common.side_table(wanted, "kept", source)

    def rows(batches):
        pid, some = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                side = common.load_side(path, pid)
                some = np.empty(0, np.int64) if side is None else side["row_id"].to_numpy()
            mark = np.isin(batch.column(0).to_numpy(), some)
            yield batch.filter(pa.array(mark != drop)).select(range(1, batch.num_columns))

    return source.mapInArrow(common.tidy(rows), docs.schema)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that also start elsewhere; broken characters at the cuts go too. Texts without a
    visible character left go."""
    docs = _own(docs)
    cut = substrings.remove_repeats(docs, 200, keep=("lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(_valid("kept"))
    rows = cut.select("doc_id", text.alias("text"), "lang", "source", "n_chars", "n_removed")
    rows = rows.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) >= SHORTEST))
    return rows.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"))


def _valid(column: str):
    """The bytes as text, without what isn't whole characters."""
    return F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("\ufffd"), F.lit(""))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none and stay; of repeated rows all go."""
    docs = _own(docs)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, found.select("row_id").distinct(), drop=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens. Null and empty texts are their end id alone;
    repeated rows are packed as often as they occur."""
    docs = _own(docs)
    return packing.pack(docs, encoding.public_path("byte_bpe_50k.json"), 0, 2048, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again."""
    common.make_importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None  # components, longest common subsequences and tokenizers aren't expressible
