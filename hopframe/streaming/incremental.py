"""Scores of arriving predictions and running aggregates, as Structured Streaming. The batch functions are used as they are:
row-level scores are stateless, gold is a static side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..plans import evaluation


def score_stream(predictions: DataFrame, gold: DataFrame, with_ged: bool = False) -> DataFrame:
    """A streaming DataFrame (question, steps) scored against static gold (question, steps)."""
    rows = joins.by_question(predictions, gold).where("gold_found")
    return evaluation.score(rows, with_ged)


def running_accuracy(stream: DataFrame, ts: str, width: str, late: str, expected: str, predicted: str) -> DataFrame:
    """Accuracy per window of event time; rows later than the watermark are dropped by it."""
    hit = (F.col(expected) == F.col(predicted)).cast("int")
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.sum(hit).alias("correct"))


def append_new(path: str, key: str, identity: list[str]):
    """A foreachBatch function: rows of keys that are there already are skipped, so a replayed batch adds nothing."""
    from ..sources.sinks import append_guarded

    def write(batch: DataFrame, batch_id: int) -> None:
        append_guarded(batch, path, key, identity)

    return write
