"""Hooks for models: batches of texts through a callable, as Arrow-batched UDFs. Without a model, hashed features stand in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime


def needs_prefix(model_id: str) -> bool:
    """Models of the e5 family want "query: " and "passage: "."""
    return "e5" in model_id.lower().rsplit("/", 1)[-1].split("-")


def hashed_embedding(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts: deterministic, no model."""
    import zlib

    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dimension] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed_udf(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, prefix: str = ""):
    """A text column to array<float>. `load` makes the model once per task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else hashed_embedding
        for texts in batches:
            vectors = model([prefix + (t or "") for t in texts])
            if len(vectors) != len(texts):
                raise ValueError("the model must give one vector for each text")
            yield pd.Series([np.asarray(v, np.float32) for v in vectors])

    return run


def generate_udf(load: Callable[[], Callable[[list[str]], list[str]]] | None = None):
    """A prompt column to struct(text, error); without a model the prompt's last line is echoed."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load() if load else lambda prompts: [(p or "").strip().rsplit("\n", 1)[-1] for p in prompts]
        for prompts in batches:
            try:
                yield pd.DataFrame({"text": model(list(prompts)), "error": None})
            except Exception as e:  # a failed batch is data: step failures are counted, not raised
                yield pd.DataFrame({"text": [None] * len(prompts), "error": str(e)})

    return run


def reader(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[DataFrame], DataFrame]:
    """An `answer` of run_steps from a model that takes a batch of prompts: (prompt, answer, error). A batch that fails is
    asked again prompt by prompt, so that only those that fail by themselves are failures."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                said = model(prompts)
                if len(said) != len(prompts):
                    raise ValueError("the model must give one answer for each prompt")
                return [(x, None) for x in said]
            except Exception as e:  # failures are data: they are counted, not raised
                return [(None, str(e))] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]

        for prompts in batches:
            yield pd.DataFrame(ask(list(prompts)) if len(prompts) else [], columns=["text", "error"])

    def answer(prompts: DataFrame) -> DataFrame:
        return prompts.select("prompt", run("prompt").alias("r")).select("prompt", F.col("r.text").alias("answer"), "r.error")

    return answer


def run_steps(items: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """items (item_id, steps array<string>) -> item_id, step, prompt, answer, unresolved, error, flags of every step.

    Steps run in rounds: all items' k-th steps get the answers before them put in, their different prompts go to
    `answer` as one table (prompt) and come back as (prompt, answer, error), by a model (`reader`) or by joins. Rounds
    are stored, so there are as many as the longest item has steps, whatever the number of items, and each is made once.
    A prompt without a reply has an empty answer. Items with null or no steps have no rows; repeated items run as often."""
    from ..functions.plans import step_flags, substitute

    state = runtime.stored(items.select("item_id", "steps", F.array().cast("array<string>").alias("answers")).where(F.size("steps") > 0), "items")
    done = None
    for k in range(1, (state.agg(F.max(F.size("steps"))).first()[0] or 0) + 1):
        step = F.coalesce(F.get("steps", F.lit(k - 1)), F.lit(""))
        now = state.where(F.size("steps") >= k)
        put, refers = substitute(step, F.col("answers")), F.contains(step, F.lit("#"))  # most texts refer to nothing
        text, open_ = F.when(refers, put["text"]).otherwise(step), F.when(refers, put["unresolved"]).otherwise(F.array().cast("array<int>"))
        now = now.select("item_id", "steps", "answers", text.alias("prompt"), open_.alias("unresolved"))
        said = answer(now.select("prompt").distinct()).select(F.col("prompt").alias("\x00prompt"), F.coalesce("answer", F.lit("")).alias("answer"), "error")
        made = runtime.stored(now.join(said, F.col("prompt") == F.col("\x00prompt"), "left").withColumn("answer", F.coalesce("answer", F.lit(""))).drop("\x00prompt"), f"step-{k}")
        state = made.select("item_id", "steps", F.concat("answers", F.array("answer")).alias("answers"))
        rows = made.select("item_id", F.lit(k).alias("step"), "prompt", "answer", "unresolved", "error")
        done = rows if done is None else done.union(rows)
    if done is None:
        done = state.select("item_id", F.lit(0).alias("step"), F.lit("").alias("prompt"), F.lit("").alias("answer"), F.array().cast("array<int>").alias("unresolved"), F.lit(None).cast("string").alias("error")).limit(0)
    return done.withColumn("flags", step_flags(F.col("answer"), F.col("unresolved"), F.col("error"), F.lit(True)))
