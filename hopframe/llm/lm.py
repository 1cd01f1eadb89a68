"""Language-model scores from a weighted backoff automaton over word n-grams.

Tokens are lower-cased words and one end per text; words that training never saw are one class, so the events
are the V training tokens and "unknown". States are the root and one per training word. Counts c come from all
training texts, without a cutoff:

    root      arc w:  (c(w) - D) / N           unknown: D * V / N       (absolute discounting, D = n1 / (n1 + 2 n2))
    state h   arc w:  (c(h w) + M * root(w)) / (c(h) + M)               where h w was seen in training
              failure arc to the root, weight M / (c(h) + M)

M is the weight of the root in tokens (Dirichlet smoothing, WEIGHT). Every state's probabilities sum to one. One
left-to-right pass over a text carries the state (the root at its start and after an unknown word), takes the
arc or the failure arc and then the root's, and adds up log10 weights. The pass is done for all texts of a batch
at once, since the state after a token depends on that token alone.

The automaton grows with the corpus (every distinct bigram is an arc) and is never gathered in one place. Each
scan partition sends its n-grams, as sorted 64-bit hashes dealt out by hash range; each range adds up counts and
sends back to a partition what it can't know by itself: n-grams of training texts that occur more than once, and
those of held-out texts that occur in training. What isn't sent back occurs once (in the text at hand) or never.

Null text is empty (the end alone); repeated rows count and are scored as often as they occur; an empty table
gives no rows; without training text every word is unknown with probability one. A text of any length is scored
whole, in one task. There are no ties to break. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange
from .language import held_out

WEIGHT = 20.0
FLUSH = 2 << 20  # tokens
END = np.uint64(0xE5D0F7E87D3B4A11)
ONE, TWO = np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1B54A32D192ED03)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, text, whether it is a text's first token) with an end after each text's words."""
    h, rows, _, _ = common.word_hashes(data, offsets)
    n = len(offsets) - 1
    ends = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    out = np.empty(len(h) + n, np.uint64)
    owner = np.empty(len(out), np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, h
    owner[is_end], owner[~is_end] = np.arange(n), rows
    first = np.ones(len(out), bool)
    first[1:] = is_end[:-1]
    return out, owner, first


def grams(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token, and of each token with the one before it (0 for a first token)."""
    one = common.mix(token * ONE)
    two = np.zeros(len(token), np.uint64)
    two[1:] = common.mix(token[:-1] * TWO + token[1:] * ONE)
    two[first] = 0
    return one, two


def _counts(source: DataFrame, parts: int) -> DataFrame:
    """Each scan partition's n-grams by hash range: training counts, and whether held-out texts have them."""
    def rows(batches):
        held: dict[int, list] = {1: [], 2: []}
        size, pid = 0, None

        def flush():
            for level, some in held.items():
                if some:
                    keys, (train, test), _ = exchange.sum_keys([x[0] for x in some], [[x[1] for x in some], [x[2] for x in some]])
                    yield from exchange.send(pid, level, keys, train, test > 0, parts)
                    some.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = batch.column(0)[0].as_py() >> 33
            if pid is not None and pid != now:
                yield from flush()
                size = 0
            pid = now
            for piece in common.slices(batch, "text"):
                token, owner, first = tokens(*common.text_buffers(piece.column(2)))
                train = piece.column(3).to_numpy(zero_copy_only=False)[owner].astype(np.int64)
                one, two = grams(token, first)
                held[1].append((one, train, 1 - train))
                held[2].append((two[~first], train[~first], 1 - train[~first]))
                size += len(token)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return source.mapInArrow(common.tidy(rows), exchange.BLOBS)


class Automaton:
    """Arcs among the n-grams of one scan partition; root constants of the whole corpus."""

    def __init__(self, n: int, kinds: int, once: int, twice: int, weight: float):
        self.n, self.kinds, self.weight = n, kinds, weight
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.unknown = self.discount * kinds / n if n else 1.0

    def load(self, side: pa.Table | None) -> None:
        self.keys, self.counts = {}, {}
        for level in (1, 2):
            self.keys[level], self.counts[level] = exchange.load(side, level)

    def count(self, level: int, key: np.ndarray, train: np.ndarray) -> np.ndarray:
        keys = self.keys[level]
        out = train.astype(np.int64)  # a training text's own n-gram that nobody else has
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[hit] = self.counts[level][at[hit]]
        return out

    def traverse(self, token: np.ndarray, first: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each token, and its log10 weight on the way through the texts."""
        one, two = grams(token, first)
        c = self.count(1, one, train)
        root = np.where(c > 0, (c - self.discount) / max(self.n, 1), self.unknown)
        state = np.zeros(len(c), np.int64)  # c(h) of the state before each token; 0 at the root
        state[1:] = c[:-1]
        state[first] = 0
        arc = self.count(2, two, train)
        arc[first | (state == 0) | (c == 0)] = 0
        seen = arc > 0
        failure = self.weight / (state + self.weight)
        weight = np.where(seen, (arc + self.weight * root) / (state + self.weight), failure * root)
        return c, np.log10(weight)


def score(docs: DataFrame, train, weight: float = WEIGHT) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text); `train`
    is the condition of the rows that the model learns from. base_score is that of add-one unigrams."""
    source = common.with_row_id(docs.withColumn("train", train), F.col("doc_id").cast("long").alias("doc_id"), "text", "train")
    parts = exchange.ranges(source)
    replies = exchange.answers(_counts(source, parts), parts)
    totals = replies.where("pid = -1").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tokens", "kinds", "once", "twice"))).first()
    path = common.side_table(replies.where("pid >= 0").select("pid", "level", "keys", "counts"), "arcs", source)
    model = Automaton(*totals, weight)

    def rows(batches):
        pid = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                model.load(common.load_side(path, pid))
            for part in common.slices(batch, "text"):
                token, owner, first = tokens(*common.text_buffers(part.column(2)))
                c, w = model.traverse(token, first, part.column(3).to_numpy(zero_copy_only=False)[owner])
                at = np.flatnonzero(first)
                base = np.log10((c + 1.0) / (model.n + model.kinds + 1.0))
                size = np.diff(np.append(at, len(token)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(3), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(at), model.n, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(w, at))],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return source.mapInArrow(common.tidy(rows), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every document of `documents`, learned from those that aren't held out."""
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out(7))
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
