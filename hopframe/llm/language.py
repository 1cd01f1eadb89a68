"""Language identification of mixed-language text.

Words are runs of letters and their combining marks, lower-cased. A word's script (by its first letter) narrows the languages it may
be in; each of them scores the word by its character n-grams (1 to 5 bytes, and the word as a whole) under
hashed counts learned from labelled text; a Viterbi path with a penalty for each change of language labels
the words. Most texts need no path search: cumulative sums show that no stretch gains enough in another
language to pay for the change.

The model has 2**BITS counters for each language, summed over all training rows, and is broadcast; its size
depends on the number of languages alone. It holds the MOST_LANGUAGES with the most rows; rows in others are not
learned from, and labelled as the nearest of those. Equal shares of two languages: the first by name.

Null text, empty text and text without a letter is `und` with score 0; rows without a language aren't learned
from; without any training row every text is `und`. Repeated rows count as often as they occur; a text of any length
is labelled whole, in one task; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 17
MOST_LANGUAGES = 512
PENALTY = 8.0
FLOOR = -30.0  # of a word in a language that isn't written in its script
SHARE = 0.005  # of a language's letters in a script, for that script to be its own
CACHED_WORDS = 200_000
SCORED = 8_000  # words at a time; each has some fifty n-grams
WORD = re.compile(r"[^\W\d_]+")  # letters, in texts without a character of ODD
ODD = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\U0010ffff]")  # marks, numerals that aren't digits, and all that may be newer than `re`
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

# First code points of script ranges (fixed values of the Unicode standard); letters outside the named ranges are "other".
SCRIPTS = [
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
]
FIRSTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})


def words_of(text: str) -> list[str]:
    """Lower-cased words: a letter and the letters and combining marks after it."""
    text = text.lower()
    return (LETTERS if ODD.search(text) else WORD).findall(text)


def script(word: str) -> int:
    return NAMES.index(SCRIPTS[max(bisect.bisect_right(FIRSTS, ord(word[0])) - 1, 0)][1])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of each word, its bounds included, and of the whole word."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    c = common.prefix_hash(data)
    _, down = common.powers(len(data) + 1)
    own, hashes = [], []
    for n in (1, 2, 3, 4, 5):
        at = np.flatnonzero(left >= n)
        own.append(owner[at])
        hashes.append(common.mix((c[at + n] - c[at]) * down[at] + np.uint64(n)))
    starts = ends - sizes
    own.append(np.arange(len(raw)))
    hashes.append(common.mix((c[ends] - c[starts]) * down[starts] + np.uint64(77)))
    return np.concatenate(own), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        c = counts.astype(np.float64)
        a = 0.5
        total = c.sum(axis=1, keepdims=True) + a * c.shape[1]
        table = np.log((c + a) / total)
        self.table = (table - table.mean(axis=0)).T.astype(np.float32).copy() if len(languages) else np.zeros((1 << BITS, 0), np.float32)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.written = (share >= SHARE).T  # script by language

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language, up to a term that is the same for all languages."""
        own, bucket = features(words)
        bounds = np.argsort(own, kind="stable")
        grams = self.table[bucket[bounds]]
        first = np.searchsorted(own[bounds], np.arange(len(words)))
        out = np.add.reduceat(grams, first, axis=0).astype(np.float64) / 3.0  # n-grams overlap: a third of their sum
        may = self.written[[script(w) for w in words]]
        none = ~may.any(axis=1)
        out[none] = 0.0
        return np.where(may | none[:, None], out, FLOOR)


def path(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best sequence of columns of s: the sum of its scores less a penalty for each change. Ties: the smaller
    column, and no change."""
    n, k = s.shape
    total = s.sum(axis=0)
    best = int(total.argmax())
    constant = np.full(n, best)
    if k == 1 or n == 1:
        return constant
    gain = s - s[:, best : best + 1]
    c = np.vstack((np.zeros(k), np.cumsum(gain, axis=0)))
    most = float((c - np.minimum.accumulate(c, axis=0)).max())  # gain of any stretch in another language
    if most <= penalty / 2:
        return constant
    if most <= penalty:
        # a path with a stretch in the best language changes as often as it leaves it, so it gains nothing; one without
        # gains its first and last stretch less a change at most
        c = np.delete(c, best, axis=1)
        start = np.maximum.accumulate(c.max(axis=1))
        end = (c[-1] - c).max(axis=1)
        if float((start + end).max()) <= penalty:
            return constant
    rows = s.tolist()  # plain numbers: numpy's cost per call is several times that of a few languages' sums
    value, come = rows[0], []
    for row in rows[1:]:
        top = max(value)
        change = top - penalty
        at = value.index(top)
        come.append([j if x >= change else at for j, x in enumerate(value)])
        value = [(x if x >= change else change) + y for x, y in zip(value, row)]
    out = np.empty(n, np.int64)
    last = out[-1] = value.index(max(value))
    for t in range(n - 2, -1, -1):
        last = out[t] = come[t][last]
    return out


def learn(rows: DataFrame) -> Model:
    """A model from all rows (text, lang) with a language; of more than MOST_LANGUAGES, those with the most rows."""
    rows = rows.where("lang is not null and text is not null").select("text", "lang")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r[0] for r in counted)
    rows = rows.where(F.col("lang").isin(languages))
    place = {x: i for i, x in enumerate(languages)}
    size = 1 << BITS

    def count(batches):
        total = np.zeros((len(languages), size), np.int64)
        letters = np.zeros((len(languages), common.SLICE), np.int64)
        seen: dict[int, Counter] = {}

        def flush():
            for k, words in seen.items():
                for at in range(0, len(names := list(words)), SCORED):
                    some = names[at : at + SCORED]
                    times = np.array([words[w] for w in some], np.int64)
                    own, bucket = features(some)
                    total[k] += np.bincount(bucket, weights=times[own], minlength=size).astype(np.int64)
                    kinds = np.array([script(w) for w in some])
                    letters[k] += np.bincount(kinds, weights=times * np.array([len(w) for w in some]), minlength=common.SLICE).astype(np.int64)
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(place[lang], Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > CACHED_WORDS:
                flush()
        flush()
        yield from common.dense_batches(np.concatenate((total.reshape(-1), letters.reshape(-1))))

    if not languages:
        return Model([], np.zeros((0, size), np.int64), np.zeros((0, len(NAMES)), np.int64))
    cut = len(languages) * size
    all_counts = common.sum_dense(rows.mapInArrow(common.tidy(count), common.DENSE), cut + len(languages) * common.SLICE)
    return Model(languages, all_counts[:cut].reshape(-1, size), all_counts[cut:].reshape(-1, common.SLICE)[:, : len(NAMES)])


LABELS = "lang_pred string, score double, spans array<struct<first: int, last: int, lang: string>>"


def label(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns, lang_pred, score (the share of letters in words labelled lang_pred) and spans (first and
    last word, language) of every row of docs."""
    docs = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]

    def rows(batches):
        m = shared.value
        known: dict[str, int] = {}
        table = np.empty((0, len(m.languages)))
        sizes = np.empty(0, np.int64)
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for part in common.slices(batch, "text"):
                words = [words_of(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
                if len(known) > CACHED_WORDS:
                    known, table, sizes = {}, table[:0], sizes[:0]
                new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in known]
                for at in range(0, len(new), SCORED):
                    some = new[at : at + SCORED]
                    known.update(zip(some, range(len(known), len(known) + len(some))))
                    table = np.vstack((table, m.scores(some)))
                    sizes = np.append(sizes, [len(w) for w in some])
                pred, score, spans = [], [], []
                for ws in words:
                    if not ws or not m.languages:
                        pred.append("und")
                        score.append(0.0)
                        spans.append([])
                        continue
                    at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                    labels = path(table[at])
                    cut = common.run_starts(labels)
                    share = np.bincount(labels, weights=sizes[at], minlength=len(m.languages))
                    top = int(share.argmax())
                    pred.append(m.languages[top])
                    score.append(float(share[top] / share.sum()))
                    last = np.append(cut[1:], len(labels)) - 1
                    spans.append([{"first": int(a), "last": int(b), "lang": m.languages[labels[a]]} for a, b in zip(cut, last)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred), pa.array(score, pa.float64()), pa.array(spans, span)], names=[*part.schema.names[:-1], "lang_pred", "score", "spans"])

    return docs.mapInArrow(common.tidy(rows), ", ".join([*names, LABELS]))


def held_out(modulus: int):
    """crc32 of doc_id as text leaves 2 (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == 2


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(4))
    return label(docs, learn(docs.where("not held_out")), "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")
