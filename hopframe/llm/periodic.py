"""Periodic runs of words: maximal stretches whose words recur at the distance of a smallest period.

A document is an array of word ids. For every lag q up to n / 2 it is compared with itself shifted by q, and stretches
of equal places that are long enough are runs of period q:

    places i .. j equal at lag q   <=>   words i .. j + q have period q

A stretch whose smallest period is a divisor of q is the very run of that divisor, so of several periods for one
stretch the smallest counts. The comparison is vectorised over all documents of a batch at once; documents lie in order
of length, so that at a lag only those that are long enough are read, with a word that equals nothing between them.
From lag PROBES * 2 on, a stretch of at least q equal places holds PROBES places in a row of any grid of step q //
PROBES, so a lag is compared on that grid first, and in full only where as many neighbouring places of the grid are
equal. That loses nothing, and all lags of a document of n words cost about n log n comparisons instead of n^2 / 2.
Places inside a run that is known already and whose period divides the lag are that same run, and aren't read again.

Documents are scanned where they are read. Those of more than LONG_BYTES are cut by lags: a row for each range of
LAGS lags, dealt over all tasks, whose runs meet again at their document.

Words are compared by their bytes, exactly. Null texts and texts without words have no runs. Repeated rows and clashing
names of other columns don't matter: a row keeps its own columns and is told apart by its place. Ties: runs are ordered by
start, then period. Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LEAST = 12  # words
PROBES = 8
LONG_BYTES = 4 << 20
LAGS = 1 << 18
RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bytes: ids of their words (equal words, equal ids), each word's text, first byte and end."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none.astype(np.int32), none, none, none
    letter = ~common.SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:n]
    last[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    to = np.concatenate(([0], np.cumsum(ends - starts)))
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[letter]))])
    ids = column.dictionary_encode().indices.to_numpy().astype(np.int32)
    return ids, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the stretches of true."""
    change = np.diff(np.concatenate(([False], equal, [False])).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


class _Known:
    """Runs found so far."""

    def __init__(self):
        self.start = self.end = self.period = np.empty(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: int) -> None:
        self.start, self.end = np.concatenate((self.start, start)), np.concatenate((self.end, end))
        self.period = np.concatenate((self.period, np.full(len(start), period, np.int64)))

    def inside(self, first: np.ndarray, last: np.ndarray, lag: int) -> np.ndarray:
        """Whether words first .. last lie in a known run whose period divides the lag. Of runs of such periods those that
        begin before a place are nested or apart but for less than two periods, so the one that ends last decides."""
        some = np.flatnonzero(lag % self.period == 0)
        if len(some) == 0:
            return np.zeros(len(first), bool)
        some = some[np.argsort(self.start[some], kind="stable")]
        furthest = np.maximum.accumulate(self.end[some])
        at = np.searchsorted(self.start[some], first, "right")
        return (at > 0) & (furthest[at - 1] > last)


def _smallest_period(ids: np.ndarray, start: int, end: int, lag: int) -> int:
    """The smallest period of words start .. end - 1, which have period lag and are at least twice as many."""
    period, rest, prime = lag, lag, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        rest //= prime
        if np.array_equal(ids[start : end - period // prime], ids[start + period // prime : end]):
            period //= prime
    return period


def scan(ids: np.ndarray, counts: np.ndarray, low: int = 1, high: int | None = None, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Document, start, length and period of the runs of documents of `counts` words that a lag of low .. high - 1 shows;
    ids has all documents' words one after the other. Ordered by document, start, period."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # one place more for what lies between
    line = np.empty(int(sizes.sum()) + len(sizes), np.int32)
    line[begin + sizes] = -1 - np.arange(len(sizes))  # each equal to nothing
    place = np.ones(len(line), bool)
    place[begin + sizes] = False
    source = np.cumsum(counts) - counts
    line[place] = ids[np.repeat(source[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    out, known = [], _Known()
    most = int(sizes[0]) // 2 if len(sizes) else 0
    for lag in range(low, min(most + 1, high or most + 1)):
        live = int(np.searchsorted(-sizes, -max(least, 2 * lag), "right"))
        if live == 0:
            break
        stop = int(begin[live - 1] + sizes[live - 1]) + 1
        wanted = max(least - lag, lag)
        if lag < 2 * PROBES:
            starts, ends = _stretches(line[: stop - lag] == line[lag:stop])
            some = ends - starts >= wanted
            starts, ends = starts[some], ends[some] + lag
        else:
            step = lag // PROBES
            grid = np.flatnonzero(line[: stop - lag : step] == line[lag:stop:step])
            if len(grid) < PROBES:
                continue
            cuts = np.flatnonzero(np.diff(grid) > 1)
            a, b = grid[np.concatenate(([0], cuts + 1))], grid[np.concatenate((cuts, [len(grid) - 1]))]
            found = []
            a, b = (x[b - a + 1 >= PROBES] * step for x in (a, b))
            fresh = ~known.inside(a, b + lag, lag)
            for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
                left, right = max(0, i - step + 1), min(stop - lag, j + step)
                s, e = _stretches(line[left:right] == line[left + lag : right + lag])
                keep = e - s >= wanted
                found.append((s[keep] + left, e[keep] + left + lag))
            if not found:
                continue
            starts, ends = (np.concatenate(x) for x in zip(*found))
        if len(starts) == 0:
            continue
        periods = np.array([_smallest_period(line, int(s), int(e), lag) for s, e in zip(starts, ends)])
        for period in np.unique(periods):
            known.add(starts[periods == period], ends[periods == period], int(period))
        out.append((starts, ends - starts, periods))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    starts, lengths, periods = (np.concatenate(x).astype(np.int64) for x in zip(*out))
    slot = np.searchsorted(begin, starts, "right") - 1
    document, starts = order[slot], starts - begin[slot]
    keep = np.lexsort((periods, lengths, starts, document))
    document, starts, lengths, periods = document[keep], starts[keep], lengths[keep], periods[keep]
    same = np.zeros(len(keep), bool)  # several lags show one run
    same[1:] = (document[1:] == document[:-1]) & (starts[1:] == starts[:-1]) & (lengths[1:] == lengths[:-1])
    document, starts, lengths, periods = document[~same], starts[~same], lengths[~same], periods[~same]
    again = np.lexsort((periods, starts, document))
    return document[again], starts[again], lengths[again], periods[again]


def _dropped(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def _kept_texts(data, offsets, starts, ends, rows, counts, drop) -> list[bytes]:
    """Each text's words that aren't dropped, joined by one space."""
    s, e, r = starts[~drop], ends[~drop], rows[~drop]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    edge[e] -= 1
    kept = np.cumsum(edge[:-1], dtype=np.int8) > 0
    size = e - s
    to = np.cumsum(size + 1) - size - 1  # a space after each word
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[at] = data[kept]
    whole = out.tobytes()
    own = np.bincount(r, weights=size + 1, minlength=len(counts)).astype(np.int64)
    end = np.cumsum(own)
    return [whole[b - n : b - 1] if n else b"" for b, n in zip(end.tolist(), own.tolist())]


def _answer(table: pa.Table | pa.RecordBatch, text: str, least: int, known=None):
    """Columns n_words, runs, collapsed for a batch of rows. known: the rows' runs, where they have been found before."""
    data, offsets = common.text_buffers(table.column(table.schema.get_field_index(text)))
    ids, rows, starts, ends = words(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
    doc, s, n, p = scan(ids, counts, least=least) if known is None else known
    base = np.cumsum(counts) - counts
    drop = _dropped(len(ids), base[doc] + s, n, p) if len(doc) else np.zeros(len(ids), bool)
    collapsed = _kept_texts(data, offsets, starts, ends, rows, counts, drop)
    lists = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts))))).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(s), pa.array(n), pa.array(p)], ["start", "length", "period"]))
    return [pa.array(counts.astype(np.int64)), runs, pa.array(collapsed, pa.binary())]


def collapse(docs: DataFrame, text: str, *columns: str, least: int = LEAST, long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """The columns, n_words, runs (all of a text, by start, then period) and `collapsed`: the text's words without those
    that a run contains after its first period, joined by one space."""
    spark = docs.sparkSession
    common.make_importable(spark)
    rows = docs.select(*columns, F.col(text).cast("string").alias("\x00text"))
    size = F.coalesce(F.octet_length("\x00text"), F.lit(0))
    schema = docs.select(*columns).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "binary")
    short = rows.where(size <= long_bytes)

    def whole(batches):
        for batch in batches:
            for part in common.slices(batch, "\x00text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_answer(part, "\x00text", least)], names=[*columns, "n_words", "runs", "collapsed"])

    done, long = short.mapInArrow(common.tidy(whole), schema), rows.where(size > long_bytes)
    return done.union(_by_lags(long, schema, columns, least, lags)) if long.limit(1).count() else done


def _by_lags(rows: DataFrame, schema, columns, least: int, lags: int) -> DataFrame:
    """Long documents: a task for each range of lags, then one for each document."""
    spark = rows.sparkSession
    long = common.stage(rows.withColumn("\x00row", F.monotonically_increasing_id()), "long")
    text = "\x00text"
    last = F.expr(f"cast((octet_length(`{text}`) + 1) div 4 div {lags} as int)")  # two bytes a word and two words a lag at least
    ranges = long.select("\x00row", text, F.explode(F.sequence(F.lit(0), last)).alias("range"))

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, body, range_ = (batch.slice(i, 1).column(k) for k in range(3))
                data, offsets = common.text_buffers(body)
                ids, _, _, _ = words(data, offsets)
                at = range_[0].as_py() * lags
                _, s, n, p = scan(ids, np.array([len(ids)]), at + 1, at + lags + 1, least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row[0].as_py())), pa.array(s), pa.array(n), pa.array(p)], names=["\x00row", "start", "length", "period"])

    dealt = ranges.repartition(max(common.scan_partitions(long), spark.sparkContext.defaultParallelism), "\x00row", "range")
    found = dealt.mapInArrow(common.tidy(find), "`\x00row` long, start long, length long, period long")
    each = found.groupBy("\x00row", "start", "length").agg(F.min("period").alias("period"))
    listed = each.groupBy("\x00row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("\x00runs"))
    joined = long.join(listed, "\x00row", "left").select(*columns, "\x00runs", text)

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                runs = one.column(one.num_columns - 2)[0].as_py() or []
                s, p, n = (np.array([r[k] for r in runs], np.int64) for k in ("start", "period", "length"))
                yield pa.RecordBatch.from_arrays([*one.columns[:-2], *_answer(one, text, least, (np.zeros(len(s), np.int64), s, n, p))], names=[*columns, "n_words", "runs", "collapsed"])

    return joined.mapInArrow(common.tidy(finish), schema)


def planted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text; every tenth key's words, numbered from 0, repeat the p from place a on till the end. Rows of other
    keys don't pass through Python here."""
    hashed = docs.select(key, F.col(text).alias("text"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))

    def rows(batches):
        for batch in batches:
            out = []
            for body, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w, g = WORD.findall((body or "").encode()), h // 10
                if w:
                    a = g % len(w)
                    unit = w[a : a + 1 + (len(w) - a) // (3 + g % 8)]
                    w[a:] = (unit * (len(w) // len(unit) + 1))[: len(w) - a]
                    body = b" ".join(w).decode()
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    rest = hashed.where(~chosen).select(key, "text")
    return rest.union(hashed.where(chosen).mapInArrow(common.tidy(rows), rest.schema))


def digests(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns, the number of runs, the longest one (ties: smallest start, then period), and digests of all."""
    longest = F.expr("element_at(array_sort(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p))), 1)")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = rows.select(*columns, F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select(
        *columns, "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("1000 * (-best.l) div best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of each document's words, of which every tenth document has planted ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(collapse(planted(docs, "doc_id", "text"), "text", "doc_id"), "doc_id")
