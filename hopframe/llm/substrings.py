"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed when a string of `length` bytes that covers it also starts anywhere else, in the same
document or another; matches never cross documents, and all strings are judged on the input.

The corpus is parsed with rolling-hash triggers. A window of `length` bytes has a trigger of its own, the
least hash of the TRIGGER-byte strings in it; windows in a row with the same trigger form one phrase, with
`length` - 1 bytes of look-ahead, so that phrases overlap and every window lies whole in one phrase. Equal
windows have equal triggers, whatever surrounds them.

1. A phrase whose trigger occurs in no other holds no repeated window, unless the trigger recurs inside; then
   the phrase goes to step 3.
2. The dictionary holds distinct phrases. One that occurs twice is repeated as a whole, window by window.
3. Different phrases of one trigger meet in one task, one occurrence of each. There `repeated_windows`
   parses them again with short phrases, sorts the suffixes of that dictionary and of that parse, and
   combines the two into the order of all suffixes, in which equal windows are neighbours.
4. The phrases of a trigger with more than HOT_BYTES of different phrases are not put in one task: their
   windows are counted by 128-bit hash, with partial counts before the shuffle.

The text is never shuffled: rows are named by scan partition and position, and what is to be removed goes
back to the same partition. Strings are compared by 64-bit hashes (128 in step 4).

Null and empty text has no bytes; texts shorter than `length` keep all; a repeated row is a copy like any
other, so both lose what they share; a text of any length is parsed whole, its repeats of itself included; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRIGGER = 64
HOT_BYTES = 3 << 19
WINDOWS = 1 << 18  # worked on at a time; with what they span, places fit in PLACE_BITS
PLACE_BITS = 21
SHORT_TRIGGER, SHORT_MODULUS = 16, 32  # of the parse inside a task
CHUNK = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, windows: int = WINDOWS):
    """Runs of windows with one trigger: (trigger, phrase hash, row, first byte in the text, windows, and whether
    the trigger's first place in the window changes along the run; only then can windows of a run be equal)."""
    n = len(data) - length + 1
    sizes = np.diff(offsets)
    for p in range(0, max(n, 0), windows):
        q = min(p + windows, n)
        own = data[p : q + length - 1]
        c = common.prefix_hash(own)
        _, down = common.powers(len(own) + 1)
        m = len(own) - TRIGGER + 1
        hashes = common.mix((c[TRIGGER:] - c[:m]) * down[:m])
        place = np.uint64((1 << PLACE_BITS) - 1)
        first_least = sliding_min((hashes & ~place) | np.arange(m, dtype=np.uint64), length - TRIGGER + 1) & place
        trigger = hashes[first_least.astype(np.int64)]
        first, last = np.searchsorted(offsets, p, "right") - 1, np.searchsorted(offsets, q, "left")
        rows = np.arange(first, last)[sizes[first:last] >= length]
        valid = np.zeros(q - p + 1, np.int32)
        a, b = np.clip(offsets[rows] - p, 0, q - p), np.clip(offsets[rows + 1] - length + 1 - p, 0, q - p)
        np.add.at(valid, a, 1)
        np.add.at(valid, b, -1)
        valid = np.cumsum(valid[:-1]) > 0
        same = trigger[1:] == trigger[:-1]
        begin, end = valid.copy(), valid.copy()
        begin[1:] &= ~(valid[:-1] & same)
        end[:-1] &= ~(valid[1:] & same)
        x1, x2 = np.flatnonzero(begin), np.flatnonzero(end) + 1
        to = x2 + length - 1
        phrase = common.mix((c[to] - c[x1]) * down[x1] + (to - x1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row = np.searchsorted(offsets, x1 + p, "right") - 1
        yield trigger[x1], phrase, row, x1 + p - offsets[row], x2 - x1, first_least[x1] != first_least[x2 - 1]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the keys among the distinct ones, from 1, and how many those are."""
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.ones(len(keys), np.int32)
    steps[1:] = ordered[1:] != ordered[:-1]
    del ordered
    np.cumsum(steps, out=steps)
    out = np.empty(len(keys), np.int32)
    out[order] = steps
    return out, int(steps[-1]) if len(steps) else 0


def _ranks(symbols: np.ndarray, group_end: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of all suffixes of sequences laid end to end (group_end: where each place's sequence ends), compared
    over `reach` symbols at least; equal suffixes get equal ranks. Prefix doubling."""
    n = len(symbols)
    rank, kinds = _dense(symbols)
    step = 1
    while step < reach and kinds < n:
        key = rank.astype(np.int64)
        key *= kinds + 1
        if step < n:
            key[: n - step] += np.where(np.arange(step, n, dtype=np.int32) < group_end[: n - step], rank[step:], np.int32(0))
        rank, kinds = _dense(key)
        step *= 2
    return rank


def repeated_windows(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """For each byte of texts laid end to end: whether a window starts there that starts elsewhere too. Places are 32
    bits wide and what is done with is dropped, since several of these lie side by side in an executor."""
    n = len(data)
    out = np.zeros(n, bool)
    c = common.prefix_hash(data)
    _, down = common.powers(n + 1)
    text_end = np.repeat(bounds[1:].astype(np.int32), np.diff(bounds))
    # triggers: text starts, and places whose next SHORT_TRIGGER bytes hash to 0 modulo SHORT_MODULUS
    cut = np.zeros(n, bool)
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    m = n - SHORT_TRIGGER + 1
    if m > 0:
        h = common.mix((c[SHORT_TRIGGER:] - c[:m]) * down[:m])
        cut[:m] |= (h % np.uint64(SHORT_MODULUS) == 0) & (np.arange(SHORT_TRIGGER, n + 1, dtype=np.int32) <= text_end[:m])
        del h
    starts = np.flatnonzero(cut)
    following = np.append(starts[1:], n)
    final = following >= text_end[starts]  # the text's last phrase ends with the text, others with the next trigger
    stops = np.where(final, text_end[starts], following + SHORT_TRIGGER)
    # dictionary: distinct phrases, in any order; parse: their numbers
    key = common.mix((c[stops] - c[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, pick, parse = np.unique(key, return_index=True, return_inverse=True)
    sizes = (stops - starts)[pick]
    d_end = np.cumsum(sizes)
    d_start = d_end - sizes
    total = int(d_end[-1])
    source = np.repeat((starts[pick] - d_start).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)
    symbols = data[source]
    del source
    d_rank = _ranks(symbols, np.repeat(d_end.astype(np.int32), sizes), int(sizes.max()))
    # the parse's suffixes; `length` bytes span at most as many phrases
    number = np.cumsum(cut, dtype=np.int32) - np.int32(1)
    last_of_text = np.searchsorted(starts, text_end[starts], "left")
    p_rank = _ranks(d_rank[d_start[parse]], last_of_text, length)
    # order of all suffixes: by the phrase's rest, then by what follows in the parse
    where = np.flatnonzero(np.arange(length, n + length, dtype=np.int32) <= text_end).astype(np.int32)
    own = number[where]
    del number, text_end
    rest = d_rank[(d_start[parse] - starts).astype(np.int32)[own] + where]
    own += np.int32(1)
    after = np.where(own < last_of_text[own - 1], p_rank[np.minimum(own, len(p_rank) - 1)], np.int32(0))
    del own, d_rank
    order = where[np.lexsort((after, rest))]
    del where, rest, after
    window = c[order + length]
    window -= c[order]
    window *= down[order]
    same = window[1:] == window[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "row_id long, at long, windows long"
SPAN_SCHEMA = pa.schema([("row_id", pa.int64()), ("at", pa.int64()), ("windows", pa.int64())])


def _all_phrases(source: DataFrame, length: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in common.slices(batch, "text"):
                ids = part.column(0).to_numpy()
                for trigger, phrase, row, at, n, inside in phrases(*common.text_buffers(part.column(1)), length):
                    yield pa.RecordBatch.from_pydict({"trigger": common.signed(trigger), "phrase": common.signed(phrase), "row_id": ids[row], "at": at.astype(np.int64), "windows": n.astype(np.int32), "inside": pa.array(inside)})

    return common.stage(source.mapInArrow(common.tidy(rows), "trigger long, phrase long, row_id long, at long, windows int, inside boolean"), "phrases")


def _bytes_of(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted phrases (trigger, row_id, at, windows, known) with their bytes."""
    path = common.side_table(wanted, "wanted", source)

    def rows(batches):
        schema = pa.schema([("trigger", pa.int64()), ("row_id", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("known", pa.bool_()), ("bytes", pa.binary())])
        pid, side = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                side = common.load_side(path, pid)
                side = None if side is None else side.sort_by([("row_id", "ascending")])
                keys = None if side is None else side["row_id"].to_numpy()
            if side is None:
                continue
            ids = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")
            for i in np.flatnonzero(hi > lo):
                data, _ = common.text_buffers(batch.column(1).slice(i, 1))
                mine = side.slice(int(lo[i]), int(hi[i] - lo[i])).select(schema.names[:-1]).combine_chunks()
                raw, at, n = data.tobytes(), mine["at"].to_numpy(), mine["windows"].to_numpy()
                held = pa.array([raw[a : a + k + length - 1] for a, k in zip(at, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(mine[c].combine_chunks().cast(schema.field(c).type) for c in schema.names[:-1]), held], schema=schema)

    out = "trigger long, row_id long, at long, windows int, known boolean, bytes binary"
    return source.mapInArrow(common.tidy(rows), out)


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Windows of different phrases that are equal, found per trigger; rows of a trigger are in one task."""

    def compare(batches):
        held: list[tuple] = []
        size, key = 0, None

        def work():
            data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
            bounds = np.concatenate(([0], np.cumsum([len(x[3]) for x in held])))
            mark = repeated_windows(data, bounds, length)
            found = [], [], []
            for i, (row, at, known, raw) in enumerate(held):
                if not known:
                    for a, b in zip(*_runs(mark[bounds[i] : bounds[i + 1]])):
                        for k, v in zip(found, (row, at + a, b - a)):
                            k.append(int(v))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=SPAN_SCHEMA)

        for batch in batches:
            t, row, at, known, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("trigger", "row_id", "at", "known", "bytes"))
            t, row, at, known = t.to_pylist(), row.to_pylist(), at.to_pylist(), known.to_pylist()
            for i in range(batch.num_rows):
                if t[i] != key and size >= CHUNK:
                    yield work()
                    held, size = [], 0
                key = t[i]
                one = raw[i].as_py()
                held.append((row[i], at[i], known[i], one))
                size += len(one)
        if held:
            yield work()

    dealt = rows.repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(common.tidy(compare), SPANS)


def _count_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for triggers with very many phrases: windows counted by hash, none of them gathered."""

    def hashes(batches):
        for batch in batches:
            row, at, known, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "at", "known", "bytes"))
            data, bounds = common.text_buffers(raw.cast(pa.large_binary()).view(pa.large_string()))
            c = common.prefix_hash(data)
            _, down = common.powers(len(data) + 1)
            n = np.diff(bounds) - length + 1
            own = np.repeat(np.arange(len(n)), n)
            x = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            place = bounds[own] + x
            h = (c[place + length] - c[place]) * down[place]
            half = (c[place + length // 2] - c[place]) * down[place]
            yield pa.RecordBatch.from_pydict({"h1": common.signed(common.mix(h)), "h2": common.signed(common.mix(half ^ np.uint64(0x5BD1E995))), "row_id": row.to_numpy()[own], "at": at.to_numpy()[own] + x, "known": known.to_numpy(zero_copy_only=False)[own]})

    windows = common.stage(rows.mapInArrow(common.tidy(hashes), "h1 long, h2 long, row_id long, at long, known boolean"), "windows")
    often = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return windows.where("not known").join(often, ["h1", "h2"]).select("row_id", "at", F.lit(1).cast("long").alias("windows"))


def repeated_spans(source: DataFrame, length: int, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Runs of repeated windows (row_id, at, windows) of source (row_id, text)."""
    every = _all_phrases(source, length)
    again = every.groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"), F.max("inside").alias("inside"))
    again = again.where((F.col("n") > 1) | F.col("inside")).select("trigger", ((F.col("lo") != F.col("hi")) | (F.col("n") == 1)).alias("mixed"))
    shared = common.stage(every.join(again, "trigger"), "shared")
    mixed = shared.where("mixed")
    distinct = mixed.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "at", "windows")).alias("one"))
    distinct = common.stage(distinct, "dictionary")
    whole = shared.where("not mixed").select("row_id", "at", "windows").union(mixed.join(distinct.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"]).select("row_id", "at", "windows"))
    sizes = distinct.groupBy("trigger").agg(F.sum(F.col("one.windows") + F.lit(length)).alias("size"))
    wanted = distinct.join(sizes.where(F.col("size") > hot_bytes).select("trigger", F.lit(True).alias("hot")), "trigger", "left")
    wanted = common.stage(wanted.select("trigger", "one.*", (F.col("n") > 1).alias("known"), F.coalesce("hot", F.lit(False)).alias("hot")), "wanted")
    spans = _compare(_bytes_of(source, wanted.where("not hot"), length), length)
    hot = wanted.where("hot")
    if hot.limit(1).count():
        spans = spans.union(_count_windows(_bytes_of(source, hot, length), length))
    return common.stage(whole.select("row_id", "at", F.col("windows").cast("long").alias("windows")).union(spans), "spans")


def remove_repeats(docs: DataFrame, length: int = 200, hot_bytes: int = HOT_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (removed runs: first byte and end, in the input), row_id and
    the columns in `keep`.

    The rows are those of docs, in its scan partitions."""
    source = common.with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    kept_columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[3:]]
    path = common.side_table(repeated_spans(source.select("row_id", "text"), length, hot_bytes), "removed", source)

    def rows(batches):
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        pid, side = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                side = common.load_side(path, pid)
                side = None if side is None else side.sort_by([("row_id", "ascending")])
                keys = np.empty(0, np.int64) if side is None else side["row_id"].to_numpy()
                s_at = np.empty(0, np.int64) if side is None else side["at"].to_numpy()
                s_n = np.empty(0, np.int64) if side is None else side["windows"].to_numpy()
            for part in common.slices(batch, "text"):
                data, offsets = common.text_buffers(part.column(2))
                ids = part.column(0).to_numpy()  # ascending
                lo, hi = np.searchsorted(keys, ids[0], "left"), np.searchsorted(keys, ids[-1], "right")
                row = np.searchsorted(ids, keys[lo:hi])
                edge = np.zeros(len(data) + 1, np.int32)
                a = offsets[row] + s_at[lo:hi]
                np.add.at(edge, a, 1)
                np.add.at(edge, a + s_n[lo:hi] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                at_start = np.zeros(len(data) + 1, bool)
                at_start[offsets] = True
                begin = np.flatnonzero(gone & (at_start[:-1] | ~np.concatenate(([False], gone[:-1]))))
                end = np.flatnonzero(gone & (at_start[1:] | ~np.concatenate((gone[1:], [False])))) + 1
                own = np.searchsorted(offsets, begin, "right") - 1
                before = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                kept = data[~gone]
                per_row = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=part.num_rows))))
                spans = pa.StructArray.from_arrays([pa.array(begin - offsets[own]), pa.array(end - offsets[own])], fields=[span.field(0), span.field(1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(before.astype(np.int32)), pa.py_buffer(kept)]), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(before)), pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), spans), *part.columns[3:]],
                    names=["row_id", "doc_id", "kept", "n_bytes", "n_removed", "spans", *part.schema.names[3:]],
                )

    schema = ["row_id long, doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<`from`: long, `to`: long>>", *kept_columns]
    return source.mapInArrow(common.tidy(rows), ", ".join(schema))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document of `documents`, for strings of 200 bytes."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
