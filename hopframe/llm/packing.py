"""Best-fit packing of token sequences by exact complements.

Lengths are at most the capacity, so the whole corpus is described by one histogram of at most
`capacity` counts; that table, and the plan made from it, are the only things the driver handles. The
plan says for each length which of its pieces (by rank) go to which sequences, at which offset:

1. from the longest length down, the gap a piece leaves is looked up among the sums of one, two and
   three available lengths; a combination that fills it exactly is used as often as its counts allow;
2. what is left is placed best-fit, longest first: into the smallest gap that holds it.

Null text is an empty document (its end id alone is packed). Repeated rows are packed as often as they
occur. Pieces of equal length are dealt out by scan partition and place. A text of any length is encoded
whole in one task and cut into pieces. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, encoding

PIECES = "pid int, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, local_rank long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenised pieces of at most `capacity` ids. Only longer documents are cut; their first piece takes the
    remainder. local_rank counts a partition's pieces of one length. Stored, so that ranks stay what they are."""

    def cut(batches):
        import zlib

        seen = np.zeros(capacity + 1, np.int64)
        schema = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("local_rank", pa.int64())])
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                ids, bounds = encoding.encode(part.column(2), tokenizer_path, end_id)
                raw, rows = ids.astype("<u4").tobytes(), []
                pid = part.column(0)[0].as_py() >> 33
                for i, doc_id in enumerate(part.column(1).to_pylist()):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    base, to, k = a, a + ((b - a - 1) % capacity + 1), 0
                    while a < b:
                        own = raw[4 * a : 4 * to]
                        rows.append((pid, doc_id, k, a - base, to - a, zlib.crc32(own), own, int(seen[to - a])))
                        seen[to - a] += 1
                        a, to, k = to, to + capacity, k + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    source = common.with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stage(source.mapInArrow(common.tidy(cut), PIECES), "pieces")


class Plan:
    """Patterns of lengths and how often each is used, from counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.runs: list[list] = []  # [lengths, times]
        self._complement()
        self._best_fit()

    def _use(self, lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= n * times
        self.runs.append([list(lengths), times])

    def _pair(self, gap: int, own: np.ndarray) -> tuple[int, int] | None:
        """Two available lengths with this sum, the longest first."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        fits = (own[a] > 0) & (own[gap - a] > 0) & ((a != gap - a) | (own[a] > 1))
        at = np.flatnonzero(fits)
        return (int(a[at[0]]), gap - int(a[at[0]])) if len(at) else None

    def _fill(self, length: int, pair_sums: np.ndarray) -> tuple[int, ...] | None:
        """Lengths that fill exactly what `length` leaves, under the counts. pair_sums may hold sums that are
        used up by now, never lacks one, since counts only fall."""
        gap = self.capacity - length
        if gap == 0:
            return ()
        own = self.left.copy()
        own[length] -= 1
        if own[gap] > 0:
            return (gap,)
        if gap >= 2 and pair_sums[gap]:
            if found := self._pair(gap, own):
                return found
            pair_sums[gap] = bool(self._pair(gap, self.left))
        if gap >= 3:
            a = np.arange(1, gap - 1)
            for x in a[(own[a] > 0) & pair_sums[gap - a]][::-1]:
                own[x] -= 1
                found = self._pair(gap - int(x), own)
                own[x] += 1
                if found:
                    return (int(x), *found)
                if not self._pair(gap - int(x), self.left):
                    pair_sums[gap - x] = False
        return None

    def _complement(self) -> None:
        have = (self.left > 0).astype(np.float64)
        size = 1 << int(2 * self.capacity + 2).bit_length()
        spectrum = np.fft.rfft(have, size)
        pair_sums = np.fft.irfft(spectrum * spectrum, size)[: self.capacity + 1] > 0.5
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                found = self._fill(length, pair_sums)
                if found is None:
                    break
                self._use((length, *found))

    def _best_fit(self) -> None:
        gaps: dict[int, list[int]] = {}  # gap -> open runs
        order: list[int] = []

        def put(gap: int, run: int) -> None:
            if gap:
                if gap not in gaps:
                    gaps[gap] = []
                    bisect.insort(order, gap)
                gaps[gap].append(run)

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                at = bisect.bisect_left(order, length)
                if at == len(order):
                    fit = self.capacity // length  # new sequences, each filled with this length alone
                    full, rest = divmod(n, fit)
                    if full:
                        self.runs.append([[length] * fit, full])
                        put(self.capacity - fit * length, len(self.runs) - 1)
                    if rest:
                        self.runs.append([[length] * rest, 1])
                        put(self.capacity - rest * length, len(self.runs) - 1)
                    n = 0
                    continue
                gap = order[at]
                run = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                lengths, times = self.runs[run]
                used = min(n, times)
                if used < times:
                    self.runs[run][1] = times - used
                    put(gap, run)
                    self.runs.append([[*lengths, length], used])
                    run = len(self.runs) - 1
                else:
                    self.runs[run] = [[*lengths, length], used]
                put(gap - length, run)
                n -= used
            self.left[length] = 0

    def intervals(self) -> dict[str, np.ndarray]:
        """Rows (length, first rank, first sequence, offset), by length and first rank: the pieces of that length
        with ranks from the first on go one each to the sequences from the first on."""
        rank = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for lengths, times in self.runs:
            offset = 0
            for x in lengths:
                rows.append((x, int(rank[x]), sequence, offset))
                rank[x] += times
                offset += x
            sequence += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 4).T
        return {"length": cols[0], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def assign(lengths: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with pid, length and local_rank (from 0, per pid and length).

    Ranks among all pieces of a length are the counts in earlier partitions plus the local rank, so no
    length, however common, meets in one task. The plan has a few rows per length at most and is
    broadcast.
    """
    spark = lengths.sparkSession
    counts = lengths.groupBy("pid", "length").count()
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("pid", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(totals, capacity).intervals())

    def place(batches):
        p = plan.value
        stride = int(p["rank"].max(initial=0)) + 1
        keys = p["length"] * np.int64(stride) + p["rank"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length = t["length"].to_numpy()
            rank = t["local_rank"].to_numpy() + t["earlier"].to_numpy()
            first = np.searchsorted(p["length"], length, "left")
            last = np.searchsorted(p["length"], length, "right") - 1
            at = np.minimum(np.maximum(np.searchsorted(keys, length * np.int64(stride) + np.minimum(rank, stride - 1), "right") - 1, first), last)
            t = t.append_column("sequence_id", pa.array(p["sequence"][at] + rank - p["rank"][at]))
            t = t.append_column("offset", pa.array(p["offset"][at]))
            yield from t.drop_columns(["earlier"]).to_batches()

    joined = lengths.join(before, ["pid", "length"])
    out = [f for f in joined.schema.fields if f.name != "earlier"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    return joined.mapInArrow(common.tidy(place), schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    columns = ["pid", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"] + ["ids"] * with_ids
    return assign(pieces(docs, tokenizer_path, end_id, capacity).select(*columns), capacity).drop("pid", "local_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces as one row per sequence: its ids (binary, little-endian unsigned 32-bit) and documents."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))  # at most `capacity` pieces
    return packed.groupBy("sequence_id").agg(rows.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(p, x -> named_struct('doc_id', x.doc_id, 'piece', x.piece, 'offset', x.offset, 'length', x.length))").alias("documents"),
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of `documents` and its place among sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, encoding.public_path("byte_bpe_50k.json"), 0, 2048, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
