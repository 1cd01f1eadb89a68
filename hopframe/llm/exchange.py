"""Corpus-wide counts of hashed keys, told to the scan partitions that have the keys, without a row for each key.

A partition sends its distinct keys, sorted, as differences in compressed blobs of BLOB keys, dealt out by key range. Each
range adds up its keys' counts and sends back to a partition only what it can't know by itself: keys that count more
than once, and flagged keys that count at all. A key that isn't sent back counts once, in that partition, or (flagged
keys with a count of 0) never. A range's size follows a partition's, not the corpus's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

BLOB = 1024  # keys in a row
MOST_TASKS = 100_000
BLOBS = "pid int, part int, level int, keys binary, counts binary, flags binary"
REPLIES = "pid int, level int, keys binary, counts binary, tokens long, kinds long, once long, twice long"


def ranges(source: DataFrame) -> int:
    """So many that a range holds half of a scan partition's keys. A partition sends a row to every range, as it would
    send a block to every reducer of a shuffle, so ranges are as large as a task's memory allows."""
    return max(256, 2 * common.scan_partitions(source))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane; the empty high planes compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "lz4", asbytes=True)


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "lz4", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "lz4", asbytes=True)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 4 * n, "lz4", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def sum_keys(keys: list[np.ndarray], values: list[list[np.ndarray]]):
    """Distinct sorted keys, and each list of values summed by key."""
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, [np.bincount(back, weights=np.concatenate(v), minlength=len(k)).astype(np.int64) for v in values], back


def send(pid: int, level: int, keys: np.ndarray, counts: np.ndarray, flags: np.ndarray, parts: int):
    """Batches of BLOBS rows of sorted distinct keys."""
    schema = pa.schema([("pid", pa.int32()), ("part", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("flags", pa.binary())])
    step = np.uint64((1 << 64) // parts + 1)
    part = (keys // step).astype(np.int64)
    cuts = np.unique(np.concatenate((common.run_starts(part), np.arange(0, len(keys), BLOB))))
    for at in range(0, len(cuts), 1000):
        some = cuts[at : at + 1000]
        out = []
        for a, b in zip(some, np.append(cuts[at + 1 : at + 1000], cuts[at + 1000] if at + 1000 < len(cuts) else len(keys))):
            n = int(b - a).to_bytes(4, "little")
            out.append((pid, int(part[a]), level, n + pack_keys(keys[a:b]), pack_counts(counts[a:b]), np.packbits(flags[a:b]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def answers(blobs: DataFrame, parts: int) -> DataFrame:
    """What each scan partition needs to know of its n-grams, and each range's totals (rows with pid -1). `parts` is
    what `ranges` said; half as many tasks deal with them, so that none grows with the input."""

    schema = pa.schema([("pid", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), *((k, pa.int64()) for k in ("tokens", "kinds", "once", "twice"))])

    def work(level, held):
        out: list[tuple] = []
        pids = np.concatenate([np.full(len(x[1]), x[0]) for x in held])
        keys, (total,), back = sum_keys([x[1] for x in held], [[x[2] for x in held]])
        if level == 1:
            out.append((-1, level, None, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
        count = total[back]
        tell = (count > 1) | ((count > 0) & np.concatenate([x[3] for x in held]))
        order = np.lexsort((back[tell], pids[tell]))
        p, k = pids[tell][order], back[tell][order]
        keep = np.ones(len(p), bool)
        keep[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        p, k = p[keep], k[keep]
        cuts = np.unique(np.concatenate((common.run_starts(p), np.arange(0, len(p), BLOB)))) if len(p) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(p))):
            n = int(b - a).to_bytes(4, "little")
            out.append((int(p[a]), level, n + pack_keys(keys[k[a:b]]), pack_counts(np.minimum(total[k[a:b]], 2**32 - 1)), None, None, None, None))
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 1000]), schema.types)], schema=schema)

    def rows(batches):
        now, held = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for pid, part, level, keys, counts, flags in zip(*cols):
                if (part, level) != now:
                    if held:
                        yield from work(now[1], held)
                    now, held = (part, level), []
                n = int.from_bytes(keys[:4], "little")
                held.append((pid, unpack_keys(keys[4:], n), unpack_counts(counts, n), np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)))
        if held:
            yield from work(now[1], held)

    dealt = blobs.repartition(min(parts // 2, MOST_TASKS), "part").sortWithinPartitions("part", "level")
    return common.stage(dealt.mapInArrow(common.tidy(rows), REPLIES), "ngrams")


def load(side: pa.Table | None, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts that a partition was told."""
    k, c = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if side is not None:
        some = side.filter(pc.equal(side["level"], level))
        for keys, counts in zip(some["keys"].to_pylist(), some["counts"].to_pylist()):
            n = int.from_bytes(keys[:4], "little")
            k.append(unpack_keys(keys[4:], n))
            c.append(unpack_counts(counts, n))
    keys, counts = np.concatenate(k), np.concatenate(c)
    order = np.argsort(keys)
    return keys[order], counts[order]
