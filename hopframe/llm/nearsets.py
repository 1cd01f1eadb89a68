"""Near duplicates among vectors: links of a cosine or more, found by NN-descent over balls.

1. Equal directions are one point with a multiplicity. Points are dealt into blocks by random hyperplanes; in a block,
   points within half of the threshold's angle of a centre go to its ball. Any two members of a ball are linked by the
   triangle inequality, so a dense group, however large, is never compared pair by pair. Centres are dealt anew, by
   other hyperplanes, and balls merge (every member is measured against the new centre, those too far stay) until
   hardly any centre moves.
2. The centres' neighbour lists start from blocks by several tables of hyperplanes and are refined by NN-descent:
   neighbours of neighbours (lists in both directions) meet at the node they share, and what is better than a list's
   last goes into it. A list whose last entry could still be linked is saturated and grows fourfold. A sample of
   centres is held against all centres: while the audited recall is below GOAL, up to MORE rounds with new tables are
   added.
3. Edges that can hold links are measured in doubles. With radii a and b of two balls at an angle w, all members are
   linked if w + a + b is within the threshold's angle, none if w - a - b isn't; in between, members are counted in
   blocks. So what is linked is exact; only which pairs of balls are looked at rests on the search.

Groups without balls, whose members all lie near the threshold's angle from each other, have lists as long as the
group: their links can't be counted but by looking at them.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, aren't
linked; magnitudes don't matter (a vector is scaled by its largest component first). Repeated rows and repeated ids are
rows of their own and linked to their equals. A null id counts as a vector; it is never the smallest. Ties can't
occur: everything is a threshold or a minimum. Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

BLOCK = 512  # points of a block on average; a hot one is split into parts of that size
TABLES = 8
LIST = 10  # a neighbour list's first length
FEW = 3  # candidates for a list from each node where they meet
ROUNDS, MORE = 2, 5
GOAL = 0.995
SAMPLE = 1024  # centres of the audit
LOOSE = 0.003  # error of a cosine of 16-bit floats, and some
TIGHT = 1e-9
GROUP = 96  # members that meet at a node at once
LEFT, RIGHT = 1024, 4096  # members of balls that are counted against each other at once
LEVELS = 8
BITS = 30


def _matrix(column: pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 1), kind)
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)
    at, to = int(offsets[column.offset]), int(offsets[column.offset + len(column)])
    return np.frombuffer(data, np.uint8)[at:to].view(kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * width), pa.py_buffer(raw.tobytes())])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _gather(batches):
    """All batches of a task as one table; None if there is no row."""
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks() if some else None


def _groups(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of rows with equal keys."""
    if len(keys[0]) == 0:
        return []
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cuts = np.append(np.flatnonzero(new), len(new))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (doubles as bytes; null where the vector can't be linked), key (the unit's hash)."""

    def scale(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first, out = np.cumsum(lengths) - lengths, [None] * len(lengths)
            for d in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == d)
                x = flat[first[rows, None] + np.arange(d)]
                most = np.abs(x).max(axis=1)
                sound = np.isfinite(x).all(axis=1) & (most > 0)
                x = x[sound] / most[sound, None]
                x = x / np.sqrt((x**2).sum(axis=1))[:, None] + 0.0
                for row, one in zip(rows[sound].tolist(), x):
                    out[row] = one.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, e -> cast(e as double))").alias("embedding"))
    return cast.mapInArrow(common.tidy(scale), "vec_id long, unit binary").withColumn("key", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))


def _wider(rows: DataFrame, **columns: str) -> T.StructType:
    wider = T.StructType(list(rows.schema.fields))
    for name, kind in columns.items():
        wider.add(name, kind)
    return wider


def _tasks(rows: DataFrame) -> int:
    return max(common.scan_partitions(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _blocks(rows: DataFrame, d: int, n: int, tables: list[int], unit: str = "unit") -> DataFrame:
    """The rows once for each table, dealt into blocks (columns table, code, part) of about BLOCK rows that lie on the same
    sides of the table's hyperplanes; rows of a block are neighbours in a task."""
    bits = min(BITS, max(0, round(math.log2(max(1, n / BLOCK)))))
    planes = {t: np.random.default_rng(1000 + t).standard_normal((d, max(bits, 1))) for t in tables}
    weights = (1 << np.arange(max(bits, 1))) * (bits > 0)
    kind = np.float64 if unit == "unit" else np.float16
    at = rows.columns.index(unit)

    def deal(batches):
        for batch in batches:
            x = _matrix(batch.column(at), kind).astype(np.float64)
            for t, plane in planes.items() if batch.num_rows else ():
                code = ((x @ plane) > 0) @ weights
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64))], names=[*batch.schema.names, "table", "code"])

    dealt = common.stage(rows.mapInArrow(common.tidy(deal), _wider(rows, table="integer", code="long")), "codes", "lz4")
    sizes = dealt.groupBy("table", "code").agg(F.count("*").alias("size"))
    parts = dealt.join(sizes, ["table", "code"]).withColumn("part", F.expr(f"cast(pmod(xxhash64(key, table), cast(ceil(size / {BLOCK * 2}) as long)) as int)"))
    columns = [*rows.columns, "table", "code", "part"]
    return parts.select(*columns).repartition(_tasks(dealt), "table", "code", "part").sortWithinPartitions("table", "code", "part")


def _balls(points: DataFrame, d: int, half: float) -> DataFrame:
    """points (key, unit, n, first) with the centre of their ball and its unit (center, cunit)."""
    near = math.cos(half) + TIGHT

    def lead(batches):
        t = _gather(batches)
        if t is None:
            return
        x, key, mass = _matrix(t["unit"], np.float64), t["key"].to_numpy(), t["mass"].to_numpy()
        old, new = [], []
        for a, b in _groups([t[c].to_numpy() for c in ("table", "code", "part")]):
            close = x[a:b] @ x[a:b].T >= near
            np.fill_diagonal(close, False)
            degree = close.sum(axis=1)
            free = np.ones(b - a, bool)
            for i in np.lexsort((key[a:b], -degree, -mass[a:b]))[: b - a]:
                if not degree[i] or not free[i]:
                    continue
                taken = np.flatnonzero(close[i] & free)
                if len(taken):
                    free[taken] = free[i] = False
                    old.append(taken + a)
                    new.append(np.full(len(taken), i + a))
        if old:
            old, new = np.concatenate(old), np.concatenate(new)
            yield pa.RecordBatch.from_arrays([pa.array(key[old]), pa.array(key[new]), _binary(x[new])], names=["center", "to", "tounit"])

    def move(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            to, tounit = batch.column(6), batch.column(7)
            there = np.asarray(to.is_valid())
            rows = np.flatnonzero(there)
            unit, center, cunit = _matrix(batch.column(1), np.float64), batch.column(4).to_numpy().copy(), _matrix(batch.column(5), np.float64).copy()
            if len(rows):
                target = _matrix(tounit.filter(to.is_valid()), np.float64)
                goes = (unit[rows] * target).sum(axis=1) >= near
                center[rows[goes]] = to.filter(to.is_valid()).to_numpy()[goes]
                cunit[rows[goes]] = target[goes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(center), _binary(cunit)], names=batch.schema.names[:6])

    held = common.stage(points.select("key", "unit", "n", "first", F.col("key").alias("center"), F.col("unit").alias("cunit")), "balls", "lz4")
    for level in range(LEVELS):
        reps = common.stage(held.groupBy(F.col("center").alias("key")).agg(F.first("cunit").alias("unit"), F.sum("n").alias("mass")), "centres", "lz4")
        n = reps.count()
        moved = common.stage(_blocks(reps, d, n, [-1 - level]).mapInArrow(common.tidy(lead), "center long, to long, tounit binary"), "moves", "lz4")
        if moved.count() <= n / 200:
            break
        held = common.stage(held.join(moved, "center", "left").select("key", "unit", "n", "first", "center", "cunit", "to", "tounit").mapInArrow(common.tidy(move), held.schema), "balls", "lz4")
    return held


def _best(edges: DataFrame, wants: DataFrame, tasks: int) -> DataFrame:
    """The best of a node's candidates (a, b, cos), as many as it wants (a, want)."""
    met = edges.repartition(tasks, "a").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return met.withColumn("place", place).join(wants, "a", "left").where(F.col("place") <= F.coalesce("want", F.lit(LIST))).select("a", "b", "cos", "place")


def _lists(table: pa.Table, groups, few: int):
    """Each row's best others of its group, as (a, b, cos): `few`, or as many as it wants where that is more than at first."""
    x, key, want = _matrix(table["half"], np.float16).astype(np.float32), table["key"].to_numpy(), table["want"].to_numpy()
    want = np.where(want > LIST, want, few)
    held = [[], [], []]
    for a, b in groups:
        if b - a < 2:
            continue
        near = x[a:b] @ x[a:b].T
        np.fill_diagonal(near, -2)
        k = min(int(want[a:b].max()), b - a - 1)
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        value = np.take_along_axis(near, best, 1)
        row = np.repeat(np.arange(b - a), k)
        if (want[a:b] < k).any():
            order = np.argsort(-value, axis=1)
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
        some = (np.arange(k) < want[a:b, None]).reshape(-1)
        for part, values in zip(held, (key[a + row], key[a + best].reshape(-1), value.reshape(-1))):
            part.append(values[some])
        if sum(map(len, held[0])) > 1 << 20:
            yield _edges(*held)
            held = [[], [], []]
    if held[0]:
        yield _edges(*held)


def _edges(a, b, c) -> pa.RecordBatch:
    a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(c[keep].astype(np.float32))], names=["a", "b", "cos"])


EDGES = "a long, b long, cos float"


def _from_blocks(reps: DataFrame, d: int, n: int, tables: list[int]) -> DataFrame:
    def rows(batches):
        t = _gather(batches)
        if t is not None:
            yield from _lists(t, _groups([t[c].to_numpy() for c in ("table", "code", "part")]), LIST)

    return _blocks(reps.select("key", "half", "want"), d, n, tables, "half").mapInArrow(common.tidy(rows), EDGES)


def _descend(graph: DataFrame, reps: DataFrame, tasks: int, seed: int) -> DataFrame:
    """Candidates from neighbours of neighbours: the nodes of a node's list, and those whose lists hold it, meet there. The
    many that meet at a hub are dealt into groups, others each round."""
    near = graph.select(F.col("a").alias("at"), F.col("b").alias("key")).union(graph.select("b", "a"))
    near = near.union(reps.select("key", "key")).distinct()
    sizes = near.groupBy("at").agg(F.count("*").alias("size"))
    there = near.join(sizes, "at").withColumn("part", F.expr(f"cast(pmod(xxhash64(key, {seed}), cast(ceil(size / {GROUP}) as long)) as int)")).select("at", "part", "key")
    with_vectors = there.join(reps.select("key", "half", "want"), "key").select("at", "part", "key", "half", "want")

    def rows(batches):
        t = _gather(batches)
        if t is not None:
            yield from _lists(t, _groups([t[c].to_numpy() for c in ("at", "part")]), FEW)

    return with_vectors.repartition(tasks, "at", "part").sortWithinPartitions("at", "part").mapInArrow(common.tidy(rows), EDGES)


def _audit(graph: DataFrame, reps: DataFrame, angle: float) -> float:
    """Of what SAMPLE centres should have in their own or others' lists, how much is there: 1 if there is nothing."""
    some = reps.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(SAMPLE).select("key", "half", "radius")
    asked = some.toArrow().combine_chunks()
    x, radius, keys = _matrix(asked["half"], np.float16).astype(np.float32), asked["radius"].to_numpy(), asked["key"].to_numpy()
    told = common.tell(reps.sparkSession, (x, radius, keys), "audit")

    def count(batches):
        vectors, radii, names = common.told(told)
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            if batch.num_rows:
                y, own = _matrix(batch.column(1), np.float16).astype(np.float32), batch.column(2).to_numpy()
                wide = np.minimum(angle + radii[:, None] + own[None, :], math.pi)
                total += ((vectors @ y.T >= np.cos(wide)) & (names[:, None] != batch.column(0).to_numpy()[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["key", "number"])

    whole = reps.select("key", "half", "radius").mapInArrow(common.tidy(count), "key long, number long").groupBy("key").agg(F.sum("number").alias("number"))
    both = graph.select("a", "b", "cos").union(graph.select("b", "a", "cos")).join(some.select(F.col("key").alias("a"), F.col("radius").alias("ra")), "a")
    seen = both.join(reps.select(F.col("key").alias("b"), F.col("radius").alias("rb")), "b").where(F.col("cos") >= F.cos(F.least(F.lit(angle) + F.col("ra") + F.col("rb"), F.lit(math.pi))))
    found = seen.select("a", "b").distinct().groupBy(F.col("a").alias("key")).agg(F.count("*").alias("found"))
    number, got = whole.join(found, "key", "left").agg(F.sum("number"), F.sum(F.least(F.col("number"), F.coalesce("found", F.lit(0))))).first()
    common.remove(reps.sparkSession, told)
    return (got or 0) / number if number else 1.0


def search(reps: DataFrame, d: int, angle: float) -> DataFrame:
    """Neighbour lists (a, b, cos, place) of the centres (key, half, radius) that hold what lies within angle + radii."""
    n, tasks = reps.count(), _tasks(reps)
    widest = reps.agg(F.max("radius")).first()[0] or 0.0
    wants = reps.select(F.col("key").alias("a"), F.lit(LIST).cast("long").alias("want"))
    table, graph = 0, None
    step = 0
    while True:
        asked = reps.join(wants.withColumnRenamed("a", "key"), "key")
        fresh = []
        if step == 0 or step >= ROUNDS:
            fresh = [_from_blocks(asked, d, n, list(range(table, table + TABLES)))]
            table += TABLES
        if graph is not None:
            fresh += [_descend(graph, asked, tasks, step), graph.select("a", "b", "cos")]
        edges = fresh[0]
        for more in fresh[1:]:
            edges = edges.union(more)
        graph = common.stage(_best(edges, wants, tasks), "lists", "lz4")
        ends = graph.groupBy("a").agg(F.max("place").alias("length"), F.min("cos").alias("last")).join(reps.select(F.col("key").alias("a"), "radius"), "a")
        full = (F.col("length") >= F.col("want")) & (F.col("last") >= F.cos(F.least(F.col("radius") + F.lit(angle + widest), F.lit(math.pi))) - LOOSE)
        grown = wants.join(ends, "a", "left").select("a", F.when(full, F.col("want") * 4).otherwise(F.col("want")).alias("want"), F.coalesce(full, F.lit(False)).alias("full"))
        grown = common.stage(grown, "wants", "lz4")
        saturated, wants = grown.where("full").count(), grown.drop("full")
        step += 1
        if step >= ROUNDS and not saturated and (step >= ROUNDS + MORE or _audit(graph, reps, angle) >= GOAL):
            break
    return graph


def _measure(edges: DataFrame, reps: DataFrame, angle: float) -> DataFrame:
    """Edges (a, b; a has more members) of centres with `state`: 2 all members linked, 1 some may be. Others go."""
    side = lambda s: reps.select(F.col("key").alias(s), F.col("unit").alias(f"u{s}"), F.col("radius").alias(f"r{s}"), F.col("size").alias(f"s{s}"), F.col("mass").alias(f"m{s}"))
    joined = edges.join(side("a"), "a").join(side("b"), "b").select("a", "ua", "ra", "sa", "ma", "b", "ub", "rb", "sb", "mb")
    least = math.cos(angle)

    def rows(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cosine = (_matrix(batch.column(1), np.float64) * _matrix(batch.column(6), np.float64)).sum(axis=1)
            apart, radii = _angle(cosine), batch.column(2).to_numpy() + batch.column(7).to_numpy()
            single = (batch.column(3).to_numpy() == 1) & (batch.column(8).to_numpy() == 1)
            state = np.where(apart + radii <= angle - 1e-7, 2, np.where(apart - radii <= angle + 1e-7, 1, 0))
            state = np.where(single, np.where(cosine >= least, 2, 0), state)
            some = pa.array(state > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(some) for i in (0, 3, 4, 5, 8, 9)), pa.array(state[state > 0].astype(np.int32))], names=["a", "sa", "ma", "b", "sb", "mb", "state"])

    return common.stage(joined.mapInArrow(common.tidy(rows), "a long, sa long, ma long, b long, sb long, mb long, state int"), "measured", "lz4")


def _count(some: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Links of members of balls some of which are linked: (key, center, other, links) of members that have any."""
    swap = F.col("sa") < F.col("sb")
    pairs = some.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("sa", "sb").alias("sa"), F.least("sa", "sb").alias("sb"))
    whole = pairs.groupBy("a").agg(F.max("sa").alias("sa"), F.sum("sb").alias("sb"))
    parts = whole.select("a", F.expr(f"cast(ceil(sa / {LEFT}) as int)").alias("lefts"), F.expr(f"cast(ceil(sb / {RIGHT}) as int)").alias("rights"))
    members = held.select("key", "unit", "n", "center")
    deal = lambda of, salt: F.expr(f"cast(pmod(xxhash64(key, {salt}), {of}) as int)")
    each = lambda of: F.explode(F.expr(f"sequence(0, {of} - 1)"))
    left = members.join(parts.withColumnRenamed("a", "center"), "center").select(F.col("center").alias("a"), F.col("center").alias("own"), "key", "unit", "n", deal("lefts", 1).alias("i"), each("rights").alias("j"))
    right = pairs.select("a", F.col("b").alias("center")).join(parts, "a").join(members, "center").select("a", F.col("center").alias("own"), *(F.col(c).alias(c) for c in ("key", "unit", "n")), deal("rights", 2).alias("j"), each("lefts").alias("i"))

    def links(one: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and other.num_rows:
            close = _matrix(one["unit"], np.float64) @ _matrix(other["unit"], np.float64).T >= least
            balls, of = np.unique(other["own"].to_numpy(), return_inverse=True)
            to, own = one["own"].to_numpy(), np.empty(len(of), np.int64)
            own[:] = to[0]
            back = close.T @ one["n"].to_numpy()
            out.append((other["key"].to_numpy(), other["own"].to_numpy(), own, back))
            order = np.argsort(of, kind="stable")
            weighted = close[:, order] * other["n"].to_numpy()[order]
            per = np.add.reduceat(weighted, np.searchsorted(of[order], np.arange(len(balls))), axis=1)
            row, ball = np.nonzero(per)
            out.append((one["key"].to_numpy()[row], to[row], balls[ball], per[row, ball]))
        whole = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((),) * 4)]
        keep = whole[3] > 0
        return pa.table({k: pa.array(v[keep].astype(np.int64)) for k, v in zip(("key", "center", "other", "links"), whole)})

    done = left.groupBy("a", "i", "j").cogroup(right.groupBy("a", "i", "j")).applyInArrow(links, "key long, center long, other long, links long")
    return common.stage(done, "links", "lz4")


def near_sets(vectors: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    rows = common.stage(units(vectors), "units", "lz4")
    angle = math.acos(cosine)
    points = rows.where("key is not null").groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    points = common.stage(points.withColumn("d", F.expr("length(unit) div 8")), "points", "lz4")
    lengths = [r[0] for r in points.groupBy("d").count().where("count > 1").orderBy("d").collect()]
    same = points.where(~F.col("d").isin(lengths) if lengths else F.lit(True)).select("key", (F.col("n") - 1).alias("links"), F.col("first").alias("component_id"))
    for d in lengths:
        same = same.union(_of_length(points.where(F.col("d") == d).drop("d"), d, angle, cosine))
    out = rows.select("vec_id", "key").join(same, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _of_length(points: DataFrame, d: int, angle: float, cosine: float) -> DataFrame:
    """(key, links, component_id) of points (key, unit, n, first) of d components."""
    held = _balls(points, d, angle / 2)

    def radius(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.float64)
                far = _angle((x * _matrix(batch.column(3), np.float64)).sum(axis=1))
                far[batch.column(4).to_numpy() == batch.column(5).to_numpy()] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(3), batch.column(1), batch.column(2), pa.array(far)], names=["key", "unit", "n", "first", "far"])

    measured = held.select("unit", "n", "first", "cunit", "center", "key").mapInArrow(common.tidy(radius), "key long, unit binary, n long, first long, far double")
    reps = measured.groupBy("key").agg(F.first("unit").alias("unit"), F.max("far").alias("radius"), F.count("*").alias("size"), F.sum("n").alias("mass"), F.min("first").alias("first"))

    def halves(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _binary(_matrix(batch.column(1), np.float64).astype(np.float16))], names=[*batch.schema.names, "half"])

    reps = common.stage(reps.mapInArrow(common.tidy(halves), _wider(reps, half="binary")), "centres", "lz4")
    graph = search(reps.select("key", "half", "radius"), d, angle)
    side = lambda s: reps.select(F.col("key").alias(s), F.col("radius").alias(f"r{s}"))
    wide = graph.join(side("a"), "a").join(side("b"), "b").where(F.col("cos") >= F.cos(F.least(F.lit(angle) + F.col("ra") + F.col("rb"), F.lit(math.pi))) - LOOSE)
    edges = _measure(wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, angle)
    whole, some = edges.where("state = 2"), edges.where("state = 1")
    counted = _count(some, held, cosine)
    linked = whole.select("a", "b").union(counted.select(F.least("center", "other").alias("a"), F.greatest("center", "other").alias("b")).distinct())
    labels = components(linked)
    added = whole.select(F.col("a").alias("center"), F.col("mb").alias("more")).union(whole.select("b", "ma")).groupBy("center").agg(F.sum("more").alias("more"))
    of = reps.select(F.col("key").alias("center"), "mass", "first").join(labels.withColumnRenamed("node", "center"), "center", "left").withColumn("component", F.coalesce("component", "center"))
    smallest = of.groupBy("component").agg(F.min("first").alias("component_id"))
    balls = of.join(smallest, "component").join(added, "center", "left").select("center", "component_id", (F.col("mass") - 1 + F.coalesce("more", F.lit(0))).alias("base"))
    own = counted.groupBy("key").agg(F.sum("links").alias("own"))
    return held.select("key", "center").join(balls, "center").join(own, "key", "left").select("key", (F.col("base") + F.coalesce("own", F.lit(0))).alias("links"), "component_id")


def op12_near_sets(spark, sf_dir: str) -> DataFrame:
    """All vectors that are linked by a cosine of 0.95 or more."""
    return near_sets(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.95)
