"""Graph edit distance between decompositions, for pandas UDFs. Deterministic: bounded by node count, never by time.

The least cost is found best-first over assignments of the smaller graph's nodes. A partial assignment is bounded by a
linear assignment of the nodes that are left, whose entries hold what a pair costs for certain: its labels, its edges to
nodes that are assigned already, and half of what its other edges differ by (the other half stands at their other
ends). The assignment that attains a bound is itself tried, so a search usually ends at its root. Nodes that can be
exchanged without changing a graph are tried once.
"""

from __future__ import annotations

import functools
import heapq
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T  # types, not strings: workers import this module without a session

MAX_NODES = 16
SEARCH_LIMIT = 20_000  # partial assignments looked at before the best one so far is returned


def alignment_matches(a: list[str], b: list[str]) -> int:
    """Equal pairs on a least-cost alignment; of equal costs a pair is taken before an insertion, that before a deletion."""
    if a == b:
        return len(b)
    if not a or not b:
        return 0
    cost = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, 0)]
        for j, y in enumerate(b, 1):
            pair = (cost[j - 1][0] + (x != y), cost[j - 1][1] + (x == y))
            insert, delete = (row[-1][0] + 1, row[-1][1]), (cost[j][0] + 1, cost[j][1])
            row.append(min((pair, insert, delete), key=lambda c: c[0]))
        cost = row
    return cost[-1][1]


def label_distance(a: str, b: str) -> float:
    x, y = a.lower().split(), b.lower().split()
    if not x and not y:
        return 0.0
    return 1.0 - 2.0 * alignment_matches(x, y) / (len(x) + len(y))


CELLS = 1 << 18  # of all tables of alignments that are filled at a time
COST, WORSE = 1 << 22, 1 << 20  # an alignment as one number: its cost, then what is preferred among equal costs, then matches


def _alignments(pairs: list[tuple[list[int], list[int]]]) -> np.ndarray:
    """alignment_matches of pairs of token numbers that aren't empty, all tables at once, diagonal by diagonal."""
    rows, columns = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    x, y = np.full((rows, len(pairs)), -1, np.int64), np.full((columns, len(pairs)), -2, np.int64)
    for k, (a, b) in enumerate(pairs):
        x[: len(a), k], y[: len(b), k] = a, b
    back = y[::-1]
    sizes = np.array([len(a) for a, _ in pairs])
    last = sizes + np.array([len(b) for _, b in pairs])
    older, old = np.zeros((rows + 1, len(pairs)), np.int64), np.full((rows + 1, len(pairs)), COST, np.int64)
    out = np.zeros(len(pairs), np.int64)
    for d in range(2, rows + columns + 1):
        now = np.full((rows + 1, len(pairs)), d * COST, np.int64)  # where one side is empty
        lo, hi = max(1, d - columns), min(rows, d - 1)
        pair = older[lo - 1 : hi] + np.where(x[lo - 1 : hi] == back[columns - d + lo : columns - d + hi + 1], 1, COST)
        best = np.minimum(pair, old[lo : hi + 1] + (COST + WORSE))
        now[lo : hi + 1] = np.minimum(best, old[lo - 1 : hi] + (COST + 2 * WORSE)) & ~np.int64(3 * WORSE)
        ends = np.flatnonzero(last == d)
        out[ends] = now[sizes[ends], ends] & (WORSE - 1)
        older, old = old, now
    return out


def label_distances(pairs) -> dict[tuple[str, str], float]:
    """label_distance of each different pair of labels."""
    out: dict[tuple[str, str], float] = {}
    words: dict[str, list[int]] = {}
    numbers: dict[str, int] = {}
    sets: dict[str, frozenset] = {}
    left = []
    for pair in set(pairs):
        for label in pair:
            if label not in words:
                words[label] = [numbers.setdefault(w, len(numbers)) for w in label.lower().split()]
                sets[label] = frozenset(words[label])
        x, y = (words[label] for label in pair)
        if x == y:
            out[pair] = 0.0
        elif sets[pair[0]].isdisjoint(sets[pair[1]]):
            out[pair] = 1.0
        else:
            left.append(pair)
    left.sort(key=lambda p: (len(words[p[0]]), len(words[p[1]])))
    at = 0
    while at < len(left):
        to, wide = at, 0
        while to < len(left) and (to == at or (to - at + 1) * max(wide, len(words[left[to][1]])) * len(words[left[to][0]]) <= CELLS):
            wide, to = max(wide, len(words[left[to][1]])), to + 1
        some = left[at:to]
        for p, n in zip(some, _alignments([(words[a], words[b]) for a, b in some]).tolist()):
            out[p] = 1.0 - 2.0 * n / (len(words[p[0]]) + len(words[p[1]]))
        at = to
    return out


def graph(steps: list[str]) -> tuple[list[str], set[tuple[int, int]]]:
    """Labels in order of node number, and edges by place. A reference to a step that isn't there makes an unlabelled
    node; a step may refer to itself."""
    refs = [(i, int(k)) for i, s in enumerate(steps, 1) for k in re.findall(r"@@(\d+)@@", s)]
    nodes = sorted({*range(1, len(steps) + 1), *(k for _, k in refs)})
    place = {n: i for i, n in enumerate(nodes)}
    return [steps[n - 1] if 1 <= n <= len(steps) else "" for n in nodes], {(place[i], place[k]) for i, k in refs}


def absorbed(loops: list[int], edges: list[tuple[int, int]]) -> int:
    """The most edges that can each be paired with a loop at one of their ends, a loop with one edge at most."""
    taken: dict[int, int] = {}

    def place(e: int, seen: set[int]) -> bool:
        for node in edges[e]:
            if node in loops and node not in seen:
                seen.add(node)
                if node not in taken or place(taken[node], seen):
                    taken[node] = e
                    return True
        return False

    return sum(place(e, set()) for e in range(len(edges))) if loops else 0


def mapping_cost(a, b, to: list[int | None], loose: bool = False, cost: list[list[float]] | None = None) -> float:
    """What it costs to turn graph a into b where a's node i becomes b's node to[i] (None: it goes). loose: a loop at a
    node may become any edge at that node's counterpart, or the other way round, at no cost."""
    (la, ea), (lb, eb) = a, b
    labels = sum(cost[i][j] if cost is not None else label_distance(la[i], lb[j]) for i, j in enumerate(to) if j is not None)
    pairs = sum(j is not None for j in to)
    moved = {(to[u], to[v]): (u, v) for u, v in ea if to[u] is not None and to[v] is not None}
    kept = moved.keys() & eb
    total = labels + len(la) - pairs + len(lb) - pairs + len(ea) + len(eb) - 2 * len(kept)
    if loose:
        gone, come = [e for e in moved if e not in kept], [e for e in eb if e not in kept and e[0] in to and e[1] in to]
        loops = lambda es: [u for u, v in es if u == v]
        plain = lambda es: [e for e in es if e[0] != e[1]]
        total -= 2 * (absorbed(loops(gone), plain(come)) + absorbed(loops(come), plain(gone)))
    return float(total)


def positional_cost(a, b, known: dict | None = None) -> float:
    """Nodes paired in order: a bound from above. known: distances of labels."""
    n, cost = len(b[0]), None
    if known is not None:
        cost = [[known[x, y] if j == i else 0.0 for j, y in enumerate(b[0][: i + 1])] for i, x in enumerate(a[0])]
    return mapping_cost(a, b, [i if i < n else None for i in range(len(a[0]))], cost=cost)


def _small_assignment(cost: list[list[float]]) -> list[int]:
    """Each row's column in an assignment of least cost, as least_assignment's, for a few rows without arrays."""
    columns = [min(range(len(row)), key=row.__getitem__) for row in cost]
    if len(set(columns)) == len(columns):
        return columns
    n, m = len(cost), len(cost[0])
    up, down, owner, come = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        short, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            at, least, j1 = owner[j0], float("inf"), 0
            row, u = cost[at - 1], up[at]
            for j in range(1, m + 1):
                if not done[j]:
                    reach = row[j - 1] - u - down[j]
                    if reach < short[j]:
                        short[j], come[j] = reach, j0
                    if short[j] < least:
                        least, j1 = short[j], j
            for j in range(m + 1):
                if done[j]:
                    up[owner[j]] += least
                    down[j] -= least
                else:
                    short[j] -= least
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[come[j0]], come[j0]
    for j in range(1, m + 1):
        if owner[j]:
            columns[owner[j] - 1] = j - 1
    return columns


def least_assignment(cost: np.ndarray) -> tuple[float, list[int]]:
    """Least sum of one entry for each row, no column twice (at least as many columns as rows), by shortest augmenting
    paths; and each row's column."""
    n, m = cost.shape
    up, down = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        short, come, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, last, far = row, -1, 0.0
        while True:
            reach = far + cost[i] - up[i] - down
            better = ~done & (reach < short - 1e-15)
            short[better], come[better] = reach[better], i
            last = int(np.where(done, np.inf, short).argmin())
            far = short[last]
            done[last] = True
            if owner[last] < 0:
                break
            i = int(owner[last])
        seen = np.flatnonzero(done)
        up[row] += far
        for j in seen:
            if owner[j] >= 0:
                up[owner[j]] += far - short[j]
            down[j] += short[j] - far
        j = last
        while True:
            i = int(come[j])
            back = np.flatnonzero(owner == i)
            owner[j] = i
            if i == row:
                break
            j = int(back[0])
    to = [-1] * n
    for j in np.flatnonzero(owner >= 0):
        to[owner[j]] = int(j)
    return float(cost[np.arange(n), to].sum()), to


class _Pair:
    """Two graphs, the one with fewer nodes as rows: matrices of a few rows, as lists."""

    def __init__(self, a, b, loose: bool, known: dict | None = None):
        self.flip = len(a[0]) > len(b[0])
        self.a, self.b = (b, a) if self.flip else (a, b)
        self.loose = loose
        (la, ea), (lb, eb) = self.a, self.b
        pairs = [[(y, x) if self.flip else (x, y) for y in lb] for x in la]
        known = known if known is not None else label_distances(p for row in pairs for p in row)
        self.labels = [[known[p] for p in row] for row in pairs]

    @functools.cached_property
    def edges(self) -> list[list[list[int]]]:
        out = []
        for names, es in (self.a, self.b):
            m = [[0] * len(names) for _ in names]
            for u, v in es:
                m[u][v] = 1
            out.append(m)
        return out

    @functools.cached_property
    def twins(self) -> list[list[int]]:
        """For each column node the earlier ones that it can be exchanged with."""
        e, costs = self.edges[1], list(zip(*self.labels))

        def alike(i: int, j: int) -> bool:
            if costs[i] != costs[j] or e[i][j] != e[j][i] or e[i][i] != e[j][j]:
                return False
            return all(e[i][k] == e[j][k] and e[k][i] == e[k][j] for k in range(len(e)) if k not in (i, j))

        return [[i for i in range(j) if alike(i, j)] for j in range(len(e))]

    def bound(self, to: list[int | None]) -> tuple[float, list[int | None]]:
        """A bound from below on all assignments that begin with `to`, and one of them."""
        x, y = self.edges
        n, m, k = len(x), len(y), len(to)
        taken = set(to)
        rows, free = range(k, n), [j for j in range(m) if j not in taken]
        fixed = [(i, j) for i, j in enumerate(to) if j is not None]
        gone = [i for i, j in enumerate(to) if j is None]
        total = sum(self.labels[i][j] for i, j in fixed) + len(gone)
        total += sum(x[i][u] != y[j][v] for i, j in fixed for u, v in fixed)
        total += sum(sum(x[i]) for i in gone) + sum(x[i][u] for i, _ in fixed for u in gone)
        if self.loose:
            total -= 2 * sum(x[i][i] != y[j][j] for i, j in fixed)
        if not rows:
            if free:
                total += len(free) + sum(sum(y[j]) for j in free) + sum(y[v][j] for _, v in fixed for j in free)
            return float(total), list(to)
        total += sum(x[i][u] for i in rows for u in gone)  # edges to what goes, or from it, go too; the latter are counted above

        def ends(e, nodes, kept):
            """Of each node: its loop, its edges to and from the others, and to and from those that are kept."""
            for i in nodes:
                out, into = sum(e[i][u] for u in nodes) - e[i][i], sum(e[u][i] for u in nodes) - e[i][i]
                yield e[i][i], out, into, [e[i][u] for u in kept] + [e[u][i] for u in kept]

        left, right = list(ends(x, rows, [i for i, _ in fixed])), list(ends(y, free, [j for _, j in fixed]))
        alone = lambda end: 1.0 + end[0] + sum(end[3]) + 0.5 * (end[1] + end[2])
        insert, differ = [alone(end) for end in right], -1.0 if self.loose else 1.0
        cost = []
        for at, (loop, out, into, kept) in enumerate(left):
            labels = self.labels[k + at]
            row = []
            for j, gain, (loop_y, out_y, into_y, kept_y) in zip(free, insert, right):
                apart = sum(map(operator.ne, kept, kept_y)) + (differ if loop != loop_y else 0.0)
                row.append(labels[j] + 0.5 * (abs(out - out_y) + abs(into - into_y)) + apart - gain)
            cost.append(row + [1e9] * len(left))
            cost[at][len(free) + at] = alone(left[at])
        columns = _small_assignment(cost)
        least = sum(cost[i][c] for i, c in enumerate(columns))
        return float(total + sum(insert) + least), [*to, *(free[c] if c < len(free) else None for c in columns)]

    def whole(self, to: list[int | None]) -> float:
        """What an assignment costs, in the direction that was asked for."""
        return mapping_cost(self.a, self.b, to, self.loose, self.labels)


def edit_distance(a, b, limit: int = SEARCH_LIMIT, loose: bool = False) -> float:
    """Least cost of node and edge edits, or the least found within `limit` partial assignments."""
    return search(a, b, limit, loose)[0]


def search(a, b, limit: int = SEARCH_LIMIT, loose: bool = False, known: dict | None = None) -> tuple[float, bool]:
    """Least cost of node and edge edits, and whether that is proven: False where the limit ended the search. known: the
    distances of all pairs of labels, where they were made for many graphs together."""
    if not a[0] or not b[0]:
        return float(len(a[0]) + len(a[1]) + len(b[0]) + len(b[1])), True
    pair = _Pair(a, b, loose, known)
    low, some = pair.bound([])
    best = min(pair.whole(some), pair.whole(list(range(len(pair.a[0])))))
    heap, looked = [(low, 0, 0, [])], 0
    while heap:
        low, _, _, to = heapq.heappop(heap)
        if low >= best - 1e-9:
            return best, True
        if len(to) == len(pair.a[0]):
            continue
        for j in [*range(len(pair.b[0])), None]:
            if j is not None and (j in to or any(i not in to for i in pair.twins[j])):
                continue
            looked += 1
            if looked > limit:
                return best, False
            bound, some = pair.bound([*to, j])
            if bound < best - 1e-9:
                best = min(best, pair.whole(some))
                heapq.heappush(heap, (bound, -len(to), looked, [*to, j]))
    return best, True


TOGETHER = 64  # pairs of graphs whose labels are compared at once


def compared(pred, gold, most: int | None = None):
    """Graphs of two columns of steps, pair by pair, with the distances of their labels (only those that are paired by
    place, for graphs of more than `most` nodes)."""
    both = list(zip(pred, gold))
    for at in range(0, len(both), TOGETHER):
        graphs = [(graph(list(p)), graph(list(g))) for p, g in both[at : at + TOGETHER]]
        large = lambda a, b: most is not None and max(len(a[0]), len(b[0])) > most
        known = label_distances(p for a, b in graphs for p in (zip(a[0], b[0]) if large(a, b) else ((x, y) for x in a[0] for y in b[0])))
        for a, b in graphs:
            yield a, b, known


def normalized(pred: list[str], gold: list[str], most: int = MAX_NODES, loose: bool = True) -> tuple[float, str | None]:
    """(distance over the larger graph's nodes and edges, why it may not be the least: "node_cap" where it isn't
    searched for, "step_budget" where the search was ended). Self-loops count as edges; loose: they may be paired with
    other edges at their node at no cost, as heuristic searches do."""
    return _normalized(*next(compared([pred], [gold], most)), most, loose)


def _normalized(a, b, known: dict, most: int = MAX_NODES, loose: bool = True) -> tuple[float, str | None]:
    size = max(len(a[0]) + len(a[1]), len(b[0]) + len(b[1]))
    if size == 0:
        return 0.0, None
    if not a[0] or not b[0]:
        return 1.0, None
    if max(len(a[0]), len(b[0])) > most:
        return positional_cost(a, b, known) / size, "node_cap"
    cost, proven = search(a, b, loose=loose, known=known)
    return cost / size, None if proven else "step_budget"


def policy(config: dict) -> dict:
    """The distance's settings, all there and sound: max_nodes (a positive whole number) and loose_loops (a truth value)."""
    unknown, most, loose = set(config) - {"max_nodes", "loose_loops"}, config.get("max_nodes"), config.get("loose_loops")
    if unknown or not isinstance(most, int) or isinstance(most, bool) or most < 1 or not isinstance(loose, bool):
        raise ValueError(f"a distance policy has max_nodes and loose_loops, not {config}")
    return {"most": most, "loose": loose}


GED = T.StructType([T.StructField("ged", T.DoubleType()), T.StructField("ged_fallback", T.StringType())])


def ged_by(config: dict):
    """A pandas UDF of two columns of break_steps arrays under a policy."""
    settings = policy(config)

    @F.pandas_udf(GED)
    def run(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_normalized(*x, **settings) for x in compared(pred, gold, settings["most"])], columns=["ged", "ged_fallback"])

    return run


@F.pandas_udf(GED)
def ged(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Of two columns of break_steps arrays."""
    return pd.DataFrame([_normalized(*x) for x in compared(pred, gold, MAX_NODES)], columns=["ged", "ged_fallback"])


@F.pandas_udf(T.StructType([T.StructField("bound", T.DoubleType()), T.StructField("exact", T.DoubleType()), T.StructField("proven", T.BooleanType())]))
def bound_gap(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Costs of the pairing by position and of the best one, before they are normalized."""
    return pd.DataFrame([(positional_cost(a, b, known), *search(a, b, known=known)) for a, b, known in compared(pred, gold)], columns=["bound", "exact", "proven"])


@F.pandas_udf(T.DoubleType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 - label_distance(x, y) for x, y in zip(a, b)])


NONSENSE = "qux frob the wug"
SHAPES = ("chain", "repeat_text", "gold_repeat", "all_pairs", "nonsense", "nonsense_refs", "gold_no_refs", "gold_refs")


def shape(name: str, n: int, gold: list[str]) -> list[str]:
    """Deterministic lists of n steps for timing the distance: "gold_no_refs" repeats the gold's first step, "gold_refs" its
    first step with a reference, "nonsense_refs" one text that refers to step 1."""
    if not gold:
        raise ValueError("shapes are made from a gold decomposition")
    referring = next((x for x in gold if re.search(r"#\d+|@@\d+@@", x)), None)
    if name == "gold_refs" and referring is None:
        raise ValueError("no gold step has a reference")
    makers = {
        "chain": lambda i: f"do @@{i - 1}@@" if i > 1 else "do it",
        "repeat_text": lambda i: "the same step",
        "gold_repeat": lambda i: gold[(i - 1) % len(gold)],
        "all_pairs": lambda i: " ".join(["join", *(f"@@{k}@@" for k in range(1, i))]),
        "nonsense": lambda i: NONSENSE,
        "nonsense_refs": lambda i: f"{NONSENSE} @@1@@",
        "gold_no_refs": lambda i: gold[0],
        "gold_refs": lambda i: referring,
    }
    return [makers[name](i) for i in range(1, n + 1)]
