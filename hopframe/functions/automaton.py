"""Many names looked for at once, in any case: a tree of all names with failure links, as flat arrays.

Nodes are numbered level by level, children by their parents and letters, so the sorted keys `parent << 21 | letter` are
the whole transition table. `fail` leads to the longest proper suffix that is in the tree too, `link` to the longest
suffix that is a name. Levels are built with array operations, so a million names take seconds.

Texts are read in lanes of LANE letters, all of them at once, letter by letter. A state depends on the last `deepest`
letters alone, so a lane that begins as many letters earlier arrives in the state that a reader of the whole text would
be in. Time is linear in the texts; names are stored once (`save`) and mapped by the workers of a machine together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LANE = 512
BREAK = 0x110000  # between texts: no letter
RUN = 1 << 20  # letters that are read at a time; a longer text by itself


def lowered(text: str) -> str:
    """Lower case of the same length: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def runs(texts: list[str]):
    """Where runs of texts of about RUN letters begin and end."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > RUN:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


@dataclass
class Automaton:
    key: np.ndarray  # parent << 21 | letter of each node, ascending; the root's is -1
    fail: np.ndarray
    link: np.ndarray  # the longest suffix that is a name, the node's own word included; -1: none
    after: np.ndarray  # the next shorter one, from a node that is a name
    depth: np.ndarray
    tag: np.ndarray  # of nodes that are names, else -1

    @classmethod
    def build(cls, names: list[str], tags: list[int] | None = None) -> Automaton:
        """Empty names are left out; of names that differ by case alone the last one's tag counts."""
        pairs = {lowered(n): t for n, t in zip(names, tags or [0] * len(names)) if n}
        words, marks = list(pairs), np.array(list(pairs.values()), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        data, start = letters("".join(words)), np.cumsum(sizes) - sizes
        node, level = np.zeros(len(words), np.int64), 0
        keys, depths = [np.array([-1])], [np.array([0])]
        ends = np.zeros(len(words), np.int64)
        count = 1
        alive = np.arange(len(words))
        while len(alive):
            own = (node[alive] << 21) | data[start[alive] + level]
            fresh, place = np.unique(own, return_inverse=True)
            node[alive] = count + place
            keys.append(fresh)
            depths.append(np.full(len(fresh), level + 1))
            count += len(fresh)
            level += 1
            over = sizes[alive] == level
            ends[alive[over]] = node[alive[over]]
            alive = alive[~over]
        key, depth = np.concatenate(keys), np.concatenate(depths).astype(np.int32)
        tag = np.full(count, -1, np.int32)
        tag[ends] = marks
        if len(words) == 0:
            tag[0] = -1
        made = cls(key, np.zeros(count, np.int32), np.full(count, -1, np.int32), np.full(count, -1, np.int32), depth, tag)
        first = 1
        for fresh in keys[1:]:
            nodes = np.arange(first, first + len(fresh))
            first += len(fresh)
            parent, letter = fresh >> 21, fresh & 0x1FFFFF
            made.fail[nodes] = np.where(parent == 0, 0, made.step(made.fail[parent].astype(np.int64), letter))
            suffix = made.link[made.fail[nodes]]
            made.after[nodes] = suffix
            made.link[nodes] = np.where(tag[nodes] >= 0, nodes, suffix)
        return made

    @property
    def deepest(self) -> int:
        return int(self.depth[-1])

    def child(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        wanted = (state << 21) | letter
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, -1)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter each."""
        out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            found = self.child(state[open_], letter[open_])
            there = found >= 0
            out[open_[there]] = found[there]
            open_ = open_[~there & (state[open_] != 0)]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return out

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, end and tag of every occurrence of every name in lower-cased texts, by text, start and end descending."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        none = np.empty(0, np.int64)
        if not len(texts) or len(self.key) < 2:
            return none, none, none, none
        line = np.full(int(sizes.sum()), BREAK, np.int64)
        first = np.cumsum(sizes) - sizes
        inside = np.ones(len(line), bool)
        inside[first + sizes - 1] = False
        line[inside] = letters("".join(texts))
        roots = np.zeros(int(line.max()) + 1, np.int64)  # the root's children by letter
        top = self.key[1 : 1 + int((self.depth == 1).sum())]
        here = top[top < len(roots)]
        roots[here] = 1 + np.arange(len(here))
        lanes = np.arange(0, len(line), LANE)
        begin = np.maximum(lanes - self.deepest, 0)
        state, found = np.zeros(len(lanes), np.int64), []
        for t in range(LANE + self.deepest):
            at = begin + t
            live = np.flatnonzero((at < len(line)) & (at < lanes + LANE))
            if len(live) == 0:
                break
            letter = line[at[live]]
            now = state[live]
            new = roots[letter]
            deep = np.flatnonzero(now)
            if len(deep):
                new[deep] = self.step(now[deep], letter[deep])
            state[live] = new
            name = self.link[new]
            hit = np.flatnonzero((name >= 0) & (at[live] >= lanes[live]))
            where, name = at[live][hit], name[hit].astype(np.int64)
            while len(name):
                found.append((where, name))
                name = self.after[name].astype(np.int64)
                where, name = where[name >= 0], name[name >= 0]
        if not found:
            return none, none, none, none
        end, node = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(first, end, "right") - 1
        end = end + 1 - first[text]
        start = end - self.depth[node]
        order = np.lexsort((-end, start, text))
        return text[order], start[order], end[order], self.tag[node][order].astype(np.int64)

    def chosen(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, tag) of the names that are taken in each text, leftmost first and the longest of each place, those
        left out that begin or end inside a word. Whether it does is looked at after the longest is chosen, so such a
        name also hides the shorter ones within it."""
        return [spans for a, b in runs(texts) for spans in self._chosen(texts[a:b])]

    def _chosen(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        low = [lowered(t) for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        last, free = -1, 0
        for i, s, e, tag in zip(*(x.tolist() for x in self.find(low))):
            if i != last:
                last, free = i, 0
            if s < free:
                continue
            free, t = e, low[i]
            if (s == 0 or not t[s - 1].isalnum()) and (e == len(t) or not t[e].isalnum()):
                out[i].append((s, e, tag))
        return out

    def replace(self, texts: list[str], placeholders: list[str]) -> list[str]:
        out = []
        for text, spans in zip(texts, self.chosen(texts)):
            parts, at = [], 0
            for s, e, tag in spans:
                parts += [text[at:s], placeholders[tag]]
                at = e
            out.append("".join([*parts, text[at:]]) if spans else text)
        return out

    def occurring(self, texts: list[str]) -> set[str]:
        """The names, lower-cased, that occur anywhere in the texts, inside words too."""
        out: set[str] = set()
        for a, b in runs(texts):
            low = [lowered(t) for t in texts[a:b]]
            text, start, end, _ = self.find(low)
            out |= {low[i][s:e] for i, s, e in zip(text.tolist(), start.tolist(), end.tolist())}
        return out

    def save(self, path: str) -> None:
        from pyarrow import fs as pafs

        columns = {"key": self.key.astype(np.int64), "fail": self.fail, "link": self.link, "after": self.after, "depth": self.depth, "tag": self.tag}
        table = pa.table(columns)
        fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(base) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table, max_chunksize=max(1, len(self.key)))

    @classmethod
    def load(cls, path: str) -> Automaton:
        """Mapped where the file is on this machine, read otherwise."""
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        source = pa.memory_map(base) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(base)
        table = pa.ipc.open_file(source).read_all()
        return cls(*(table[c].chunk(0).to_numpy() for c in ("key", "fail", "link", "after", "depth", "tag")))


_LOADED: dict[str, Automaton] = {}


def loaded(path: str) -> Automaton:
    """A worker's copy of a stored automaton, one at a time."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Automaton.load(path)
    return _LOADED[path]
