"""Benchmark decontamination by latent semantic retrieval.

1. Word weights (inverse document frequencies) come from all documents, in 2**BITS hashed counters.
2. Benchmark items are cut into passages of WINDOW words, STRIDE apart; shorter items are in classes by length, the
   smallest window of WINDOWS that holds them. The TF-IDF matrix of the passages is
   factored by a distributed randomised SVD: partitions of passages multiply their rows with a random (then with
   the improved) basis and back; the driver sums the products, whose size is that of the group's vocabulary. A group
   has at most RANK passages and a rank of as many, so that every passage keeps its own direction.
3. Documents are cut into windows of each class, and these are folded into the latent space. A window is a candidate for
   the items of passages with a cosine of COSINE or more (a word counts once in a window's vector, and each time in
   its norm). Windows that can't reach it, since too little of their weight is on the words of any one passage, are
   left out first; that bound loses none while the rank is that of the passages (below it, a passage's image also has
   words that aren't the passage's). Exact copies of items are candidates whatever their cosine: each item is
   also looked for as a sequence, from its rarest word.
4. Candidates are verified on the words themselves: the longest common subsequence of item and the window's
   surroundings must cover LCS_SHARE of the item, and ANSWER_SHARE of its answer (what follows "answer:", else the
   rarest quarter of its words) must be there. Paraphrases with changed or moved words pass; texts on the
   same matters don't.
5. What passes 4 isn't left to the cosine, which falls below COSINE where the words kept are the common ones: windows that
   the search didn't give are verified too if their surroundings hold as many of the item's words, and of its rarest
   ones, as 4 asks for. So all windows that pass 4 are found, and shares are the best of all windows.

Items are worked on in blocks of about BLOCK passages, so what workers are told doesn't grow with the benchmark; documents
are read once for each block. A block of more than RANK passages has several groups (an item's passages may be in two).

Null and empty texts match nothing; items shorter than LEAST words match exact copies only; repeated documents and
items are all reported; a null doc_id or item_id is reported as null; of a document's equal matches of an item the
share is the same, so ties need no rule; texts of any length are searched whole, in one task each; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = 1 << 19  # bytes of text that a worker looks at together
BITS = 18
WINDOW, STRIDE = 32, 16
WINDOWS = (8, 16, WINDOW)
RANK = 512
ROUNDS = 2  # of power iteration
COSINE = 0.35
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
LEAST = 5
BLOCK = 512
FEW = 4
PAIRS = 1 << 19  # of words and items that a worker looks at together


def _weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hashed counter."""
    size = 1 << BITS

    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text", RUN):
                h, rows, _, _ = common.word_hashes(*common.text_buffers(part.column(0)))
                pairs = np.unique(rows * size + (h >> np.uint64(64 - BITS)).astype(np.int64))
                total[:size] += np.bincount(pairs & (size - 1), minlength=size)
                total[size] += part.num_rows
        yield from common.dense_batches(total)

    total = common.sum_dense(docs.select("text").mapInArrow(common.tidy(count), common.DENSE), size + 1)
    return np.log((total[size] + 1.0) / (total[:size] + 1.0)) + 0.05


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with a's places as the bits of an integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := places.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Item:
    def __init__(self, item_id: int | None, text: str | None, idf: np.ndarray):
        self.item_id = item_id
        raw = np.frombuffer((text or "").encode(), np.uint8)
        self.words, _, starts, _ = common.word_hashes(raw, np.array([0, len(raw)]))
        weight = idf[bucket(self.words)]
        marker = (text or "").lower().rfind("answer:")
        answer = self.words[starts >= len((text or "")[: marker + 7].encode())] if marker >= 0 else self.words[:0]
        if not len(answer):
            answer = self.words[np.argsort(-weight, kind="stable")[: max(1, math.ceil(len(self.words) / 4))]]
        self.answer = np.unique(answer)

    def passages(self) -> list[np.ndarray]:
        n = len(self.words)
        return [self.words[a : a + WINDOW] for a in range(0, max(n - STRIDE, 1), STRIDE)]

    def matches(self, region: np.ndarray) -> tuple[float, float] | None:
        """Shares of the item and of its answer found in the region, if it passes."""
        answer = float(np.isin(self.answer, region).mean())
        if answer < ANSWER_SHARE:
            return None
        if len(self.words) > 256 and np.isin(self.words, region).mean() < LCS_SHARE:  # much faster there than a subsequence
            return None
        share = lcs(self.words, region) / len(self.words)
        return (share, answer) if share >= LCS_SHARE else None


def _rows(ids: list[np.ndarray], weights: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a basis."""
    flat = np.concatenate(ids)
    first = np.cumsum([0, *map(len, ids)])[:-1]
    return np.add.reduceat(np.concatenate(weights)[:, None] * basis[flat], first, axis=0)


def randomised_svd(rows: DataFrame, terms: int, rank: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of the matrix with rows (ids array<int>, weights array<double>)."""
    spark = rows.sparkSession
    rank = min(rank, terms)

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        shared = common.tell(spark, basis, "basis")

        def multiply(batches):
            q = common.told(shared)
            out = np.zeros((q.shape[1], q.shape[1]) if gram else q.shape)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    ids = [np.asarray(x) for x in batch.column(0).slice(at, 256).to_pylist()]
                    weights = [np.asarray(x) for x in batch.column(1).slice(at, 256).to_pylist()]
                    y = _rows(ids, weights, q)
                    if gram:
                        out += y.T @ y
                    else:
                        own = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                        np.add.at(out, np.concatenate(ids), np.concatenate(weights)[:, None] * y[own])
            yield pa.RecordBatch.from_pydict({"part": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

        parts = rows.mapInArrow(common.tidy(multiply), "part binary").toLocalIterator()
        shape = (basis.shape[1], basis.shape[1]) if gram else basis.shape
        total = sum((np.frombuffer(r[0], np.float32).reshape(shape).astype(np.float64) for r in parts), np.zeros(shape))
        common.remove(spark, shared)
        return total

    basis = np.random.default_rng(seed).standard_normal((terms, rank))
    for _ in range(1 + rounds):
        basis, _ = np.linalg.qr(product(basis, False))
    values, vectors = np.linalg.eigh(product(basis, True))
    keep = values > 1e-9 * max(values.max(initial=0.0), 1e-30)
    return (basis @ vectors[:, keep][:, ::-1]).astype(np.float32)


def window_of(n: int) -> int:
    """The window of the class of n words."""
    return next((w for w in WINDOWS if n <= w), WINDOW)


def groups(items: list[Item]) -> list[list[tuple[int, np.ndarray]]]:
    """(number of the item, words) of all passages, in groups of one class, at most RANK and about the same size. Items
    under LEAST words have none."""
    classes: dict[int, list] = {}
    for k, item in enumerate(items):
        if len(item.words) >= LEAST:
            classes.setdefault(window_of(len(item.words)), []).extend((k, p) for p in item.passages())
    sizes = {w: -(-len(every) // -(-len(every) // RANK)) for w, every in classes.items()}
    return [every[a : a + sizes[w]] for w, every in sorted(classes.items()) for a in range(0, len(every), sizes[w])]


class Exact:
    """Finds exact copies of items' words, from the rarest word of each."""

    def __init__(self, items: list[Item], idf: np.ndarray):
        self.length = np.array([len(x.words) for x in items])
        self.flat = np.concatenate([x.words for x in items])
        self.begin = np.cumsum(self.length) - self.length
        self.place = np.array([int(idf[bucket(x.words)].argmax()) for x in items])
        anchor = self.flat[self.begin + self.place]
        self.order = np.argsort(anchor, kind="stable")
        self.anchors, self.first, self.n = np.unique(anchor[self.order], return_index=True, return_counts=True)
        self.mark = np.zeros(1 << BITS, bool)
        self.mark[bucket(anchor)] = True

    def copies(self, h: np.ndarray, offsets: np.ndarray):
        """(text, item) of the copies among texts' words."""
        place = np.flatnonzero(self.mark[bucket(h)])
        at = np.minimum(np.searchsorted(self.anchors, h[place]), len(self.anchors) - 1)
        same = self.anchors[at] == h[place]
        place, at = place[same], at[same]
        n = self.n[at]
        item = self.order[np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = np.repeat(place, n) - self.place[item]
        row = np.searchsorted(offsets, np.repeat(place, n), "right") - 1
        keep = (start >= offsets[row]) & (start + self.length[item] <= offsets[row + 1])
        for step in range(STRIDE):
            item, start, row = item[keep], start[keep], row[keep]
            last = self.length[item] - 1
            keep = h[start + np.minimum(step, last)] == self.flat[self.begin[item] + np.minimum(step, last)]
        found = set()
        for r, k, a in zip(row[keep].tolist(), item[keep].tolist(), start[keep].tolist()):
            n, b = self.length[k], self.begin[k]
            if (r, k) not in found and (n <= STRIDE or np.array_equal(h[a : a + n], self.flat[b : b + n])):
                found.add((r, k))
        return found


class Rest:
    """Finds the windows that can pass `Item.matches`, whatever their cosine, and loses none that do.

    Of an item's k rarest words at most as many are missing as LCS_SHARE lets be missing of all, and of its answer's words
    ANSWER_SHARE is there. For each item that of these signs is looked for which is expected to give the fewest windows;
    where enough of them are within reach of a window, all words of the item, and of its answer, are counted there. Items
    under LEAST words have no signs."""

    def __init__(self, items: list[Item], idf: np.ndarray):
        self.length = np.array([len(x.words) for x in items])
        self.window = np.array([window_of(n) for n in self.length])
        self.need = np.ceil(LCS_SHARE * self.length - 1e-9).astype(np.int64)
        self.reach = self.window + 2 * self.length  # words that a window and its surroundings have
        self.vocabulary = np.unique(np.concatenate([x.words for x in items]))
        self.known = self._keys([x.words for x in items])
        self.answer = np.isin(self.known, self._keys([x.answer for x in items]))
        self.answers = np.array([math.ceil(ANSWER_SHARE * len(x.answer)) for x in items])
        share = np.exp(-idf) / np.exp(-idf).sum()  # of all words, about; says what costs least, not what is found
        self.least = np.zeros(len(items), np.int64)
        signs, owners = [], []
        for k, item in enumerate(items):
            if len(item.words) >= LEAST:
                words, self.least[k] = self._signs(item, share, int(self.need[k]), int(self.reach[k]), int(self.window[k]) // 2)
                signs.append(words)
                owners.append(np.full(len(words), k))
        signs, owners = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((signs, np.uint64), (owners, np.int64)))
        order = np.argsort(signs, kind="stable")
        self.owner = owners[order]
        self.signs, self.first, self.n = np.unique(signs[order], return_index=True, return_counts=True)
        self.mark = np.zeros(1 << BITS, bool)
        self.mark[bucket(self.signs)] = True

    def _keys(self, words: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
        return np.unique(owner * len(self.vocabulary) + np.searchsorted(self.vocabulary, np.concatenate(words)))

    @staticmethod
    def _signs(item: Item, share: np.ndarray, need: int, reach: int, stride: int) -> tuple[np.ndarray, int]:
        """Words, and how many of their places a window and its surroundings must have."""
        weight = share[bucket(item.words)]
        order = np.lexsort((item.words, weight))
        words, weight = item.words[order], weight[order]
        new = np.ones(len(words), bool)
        new[1:] = words[1:] != words[:-1]
        missing = len(words) - need
        # the first missing + c of them have c that are there, for each c; the last option is the answer
        c = np.append(np.arange(1, need + 1), math.ceil(ANSWER_SHARE * len(item.answer)))
        often = np.append(np.cumsum(weight * new)[missing:], share[bucket(item.answer)].sum())
        factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(c) + 1)))))
        windows = np.exp(np.minimum(c * np.log(reach * often) - factorial[c], 0.0))
        best = int((often + windows * reach / stride).argmin())
        return (item.answer if best == need else np.unique(words[: missing + best + 1])), int(c[best])

    def candidates(self, h: np.ndarray, offsets: np.ndarray):
        """(text, first word of the window, its end, item, how many of its surroundings' words are the item's)."""
        place = np.flatnonzero(self.mark[bucket(h)])
        at = np.searchsorted(self.signs, h[place])
        same = self.signs[np.minimum(at, len(self.signs) - 1)] == h[place] if len(place) else np.empty(0, bool)
        place, at = place[same], at[same]
        pairs = np.cumsum(self.n[at])
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, "right")))
            yield from self._some(h, offsets, place, at, a, b)
            a = b

    def _some(self, h, offsets, place, at, a, b):
        """Those whose first sign is one of a to b."""
        c = int(np.searchsorted(place, place[b - 1] + self.reach.max()))
        n = self.n[at[a:c]]
        item = self.owner[np.repeat(self.first[at[a:c]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(item, kind="stable")
        item, begin = item[order], np.repeat(place[a:c], n)[order]
        last = np.arange(len(item)) + self.least[item] - 1
        inside = np.minimum(last, len(item) - 1)
        end, length, window = begin[inside], self.length[item], self.window[item]
        text = np.searchsorted(offsets, begin, "right") - 1
        keep = (last == inside) & (item[inside] == item) & (end < offsets[text + 1]) & (end - begin < self.reach[item]) & (begin <= place[b - 1])
        item, begin, end, text, length, window = (x[keep] for x in (item, begin, end, text, length, window))
        # windows are numbered within their text; those of one item and text go up
        stride, first, size = window // 2, offsets[text], offsets[text + 1] - offsets[text]
        low = np.maximum(-(-(end - window - length + 1 - first) // stride), 0)
        high = np.minimum((begin + length - first) // stride, np.maximum(-(-(size - stride) // stride), 1) - 1)
        again = np.zeros(len(item), bool)
        again[1:] = (item[1:] == item[:-1]) & (text[1:] == text[:-1])
        low[1:] = np.where(again[1:], np.maximum(low[1:], high[:-1] + 1), low[1:])
        keep = low <= high
        item, text, low, high, length, window, stride, first = (x[keep] for x in (item, text, low, high, length, window, stride, first))
        # stretches of windows, whose words are looked up once
        part = low // np.maximum(PAIRS // stride, 1)
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1) | (part[1:] != part[:-1])
        high = np.maximum.reduceat(high, np.flatnonzero(new)) if len(item) else high
        item, text, low, length, window, stride, first = (x[new] for x in (item, text, low, length, window, stride, first))
        begin = np.maximum(first, first + stride * low - length)
        end = np.minimum(offsets[text + 1], first + stride * high + window + length)
        total = np.cumsum(end - begin)
        at = 0
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            k = slice(at, to)
            width = end[k] - begin[k]
            base = np.cumsum(width) - width
            words = h[np.repeat(begin[k] - base, width) + np.arange(width.sum())]
            word = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            key = np.repeat(item[k], width) * len(self.vocabulary) + word
            place = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            own = (self.vocabulary[word] == words) & (self.known[place] == key)
            sums, answers = (np.concatenate(([0], np.cumsum(x))) for x in (own, own & self.answer[place]))
            n = high[k] - low[k] + 1
            of = np.repeat(np.arange(at, to), n)
            start = first[of] + stride[of] * (low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            stop = np.minimum(start + window[of], offsets[text[of] + 1])
            shift = base[of - at] - begin[of]
            left, right = np.maximum(start - length[of], begin[of]) + shift, np.minimum(stop + length[of], end[of]) + shift
            held = sums[right] - sums[left]
            live = (held >= self.need[item[of]]) & (answers[right] - answers[left] >= self.answers[item[of]])
            yield from zip(*(x[live].tolist() for x in (text[of], start, stop, item[of], held)))
            at = to


class Index:
    """One group of passages in latent space."""

    def __init__(self, spark, passages: list[tuple[int, np.ndarray]], idf: np.ndarray, partitions: int = 4):
        self.idf = idf
        self.window = window_of(max(len(p) for _, p in passages))
        self.stride = self.window // 2
        self.vocabulary = np.unique(np.concatenate([p for _, p in passages]))
        owners, ids, weights = [], [], []
        for k, p in passages:
            words, n = np.unique(p, return_counts=True)
            w = n * idf[bucket(words)]
            owners.append(k)
            ids.append(np.searchsorted(self.vocabulary, words))
            weights.append(w / np.linalg.norm(w))
        table = spark.createDataFrame([([int(i) for i in a], [float(x) for x in w]) for a, w in zip(ids, weights)], "ids array<int>, weights array<double>")
        basis = randomised_svd(table.repartition(partitions), len(self.vocabulary), len(ids))
        self.owner = np.array(owners)
        latent = _rows(ids, weights, basis)
        self.passages = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.words = (basis * idf[bucket(self.vocabulary)][:, None]).astype(np.float32)
        # which passages a word is in, for words that are in few
        pairs = np.unique(np.concatenate([np.unique(a) * len(ids) + p for p, a in enumerate(ids)]))
        word, passage = pairs // len(ids), pairs % len(ids)
        n = np.bincount(word, minlength=len(self.vocabulary))
        self.few = n <= FEW
        self.of_word, self.first_of = passage, np.cumsum(n) - n
        self.n_of = n
        self.square = idf[bucket(self.vocabulary)] ** 2

    def candidates(self, h: np.ndarray, offsets: np.ndarray):
        """(first word of the window, item) of the candidates among texts' words (offsets: where texts begin)."""
        n = len(h)
        if n == 0:
            return
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h
        square = self.idf[bucket(h)] ** 2
        sizes = np.diff(offsets)
        steps = np.maximum(-(-(sizes - self.stride) // self.stride), 1) * (sizes > 0)
        text = np.repeat(np.arange(len(sizes)), steps)
        start = offsets[text] + self.stride * (np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps))
        end = np.minimum(start + self.window, offsets[text + 1])
        all_ = np.concatenate(([0.0], np.cumsum(square)))
        own = np.concatenate(([0.0], np.cumsum(square * hit)))
        norm = all_[end] - all_[start]
        may = np.flatnonzero(own[end] - own[start] >= COSINE**2 * norm * (1 - 1e-6))
        for a in range(0, len(may), 1024):
            some = may[a : a + 1024]
            places = start[some][:, None] + np.arange(self.window)
            inside = places < end[some][:, None]
            places = np.minimum(places, n - 1)
            inside &= hit[places]
            # a word counts once in a window, so <x, p> is at most the norm of x on the words of p: the words that
            # are in many passages, and those of the passage with which it shares most of the others
            pairs = np.unique(np.repeat(np.arange(len(some)), inside.sum(axis=1)) * len(self.vocabulary) + at[places[inside]])
            owner, flat = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
            most = np.bincount(owner, weights=self.square[flat] * ~self.few[flat], minlength=len(some))
            rare = np.flatnonzero(self.few[flat])
            n_of = self.n_of[flat[rare]]
            again = np.repeat(rare, n_of)
            step = np.arange(len(again)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
            key = owner[again] * len(self.passages) + self.of_word[self.first_of[flat[again]] + step]
            if len(key):
                kinds, back = np.unique(key, return_inverse=True)
                shared = np.bincount(back, weights=self.square[flat[again]])
                own_of = kinds // len(self.passages)
                first = common.run_starts(own_of)
                most[own_of[first]] += np.maximum.reduceat(shared, first)
            live = most >= COSINE**2 * norm[some] * (1 - 1e-6)
            if not live.any():
                continue
            keep = live[owner]
            owner, flat, some = (np.cumsum(live) - 1)[owner[keep]], flat[keep], some[live]
            vectors = np.add.reduceat(self.words[flat], common.run_starts(owner), axis=0)  # each has a word
            near = vectors @ self.passages.T
            w, p = np.nonzero(near >= COSINE * np.sqrt(norm[some])[:, None])
            most_items = int(self.owner.max()) + 1
            for k in np.unique(w * most_items + self.owner[p]):
                i, item = divmod(int(k), most_items)
                yield int(some[i]), int(text[some[i]]), int(start[some[i]]), int(end[some[i]]), item


FOUND = "doc_id long, item_id long, lcs_share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_id, doc_id, item_id, lcs_share, answer_share) of documents that hold a benchmark item; row_id is that of
    with_row_id(docs)."""
    spark = docs.sparkSession
    source = common.with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = _weights(docs)
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
    out = spark.createDataFrame([], "row_id long, " + FOUND)
    items = common.stage(benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"), "benchmark")
    n_words = F.size(F.split("text", r"[ \t\n\x0B\f\r]+"))
    n_passages = items.select(F.sum(F.greatest(F.ceil((n_words - STRIDE) / STRIDE), F.lit(1)))).first()[0]
    n_blocks = max(1, -(-(n_passages or 0) // BLOCK))
    for block in range(n_blocks):
        # a block has BLOCK passages on average, whatever the benchmark's size
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        held = [x for x in (Item(r.item_id, r.text, idf) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id, r.text))) if len(x.words)]
        if not held:
            continue
        shared = common.tell(spark, (held, Exact(held, idf), [Index(spark, group, idf) for group in groups(held)], Rest(held, idf)), "block")

        def search(batches, shared=shared):
            items, exact, indices, rest = common.told(shared)
            for batch in batches:
                for part in common.slices(batch, "text", RUN):
                    h, text, _, _ = common.word_hashes(*common.text_buffers(part.column(2)))
                    offsets = np.searchsorted(text, np.arange(part.num_rows + 1))
                    best: dict[tuple[int, int], tuple[float, float]] = dict.fromkeys(exact.copies(h, offsets), (1.0, 1.0))
                    seen = set()

                    def verify(row, start, end, k):
                        item = items[k]
                        reach = len(item.words)
                        region = h[max(offsets[row], start - reach) : min(offsets[row + 1], end + reach)]
                        if found := item.matches(region):
                            best[row, k] = max(best.get((row, k), found), found)

                    for _, row, start, end, k in (c for index in indices for c in index.candidates(h, offsets)):
                        if (row, k) not in best or best[row, k][0] < 1:
                            seen.add((start, k))
                            verify(row, start, end, k)
                    for row, start, end, k, n in rest.candidates(h, offsets):
                        so_far = best.get((row, k), (0.0,))[0]
                        if so_far < 1 and n / len(items[k].words) >= so_far and (start, k) not in seen:
                            verify(row, start, end, k)
                    if best:
                        ids, names = part.column(0).to_pylist(), part.column(1).to_pylist()
                        cols = zip(*((ids[r], names[r], items[k].item_id, a, b) for (r, k), (a, b) in sorted(best.items())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        found = common.stage(source.mapInArrow(common.tidy(search), "row_id long, " + FOUND), "leaks")
        common.remove(spark, shared)
        out = out.unionByName(found)
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents of `documents` that hold items of `benchmark`: doc_id, item_id, lcs_share, answer_share."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("row_id")
