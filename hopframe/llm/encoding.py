"""Tokenizer files applied to Arrow batches of text."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from . import common

_LOADED: dict[str, object] = common.held({})


def tokenizer(path: str):
    """A tokenizer file, loaded once per worker process, on one thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Kinds of bytes: where a text holds only these, it can be cut into pieces that the tokenizers encode on their own.
SPACE, BREAK, LETTER, DIGIT, MARK, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x20] = SPACE
KIND[0x09:0x0E] = BREAK
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[0xC3] = LETTER  # with its next byte, a letter of Latin-1; see plain_rows
KIND[0x80:0xC0] = LETTER
MOST_PIECES = 500_000  # remembered by a worker, in about 50 MB
SLOTS = 22
RUN_WORDS = 64


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold only ASCII and Latin-1 letters, and no mark of a special token ("<|")."""
    before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
    high = data >= 0x80
    bad = KIND[data] == OTHER
    bad |= high & (data != 0xC3) & ((before != 0xC3) | (data > 0xBF) | (data == 0x97) | (data == 0xB7))
    bad |= (data == ord("|")) & (before == ord("<"))
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces: at text starts, before a space between words, between letters and marks, and before
    letters after marks or a single line break (an apostrophe and what is beside it stay together). At all of these places both
    tokenizers' patterns end a pre-token, so the pieces' ids are those of the text."""
    k = KIND[data]
    prev, nxt = np.empty_like(k), np.empty_like(k)
    prev[0], prev[1:] = BREAK, k[:-1]
    nxt[-1], nxt[:-1] = BREAK, k[1:]
    before = np.concatenate((np.zeros(1, np.uint8), prev[:-1]))
    quote = data == ord("'")
    after_quote = np.concatenate((np.zeros(1, bool), quote[:-1]))
    at = (k == SPACE) & (prev > BREAK) & (nxt > BREAK)
    at |= (prev == LETTER) & (k == MARK) & ~quote
    at |= (k == LETTER) & ((prev == MARK) & ~after_quote | (prev == BREAK) & (before > BREAK))
    at[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(at)


def word_marks(model) -> tuple[np.ndarray, bool]:
    """Which ids end a word (True) or, in models that mark no ends, begin with a space (False), as far as the vocabulary says."""
    suffix = getattr(model.model, "end_of_word_suffix", None)
    vocabulary = model.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    out[[i for token, i in vocabulary.items() if (token.endswith(suffix) if suffix else token.startswith("Ġ"))]] = True
    return out, bool(suffix)


class Pieces:
    """Ids of the pieces met so far, found by 64-bit hash; the library makes those of new ones."""

    def __init__(self, model):
        self.model = model
        self.marks, self.mark_ends = word_marks(model)
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.again = np.empty(0, bool)
        self.ids = np.empty(0, np.uint32)
        self.place(0)

    def place(self, n: int) -> None:
        """Give the pieces from the n-th on slots by their keys' upper bits; those whose slot is taken are found by search."""
        if not n:
            self.slots = np.full(1 << SLOTS, -1, np.int32)
            self.crowded, self.crowded_keys = np.empty(0, np.int32), np.empty(0, np.uint64)
        slot = (self.keys[n:] >> np.uint64(64 - SLOTS)).astype(np.int64)
        own = np.arange(n, len(self.keys), dtype=np.int32)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = own[free]
        every = np.concatenate((self.crowded, own[self.slots[slot] != own]))
        self.crowded = every[np.argsort(self.keys[every])]
        self.crowded_keys = self.keys[self.crowded]

    def forget(self, room: int) -> None:
        """Make room: pieces that weren't met again since the last time go, all of them where that isn't enough."""
        keep = np.flatnonzero(self.again)
        if len(keep) + room > MOST_PIECES:
            self.clear()
            return
        count = self.count[keep]
        first = np.cumsum(count) - count
        self.ids = self.ids[np.repeat(self.first[keep] - first, count) + np.arange(count.sum())]
        self.keys, self.first, self.count, self.again = self.keys[keep], first, count, np.zeros(len(keep), bool)
        self.place(0)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.slots[(keys >> np.uint64(64 - SLOTS)).astype(np.int64)].astype(np.int64)
        lost = np.flatnonzero(self.keys[at] != keys)
        if len(lost):  # another key has the slot, or it is new
            at[lost] = -1
            if len(self.crowded):
                i = np.minimum(np.searchsorted(self.crowded_keys, keys[lost]), len(self.crowded) - 1)
                at[lost] = np.where(self.crowded_keys[i] == keys[lost], self.crowded[i], -1)
        return at

    def library(self, texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, end to end, and the number of ids of each."""
        ids: list[list[int]] = []
        for at in range(0, len(texts), most):  # the library's results are many times larger than their ids
            ids += [x.ids for x in self.model.encode_batch_fast(texts[at : at + most], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), count

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for pieces of a space and letters. Each is one pre-token wherever it stands, so the library gets
        RUN_WORDS of them as one text (a text costs it more than a word does), and the marks of its ids tell them apart.
        None if there aren't as many marks as words."""
        ends = np.cumsum(size)
        raw = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()
        stop = [*ends[RUN_WORDS - 1 :: RUN_WORDS].tolist(), len(raw)]
        ids, _ = self.library([raw[a:b].decode() for a, b in zip([0, *stop], stop)], 20_000 // RUN_WORDS)
        marked = np.flatnonzero(self.marks[ids])
        if len(marked) != len(start):
            return None
        return ids, np.diff(marked, prepend=-1) if self.mark_ends else np.diff(marked, append=len(ids))

    def learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Remember the new pieces data[start:stop]."""
        others = np.flatnonzero(KIND[data] != LETTER)
        word = (data[start] == 0x20) & (stop - start > 1) & (np.searchsorted(others, stop) - np.searchsorted(others, start) == 1)
        one = np.flatnonzero(word)
        together = self.words(data, start[one], (stop - start)[one]) if len(one) else None
        rest = np.flatnonzero(~word) if together else np.arange(len(keys))
        raw = data.tobytes()
        ids, count_rest = self.library([raw[a:b].decode() for a, b in zip(start[rest].tolist(), stop[rest].tolist())], 20_000)
        count, first = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        count[rest], first[rest] = count_rest, np.cumsum(count_rest) - count_rest
        if together:
            count[one], first[one] = together[1], len(ids) + np.cumsum(together[1]) - together[1]
            ids = np.concatenate((ids, together[0]))
        n = len(self.keys)
        self.first, self.count = np.concatenate((self.first, len(self.ids) + first)), np.concatenate((self.count, count))
        self.keys, self.again = np.concatenate((self.keys, keys)), np.concatenate((self.again, np.zeros(len(keys), bool)))
        self.ids = np.concatenate((self.ids, ids))
        self.place(n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, end to end, and the number of ids of each."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        start = cuts(data, offsets)
        stop = np.append(start[1:], len(data))
        key = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(stop, start[at] + (1 << 20), "right")))
            a, b = start[at], stop[to - 1]
            c = common.prefix_hash(data[a:b])
            _, down = common.powers(b - a + 1)
            s, e = start[at:to] - a, stop[at:to] - a
            key[at:to] = common.mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        place = self.find(key)
        new = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(new):
            kinds, pick, kind = np.unique(key[new], return_index=True, return_inverse=True)
            if len(self.keys) + len(kinds) > MOST_PIECES:
                self.forget(len(kinds))
                place = self.find(key)
                new = np.flatnonzero(place < 0)
                kinds, pick, kind = np.unique(key[new], return_index=True, return_inverse=True)
            place[new] = len(self.keys) + kind
            self.learn(kinds, data, start[new[pick]], stop[new[pick]])
        count = self.count[place]
        before = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.first[place] - before[:-1], count)
        at += np.arange(len(at))
        first = before[np.searchsorted(start, offsets)]  # every text starts a piece
        return self.ids[at], np.diff(first)


_PIECES: dict[str, Pieces] = common.held({})


def encode(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every whole text (null: empty) with end_id after each, as one array, and the bounds of the texts.

    All ids are the tokenizers library's: of pieces, remembered, for plain texts; of the whole text for others."""
    model = tokenizer(path)
    if path not in _PIECES:
        _PIECES[path] = Pieces(model)
    data, offsets = common.text_buffers(column)
    n = len(offsets) - 1
    plain = plain_rows(data, offsets)
    if plain.all():
        ids, count = _PIECES[path].encode(data, offsets)
        odd: list[np.ndarray] = []
    else:
        sizes = np.diff(offsets)
        keep = np.repeat(plain, sizes)
        ids, count = _PIECES[path].encode(data[keep], np.concatenate(([0], np.cumsum(sizes * plain))))
        texts = column.to_pylist()
        odd = [np.array(x.ids, np.uint32) for x in model.encode_batch_fast([texts[i] for i in np.flatnonzero(~plain)], add_special_tokens=False)]
        count[~plain] = [len(x) for x in odd]
    bounds = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.full(int(bounds[-1]), end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    of = np.repeat(plain, count + 1)
    out[inside & of] = ids
    if odd:
        out[inside & ~of] = np.concatenate(odd)
    return out, bounds
