"""Runs (maximal repetitions) of words, found online by catchers over completed power-of-two blocks.

A run of period q, at least 2q words long, holds a whole aligned block of b words in its first q words and the same
words q further on, where b is the power of two with ``2b <= q < 4b``. So each completed block of b words
opens a catcher, which lives while the suffixes of b words that follow start 2b to 4b words after it. Every
appended word completes one suffix per level and meets the two catchers that are open then; equal fingerprints
are a repeat at that distance. Distances below 8 are followed word by word. Repeats of adjacent blocks at one
distance are one chain; its words, and a block on either side, are compared word by word, which gives the
whole stretch, undoes any chance meeting of fingerprints and keeps exactly the squares. A stretch that is a
run of a smaller period already is that run.

Many documents are appended to one stream, a word that occurs nowhere else after each: no square crosses it.
Documents of like length share a stream, so each passes through the levels that its own length needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 8  # distances below this are followed word by word
STREAM = 1 << 18  # words of a stream; a longer document is a stream of its own
LEAST = 12

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _K[0] + (b ^ (b >> np.uint64(31))) * _K[1]
    out ^= out >> np.uint64(29)
    out *= _K[2]
    return out


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each stretch of true values."""
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    if len(on) and on[0]:
        edge = np.concatenate(([0], edge))
    if len(on) and on[-1]:
        edge = np.concatenate((edge, [len(on)]))
    return edge[::2], edge[1::2]


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(0, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.zeros(max(2 * self.n, self.n + len(more)), self.held.dtype)
            wider[:self.n] = self.held[:self.n]
            self.held = wider
        self.held[self.n:self.n + len(more)] = more
        self.n += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.held[:self.n]


class Catchers:
    """Words in, runs out. Words are numbers; ``append`` may be called any number of times.

    ``longest`` bounds the length of a run (the longest document of a stream), None: no bound.
    """

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.words = _Grown(np.int64)
        self.prints: list[_Grown] = [_Grown(np.uint64)]  # of the b words from each place, b = 1, 2, 4, ...
        self.repeats: list[list[tuple[np.ndarray, np.ndarray]]] = [[]]  # (block, distance) by level
        self.met: list[int] = [0]  # suffixes that have met their catchers, by level
        self.streaks = [_Grown(bool) for _ in range(NEAR)]  # [q][i]: word i equals word i + q

    def append(self, words: np.ndarray) -> None:
        self.words.add(np.asarray(words, np.int64))
        w, n = self.words.values, self.words.n
        for q in range(1, NEAR):
            s = self.streaks[q]
            if n - q > s.n:
                s.add(w[s.n:n - q] == w[s.n + q:n])
        seen = self.prints[0].n
        self.prints[0].add(_mix(w[seen:].astype(np.uint64), _K[:1]))
        level, block = 0, 1
        while 4 * block <= min(n, self.longest or n):
            if level:
                self._extend(level, block)
            if 2 * block >= NEAR:
                self._catch(level, block)
            level, block = level + 1, 2 * block
            if len(self.prints) == level:
                self.prints.append(_Grown(np.uint64))
                self.repeats.append([])
                self.met.append(0)

    def _extend(self, level: int, block: int) -> None:
        below, mine = self.prints[level - 1], self.prints[level]
        half, end = block // 2, self.words.n - block + 1
        if end > mine.n:
            mine.add(_mix(below.values[mine.n:end], below.values[mine.n + half:end + half]))

    def _catch(self, level: int, block: int) -> None:
        """Every suffix that is complete now and was not before meets its two open catchers."""
        prints = self.prints[level].values
        at = np.arange(max(self.met[level], 2 * block), len(prints))
        self.met[level] = len(prints)
        first = (at - 2 * block) // block * block
        for catcher, suffix in ((first, at), (first[first >= block] - block, at[first >= block])):
            hit = prints[catcher] == prints[suffix]
            if hit.any():
                self.repeats[level].append((catcher[hit], (suffix - catcher)[hit]))

    def runs(self, least: int = LEAST) -> np.ndarray:
        """(start, end, period) of all runs of at least ``max(least, 2 * period)`` words so far, by start, then period."""
        found = np.zeros((0, 3), np.int64)
        for q in range(1, NEAR):
            first, end = _stretches(self.streaks[q].values)
            found = self._merged(found, first, end, q, least)
        for level, repeats in enumerate(self.repeats):
            if repeats:
                block = 1 << level
                found = self._level(found, block, *(np.concatenate(c) for c in zip(*repeats)), least)
        return found[np.lexsort((found[:, 2], found[:, 0]))]

    @staticmethod
    def _merged(found: np.ndarray, first: np.ndarray, end: np.ndarray, q: int | np.ndarray, least: int) -> np.ndarray:
        """``found`` and the stretches that are long enough and no run of a smaller period."""
        new = np.stack([first, end + q, np.broadcast_to(q, first.shape)], axis=1)
        length = new[:, 1] - new[:, 0]
        new = new[length >= np.maximum(least, 2 * new[:, 2])]
        if not len(new):
            return found
        both = np.concatenate([found, new])
        order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))
        both = both[order]
        keep = np.ones(len(both), bool)
        keep[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
        return both[keep]

    def _level(self, found: np.ndarray, block: int, at: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
        if len(found):
            # Inside a run whose period divides the distance there is nothing but that run.
            order = np.argsort(found[:, 0], kind="stable")
            starts, ends, period = found[order].T
            reach = np.maximum.accumulate(ends)
            who = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))
            last = np.searchsorted(starts, at, side="right") - 1
            inside = (last >= 0) & (reach[last] >= at + q + block) & (q % period[who[last]] == 0)
            at, q = at[~inside], q[~inside]
        if not len(at):
            return found
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        new = np.ones(len(at), bool)
        new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + block)
        head = np.flatnonzero(new)
        low, high, q = at[head] - block, at[np.append(head[1:], len(at)) - 1] + 2 * block, q[head]
        w, n = self.words.values, self.words.n
        low, high = np.maximum(low, 0), np.minimum(high, n - q)
        size = high - low
        cuts = np.searchsorted(np.cumsum(size), np.arange(1 << 22, int(size.sum()) + (1 << 22), 1 << 22))
        begin = 0
        for stop in np.unique(np.append(cuts + 1, len(size))):  # some four million words compared at once
            part = slice(begin, min(int(stop), len(size)))
            begin = part.stop
            lengths = size[part]
            if not len(lengths):
                continue
            edge = np.cumsum(lengths) - lengths
            chain = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(chain)) - edge[chain] + low[part][chain]
            # One false value after each chain keeps their stretches apart.
            on = np.zeros(len(chain) + len(lengths), bool)
            on[np.arange(len(chain)) + chain] = w[place] == w[place + q[part][chain]]
            first, end = _stretches(on)
            mine = np.searchsorted(edge + np.arange(len(edge)), first, side="right") - 1
            shift = low[part][mine] - (edge + np.arange(len(edge)))[mine]
            found = self._merged(found, first + shift, end + shift, q[part][mine], least)
        return found


def streams(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents by length class, cut to streams of about ``STREAM`` words."""
    kind = np.frexp(np.maximum(sizes, 1))[1]
    for k in np.unique(kind):
        rows = np.flatnonzero((kind == k) & (sizes > 0))
        piece = (np.cumsum(sizes[rows] + 1) - 1) // STREAM
        for p in np.unique(piece):
            yield rows[piece == p]


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """(start, end, period) rows of each document, given as arrays of word numbers (0 and up)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for rows in streams(sizes):
        lengths = sizes[rows]
        begin = np.cumsum(lengths + 1) - lengths - 1
        words = np.empty(int((lengths + 1).sum()), np.int64)
        words[begin + lengths] = -1 - np.arange(len(rows))
        inner = np.ones(len(words), bool)
        inner[begin + lengths] = False
        words[inner] = np.concatenate([texts[r] for r in rows])
        catchers = Catchers(int(lengths.max()))
        catchers.append(words)
        found = catchers.runs(least)
        owner = np.searchsorted(begin, found[:, 0], side="right") - 1
        found[:, :2] -= begin[owner][:, None]
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            out[rows[k]] = found[cut[k]:cut[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by a space, without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(id, n_words, runs: array<struct<start, length, period>>, collapsed: binary): one row per row of ``docs``.

    Words are what ASCII white space parts, numbered from 0; runs come by start, then period. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``. Null ids and repeated rows are kept, other columns
    are not read, an empty table gives none. A text is held whole by one task, however long; its streams take some
    hundred bytes a word. ``rewrite`` may change the words of a document before they are looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("id").to_pylist()
        words = [(t or b"").split() for t in batch.column("text").to_pylist()]
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words)]
        number = _Numbers().__getitem__
        found = runs_of([np.fromiter(map(number, w), np.int64, len(w)) for w in words], least)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(kind))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), entries),
             pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("text").nbytes // max(batch.num_rows, 1) + 1
            step = max(1, (8 << 20) // size)
            for at in range(0, batch.num_rows, step):
                yield piece(batch.slice(at, step))

    return rows.mapInArrow(work, "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
