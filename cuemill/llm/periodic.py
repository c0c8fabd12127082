"""Runs of repeated words: online square catching by dyadic blocks.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, 2 q) words that no neighbouring word
extends keeping period q. Whatever its period p, the words that equal the word p places later form a stretch of at least
max(LEAST - p, p) words, and a stretch of 2 L - 1 words holds a whole block that starts at a multiple of L. So each
completed block of a power of two words is a catcher for the periods of its level: 2 L - 1 to 4 L - 2 (the two smallest
levels share what is below). A word that is appended completes, on every level, one window of L words, which is compared
by hash with the one or two catchers whose periods it can close. A hit is extended to both sides, word hash by word hash in
falling powers of two; if the stretch has p words or more it is a square and joins the runs. A stretch that reaches the
last word stays open and is carried on by the words appended next. Of runs with equal ends the smallest period counts: the
others are its multiples.

Catchers.append takes any number of words, and the runs do not depend on how they are dealt. Tasks append whole blocks of
documents, parted by words that equal no other, so all catchers of a level are compared at once.

n words take O(n log n) steps and some 8 bytes for each word and level; levels end at half the longest document of a block
of documents. Hashes have 64 bits; equal hashes count as equal words. Null and empty texts have no words and no runs; repeated rows give equal results;
very long texts are a block of their own and read whole. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import body, schema_of, with_body
from ._words import Words, blocks, mixed, release, split_words

LEAST = 12
#: Bytes of documents that are appended at once.
BLOCK_BYTES = 1 << 18


def levels(longest: int) -> list[tuple[int, int, int]]:
    """(block, least period, greatest period) until half of longest words. A stretch for period p has max(LEAST - p, p)
    words, so below LEAST / 2 blocks may be longer than p allows alone."""
    found = [(4, 1, 5), (2, 6, 6)]
    block = 4
    while 2 * block - 1 <= longest // 2:
        found.append((block, 2 * block - 1, min(4 * block - 2, longest // 2)))
        block *= 2
    return [(b, lo, min(hi, longest // 2)) for b, lo, hi in found if lo <= longest // 2]


class Catchers:
    """The runs of the words appended so far; longest: of no more words than this can a run consist."""

    def __init__(self, longest: int):
        self.levels = levels(longest)
        top = max((b for b, _, _ in self.levels), default=1)
        self.windows = {1 << k: np.zeros(0, np.uint64) for k in range(top.bit_length())}  # hashes by first word
        self.ends: dict[tuple[int, int], int] = {}  # (first word, period) -> end of the stretch, of squares
        self.open = np.zeros((0, 3), np.int64)  # first word, period, end of stretches that reach the last word

    def append(self, hashes: np.ndarray) -> None:
        before = len(self.windows[1])
        self._lengthen(hashes)
        caught = [self._hits(*level, before) for level in self.levels]
        stretches = np.concatenate([self.open, *caught]) if caught else self.open
        self._merge(self._extended(stretches))

    def runs(self) -> np.ndarray:
        """(start, length, period), by start, then period."""
        if not self.ends:
            return np.zeros((0, 3), np.int64)
        rows = np.array([(start, end + period, period) for (start, period), end in self.ends.items()])
        rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, 2 * rows[:, 2])]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[first]
        rows[:, 1] -= rows[:, 0]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]

    def _lengthen(self, hashes: np.ndarray) -> None:
        """Hashes of the windows that the words complete, each from two of half the length."""
        self.windows[1] = np.concatenate([self.windows[1], hashes])
        for size in list(self.windows)[1:]:
            half, own = self.windows[size // 2], self.windows[size]
            since, until = len(own), max(len(half) - size // 2, 0)
            new = mixed(half[since:until] * np.uint64(0x9E3779B97F4A7C15) + half[since + size // 2 : until + size // 2])
            self.windows[size] = np.concatenate([own, new]) if since else new

    def _hits(self, block: int, low: int, high: int, before: int) -> np.ndarray:
        """Stretches (first word, period, end) of whole blocks that come again, in the windows completed since before."""
        window = self.windows[block]
        done = max(before - block + 1, 0)  # windows that were complete before
        found = []
        for least in range(low, high + 1, block):  # window at m * block + least + r belongs to the catcher at m * block
            width = min(block, high - least + 1)
            first = max((done - least - block + 1) // block, 0)
            count = (len(window) - least - first * block) // block
            at = first * block + least
            pairs = [(first, window[at : at + max(count, 0) * block].reshape(-1, block)[:, :width] == window[first * block : (first + max(count, 0)) * block : block, None])] if count > 0 else []
            rest = window[at + max(count, 0) * block :][:width]
            if len(rest) and count >= 0:
                pairs.append((first + count, (rest == window[(first + count) * block])[None, :]))
            for start, equal in pairs:
                m, r = np.nonzero(equal)
                if len(m):
                    found.append(np.stack([r + least, m + start], axis=1))
        if not found:
            return np.zeros((0, 3), np.int64)
        hits = np.concatenate(found)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        # Neighbouring catchers that have caught the same period are one stretch.
        breaks = np.flatnonzero((np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) > 1)) + 1
        begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(hits)]]) - 1
        return np.stack([hits[begin, 1] * block, hits[begin, 0], hits[end, 1] * block + block], axis=1)

    def _extended(self, stretches: np.ndarray) -> np.ndarray:
        """The stretches with all words before and after them that equal the one a period later."""
        start, period, end = stretches.T.copy()
        sizes = list(self.windows)[::-1]
        for size in sizes:
            window = self.windows[size]
            live = np.arange(len(end))
            while len(live):  # more than once only for the largest size, or where a stretch goes on from an earlier append
                e, p = end[live], period[live]
                live = live[e + p + size <= len(self.windows[1])]
                e, p = end[live], period[live]
                live = live[window[e] == window[e + p]]
                end[live] += size
            live = np.arange(len(start))
            while len(live):
                live = live[start[live] >= size]
                s, p = start[live] - size, period[live]
                live = live[window[s] == window[s + p]]
                start[live] -= size
        return np.stack([start, period, end], axis=1)

    def _merge(self, stretches: np.ndarray) -> None:
        stretches = np.unique(stretches, axis=0) if len(stretches) > 1 else stretches
        start, period, end = stretches.T
        self.open = stretches[end + period == len(self.windows[1])]
        for s, p, e in stretches[(end - start >= period)].tolist():
            if self.ends.get((s, p), 0) < e:
                self.ends[s, p] = e


def parted(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's words with a word of its own after each text, and where each text begins among them."""
    n = len(words.first) - 1
    begins = words.first + np.arange(n + 1)
    out = np.empty(len(words.hash) + n, np.uint64)
    out[begins[1:] - 1] = mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 63))
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = words.hash
    return out, begins


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start among the text's words, length, period) of all runs of a block, and where each text's begin."""
    longest = int(np.diff(words.first).max(initial=0))
    if longest < LEAST:
        return np.zeros((0, 3), np.int64), np.zeros(len(words.first), int)
    hashes, begins = parted(words)
    catchers = Catchers(longest)
    catchers.append(hashes)
    runs = catchers.runs()
    at = np.searchsorted(runs[:, 0], begins)
    runs[:, 0] -= np.repeat(begins[:-1], np.diff(at))
    return runs, at


def kept(runs: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words of a block stay: those that no run contains after its first period."""
    begin = runs[:, 0] + np.repeat(first[:-1], np.diff(at))
    change = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(change, begin + runs[:, 2], 1)
    np.add.at(change, begin + runs[:, 1], -1)
    return np.cumsum(change)[:-1] == 0


def _collapsed(words: Words, stay: np.ndarray) -> pa.Array:
    """The words that stay of each text, joined by one space."""
    length = np.where(stay, words.end - words.start + 1, 0)
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    if len(out):
        where = np.flatnonzero(stay)
        size = words.end[where] - words.start[where]
        to = np.repeat(ends[where] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        source = np.repeat(words.start[where] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out[to] = words.data[source]
    begins = ends[words.first]
    return pa.array([out[a : max(a, b - 1)].tobytes() for a, b in zip(begins[:-1], begins[1:])], pa.binary()).cast(pa.string())


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep with n_words, runs (start, length, period; by start, then period) and collapsed, the text
    without the words that only repeat a run's first period. Map-only."""
    keep = keep or []
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def of(texts: pa.Array) -> list[pa.Array]:
        words = split_words(texts)
        runs, at = runs_of(words)
        items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(entry))
        return [pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), items, type=pa.list_(entry)), _collapsed(words, kept(runs, at, words.first))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = body(b, place)
            for lo, hi in blocks(texts, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*[b[c].slice(lo, hi - lo) for c in keep], *of(texts.slice(lo, hi - lo))], [*keep, "n_words", "runs", "collapsed"])
        release()

    rows, place = with_body(docs, keep, text)
    return rows.mapInArrow(run, schema_of(docs, keep, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))
