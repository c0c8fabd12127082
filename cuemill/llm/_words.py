"""Words and their hashes for blocks of texts, over the bytes of Arrow string arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All operators of this subpackage that run numpy inside
tasks start from here.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text in one block. A longer text is a block of its own.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_PLACE = mixed(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 4096)
        p = np.empty(size, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p[1:] = np.uint64(_BASE)
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


@dataclass
class Words:
    """The words of a block: bytes data[start[i]:end[i]] with hash[i]; text t has the words first[t] to first[t + 1];
    its bytes are data[offsets[t]:offsets[t + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64))
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    begins = before & ~space
    start, end = np.flatnonzero(begins), np.flatnonzero(after & ~space) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, offsets, start, end, first, np.zeros(0, np.uint64))
    length = end - start
    powers = _powers(int(length.max()) + 1)
    place = np.arange(start[0], n) - np.repeat(start, np.diff(np.append(start, n)))
    values = _BYTE[data[start[0] :]] * powers[np.minimum(place, len(powers) - 1)]
    values[space[start[0] :]] = 0
    hashes = np.add.reduceat(values, start - start[0])
    return Words(data, offsets, start, end, first, mixed(hashes + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def release() -> None:
    """Gives freed memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes together, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, s in enumerate(sizes):
        if total + s > most and i > at:
            yield at, i
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside texts, in order, and where each text's begin (one more than texts). A text
    of fewer words has its whole sequence as one; without words, none."""
    n = np.diff(words.first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(at[-1]), np.uint64)
    h, total = words.hash, len(words.hash)
    if total >= k:
        runs = h[: total - k + 1] * _PLACE[0]
        for j in range(1, k):
            runs += h[j : total - k + 1 + j] * _PLACE[j]
        inside = np.repeat(n >= k, counts)
        place = np.arange(int(at[-1])) - np.repeat(at[:-1] - words.first[:-1], counts)
        out[inside] = mixed(runs[place[inside]])
    for t in np.flatnonzero((n > 0) & (n < k)):
        own = h[words.first[t] : words.first[t + 1]]
        out[at[t]] = mixed((own * _PLACE[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, at
