"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds the lengths in (capacity / (k + 1), capacity / k], and each
sequence of class k takes exactly k of them, whole, without a look at other classes. What k such lengths leave open is
less than one of them; as documents may be cut, the next document gives its first tokens to close it, so every sequence
is full. A document of n tokens thus closes what is open, gives (rest div capacity) full sequences, and its last, shorter
part goes whole to its class. What a worker holds at its end, sequences that lack documents or a filling, is laid
end to end, into full sequences and then sequences of the binary digits of the rest: powers of two, which need no padding.

Every worker packs the rows of its own partition, so the job is one map stage without a shuffle, and memory holds one
sequence at most for each class (the classes of all lengths up to capacity are 2 sqrt(capacity)) besides the rows at hand.
Sequence ids are the partition number times 2^40 plus a counter. Rows are sorted by key and a hash of the text inside a
partition first, so that a task that runs again packs alike.

A null text is an empty document: its only token is the end token. A null key sorts first and is kept. Repeated rows are
packed as often as they come; one key may carry several texts. Texts of any length are read whole. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._spark import schema_of

CAPACITY = 1024

#: Stretches of so much white space, cut at multiples of it, go to the tokenizers library: tiktoken's pattern runs out of
#: stack at a run of a million.
LONG_RUN = 50_000

_encoder = None


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary file of the tokenizers library. The file's vocabulary is
    handed to tiktoken, whose merges by rank give the same ids in a fraction of the time (tests compare the two). Texts
    with a long run of white space, and any that tiktoken cannot read, go to the tokenizers library itself. With added_tokens,
    so do texts that hold an added token's string, and it gets that token's id; else such strings are ordinary text."""

    def __init__(self, path: str, added_tokens: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        source = self.source = Tokenizer.from_file(path)
        source.encode_special_tokens = not added_tokens
        special = {t.content for t in source.get_added_tokens_decoder().values()}
        # Byte-level vocabularies write byte b as chr(b) where that prints, the others in order from chr(256) on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in source.get_vocab().items() if token not in special}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.added = re.compile("|".join(map(re.escape, special))) if added_tokens and special else None

    def encode(self, text: str) -> bytes:
        if not (self.added and self.added.search(text)) and not any(text[i : i + LONG_RUN].isspace() for i in range(0, len(text) - LONG_RUN + 1, LONG_RUN)):
            try:
                return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # tiktoken cannot read it
                pass
        return np.array(self.source.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Packer:
    """The sequences of a worker. A part is (key, start, ids as bytes, tokens of its document)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.classes: dict[int, list[tuple]] = {}  # parts that wait for the rest of their k
        self.open: list[tuple[list[tuple], int]] = []  # sequences that have their k parts, and what they lack
        self.out: list[tuple] = []

    def put(self, key, ids: bytes) -> None:
        n, start = len(ids) // 4, 0

        def part(size: int) -> tuple:
            nonlocal start
            start += size
            return key, start - size, ids[4 * (start - size) : 4 * start], n

        while self.open and start < n:
            parts, lack = self.open.pop()
            size = min(lack, n - start)
            parts.append(part(size))
            if size < lack:
                self.open.append((parts, lack - size))
            else:
                self._close(parts)
        while n - start >= self.capacity:
            self._close([part(self.capacity)])
        if start < n:
            k = self.capacity // (n - start)
            parts = self.classes.setdefault(k, [])
            parts.append(part(n - start))
            if len(parts) == k:
                del self.classes[k]
                lack = self.capacity - sum(len(p[2]) for p in parts) // 4
                if lack:
                    self.open.append((parts, lack))
                else:
                    self._close(parts)

    def _close(self, parts: list[tuple]) -> None:
        at = 0
        for key, start, ids, n in parts:
            self.out.append((key, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at, ids))
            at += len(ids) // 4
        self.next += 1

    def end(self) -> None:
        rest = [p for parts, _ in self.open for p in parts] + [p for k in sorted(self.classes) for p in self.classes[k]]
        self.open, self.classes = [], {}
        total = sum(len(p[2]) for p in rest) // 4
        sizes = [self.capacity] * (total // self.capacity) + [1 << j for j in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> j & 1]
        rest.reverse()
        for size in sizes:
            parts = []
            while size:
                key, start, ids, n = rest.pop()
                own = ids[: 4 * size]
                if len(ids) > len(own):
                    rest.append((key, start + len(own) // 4, ids[len(own) :], n))
                parts.append((key, start, own, n))
                size -= len(own) // 4
            self._close(parts)

    def batch(self, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out)) or [()] * 8, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds token_ids
    (binary, little-endian unsigned 32-bit). added_tokens: as in Encoder."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).sortWithinPartitions("key", F.xxhash64("text"))
    schema = schema_of(docs, [key], "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", token_ids binary" * with_ids)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["token_ids"] * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        if _encoder is None or _encoder[0] != (tokenizer_path, added_tokens):
            _encoder = ((tokenizer_path, added_tokens), Encoder(tokenizer_path, added_tokens))
        encoder, packer, kinds = _encoder[1], _Packer(capacity, TaskContext.get().partitionId() << 40), None
        for b in batches:
            kinds = kinds or [b.schema.field("key").type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for k, own in zip(part["key"].to_pylist(), part["text"]):
                    packer.put(k, encoder.encode(own.as_py()) + end)
                if packer.out:
                    yield packer.batch(names, kinds)
        packer.end()
        if packer.out:
            yield packer.batch(names, kinds)

    return rows.mapInArrow(run, schema)
