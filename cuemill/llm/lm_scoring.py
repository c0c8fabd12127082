"""Language-model scoring by cross-entropy difference.

Two n-gram models, of a target and of a background corpus, share one vocabulary: the words seen at least
MIN_COUNT times in both corpora together; all others are one unknown word in both. A word's probability mixes its bigram,
its unigram and a uniform share. A document's score is the mean over its tokens of the loss under the target model less
the loss under the background model, in bits: negative for text like the target.

Counts are exact, keyed by 64-bit hashes of words and bigrams, so the models grow with the corpora. Rows are written in
compressed blocks of BLOCK_BYTES of text; each block sends its distinct n-grams with their counts to ranges of the hashes, a range
adds them up and answers every block with the sums of its own n-grams, in their order, and a block's texts are scored
from the answers. The number of ranges grows with the text, so that no task holds more than a block or a range. A frequent
word comes from every block; beyond WIDE blocks they are dealt into as many cells as the root of their number, and a range
adds up the sums of cells, which answer their blocks. A token is a maximal run of
bytes other than white space, with A-Z lower-cased; a document starts with an edge mark.

All rows of the target and of the background are counted, none is drawn or left out. The two are matched by scale: every
count enters as a share of its own corpus's counts, so a factor that brings the background to the target's size cancels.
A larger background still knows more different bigrams.

Null, empty and wordless texts have no tokens and score 0. Texts of any length are scored whole; repeated rows
score alike; other columns are untouched. Without a target or background, the models are uniform and scores 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._spark import cut
from ._words import blocks, mixed, release, split_words

#: Bytes of text in a block of rows, and for each range of hashes. A longer text is a block of its own.
BLOCK_BYTES = 8 << 20
LEAST_RANGES = 64
#: Blocks from which a range's sums are made in two levels.
WIDE = 2048
MIN_COUNT = 3
#: Shares of bigram, unigram and uniform probability.
MIX = (0.5, 0.45, 0.05)

_UNKNOWN = np.uint64(0x2545F4914F6CDD1D)
_EDGE = np.uint64(0x8CB92BA72F3D8DD7)
_ASKED = "block long, range int, hashes binary, counts binary"
_ANSWERED = "block long, pairs boolean, range int, counts binary"


def _planes(a: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, so that small ones compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _hashes(b: bytes) -> np.ndarray:
    return np.cumsum(_numbers(b), dtype=np.uint64)


def _counts(b: bytes) -> np.ndarray:
    """(n-grams, sides)"""
    return _numbers(b).astype(np.int64).reshape(2, -1).T


def _before(h: np.ndarray, first: np.ndarray, edge) -> np.ndarray:
    """For each token, the value of the token before it in its text, or edge."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = edge
    return before


def _pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(_before(h, first, _EDGE) * np.uint64(0x9E3779B97F4A7C15) + h)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of all texts (ascending), the place of each token's word among them, and where each text's
    tokens begin."""
    hashes, first, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for lo, hi in blocks(texts):
        w = split_words(texts.slice(lo, hi - lo), lower=True)
        hashes.append(w.hash)
        first.append(w.first[1:] + base)
        base += len(w.hash)
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return found, at, np.concatenate(first)


def _per_side(at: np.ndarray, size: int, side: np.ndarray) -> np.ndarray:
    """(n-grams, sides): counts of the places at, by the side of their text."""
    return np.stack([np.bincount(at[side == s], minlength=size) for s in (0, 1)], axis=1)


def _asked(h: np.ndarray, n: np.ndarray, block: int, ranges: int) -> list[tuple]:
    """A row for each range of the hashes h (ascending) with counts n; ranges follow the order of the hashes."""
    at = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
    cut = [(r, slice(at[r], at[r + 1])) for r in np.flatnonzero(np.diff(at)).tolist()]
    return [(block, r, _planes(np.diff(h[x], prepend=np.uint64(0))), _planes(n[x].T)) for r, x in cut]


def _rows(found: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [c.split() for c in ddl.split(", ")]
    return pa.table([pa.array([r[i] for r in found], kinds[k]) for i, (_, k) in enumerate(columns)], [n for n, _ in columns])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """A row per block: its rows as a compressed Arrow stream, and the bytes of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(parts).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([held]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"])

        for b in batches:
            for lo, hi in blocks(b["_text"], BLOCK_BYTES >> 4):
                size = pc.sum(pc.binary_length(b["_text"].slice(lo, hi - lo))).as_py() or 0
                if held and held + size > BLOCK_BYTES:
                    yield out()
                    block, held, parts = block + 1, 0, []
                held += size
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield out()
        release()

    return rows.mapInArrow(run, "block long, size long, rows binary")


def _opened(rows: pa.Table) -> pa.Table:
    """The rows of one block."""
    return pa.ipc.open_stream(rows["rows"][0].as_buffer()).read_all()


def _sides(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def _word_counts(rows: DataFrame, ranges: int, count: int) -> DataFrame:
    """The sums of each block's words; range ranges has those of the edge. Rows of block -1 hold sums over a range, in
    counts: (known words, edges), tokens and unknown tokens, of both sides."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(b["block"].to_pylist()):
                rows = _opened(b.slice(i, 1))
                side, (h, at, first) = _sides(rows["_side"].combine_chunks()), _tokens(_texts(rows))
                n = _per_side(at, len(h), np.repeat(side, np.diff(first)))
                edges = np.array([np.count_nonzero((side == s) & (np.diff(first) > 0)) for s in (0, 1)])
                yield from _rows([*_asked(h, n, block, ranges), (block, ranges, _planes(np.array([_EDGE])), _planes(edges))], _ASKED).to_batches()
        release()

    def known(n: np.ndarray, r: int) -> np.ndarray:
        if r == ranges:
            return np.concatenate([[0], n[0], np.zeros(4)])
        inside = n.sum(axis=1) >= MIN_COUNT
        return np.concatenate([[inside.sum(), 0, 0], n.sum(axis=0), n[~inside].sum(axis=0)])

    return rows.select("block", "rows").mapInArrow(ask, _ASKED).transform(_summed, count, known)


def _summed(asked: DataFrame, count: int, more=None) -> DataFrame:
    """The answers to count blocks; more(sums, range) goes to block -1. In two levels, cells stand for their blocks when a
    range adds up, so neither a range nor a cell has more rows than the root of the number of blocks."""
    if count <= WIDE:
        return asked.groupBy("range").applyInArrow(lambda t: _answers(t, more), _ANSWERED)
    celled = cut(asked.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(math.isqrt(count) + 1)).cast("long")), "lm-cells")
    cells = celled.groupBy("range", "cell").applyInArrow(_cell, _ASKED)
    totals = cut(cells.groupBy("range").applyInArrow(lambda t: _answers(t, more), _ANSWERED), "lm-totals")
    own = totals.where("block >= 0").withColumnRenamed("block", "cell").groupBy("range", "cell")
    return celled.groupBy("range", "cell").cogroup(own).applyInArrow(_spread, _ANSWERED).unionByName(totals.where("block = -1"))


def _added(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of some rows (ascending), their sums, the place of each row's n-grams among them, and where
    each row's begin."""
    h = [_hashes(x) for x in asked["hashes"].to_pylist()]
    n = np.concatenate([_counts(x) for x in asked["counts"].to_pylist()])
    found, back = np.unique(np.concatenate(h), return_inverse=True)
    sums = np.stack([np.bincount(back, n[:, s], len(found)) for s in (0, 1)], axis=1).astype(np.int64)
    return found, sums, back, np.cumsum([0, *map(len, h)])


def _cell(asked: pa.Table) -> pa.Table:
    """One row for the blocks of a cell, which stands as their block."""
    found, sums, _, _ = _added(asked)
    return _rows([(asked["cell"][0].as_py(), asked["range"][0].as_py(), _planes(np.diff(found, prepend=np.uint64(0))), _planes(sums.T))], _ASKED)


def _spread(asked: pa.Table, totals: pa.Table) -> pa.Table:
    """The answer to a cell, for each of its blocks."""
    _, _, back, at = _added(asked)
    r, pairs, sums = totals["range"][0].as_py(), totals["pairs"][0].as_py(), _counts(totals["counts"][0].as_py())
    out = _rows([(block, pairs, r, _planes(sums[back[at[i] : at[i + 1]]].T)) for i, block in enumerate(asked["block"].to_pylist())], _ANSWERED)
    release()
    return out


def _answers(asked: pa.Table, more=None) -> pa.Table:
    """The sums of a range's n-grams for each block that sent them; more(sums, range) goes to block -1."""
    names, r = asked["block"].to_pylist(), asked["range"][0].as_py()
    _, sums, back, at = _added(asked)
    out = [(block, not more, r, _planes(sums[back[at[i] : at[i + 1]]].T)) for i, block in enumerate(names)]
    if more:
        out.append((-1, False, r, _planes(more(sums, r).astype(np.int64))))
    out = _rows(out, _ANSWERED)
    release()
    return out


def _sums(answers: pa.Table, pairs: bool, size: int) -> np.ndarray:
    """(n-grams, sides): the answers to a block in the order of its n-grams."""
    rows = sorted((r, c) for p, r, c in zip(answers["pairs"].to_pylist(), answers["range"].to_pylist(), answers["counts"].to_pylist()) if p == pairs)
    n = np.concatenate([np.zeros((0, 2), np.int64), *[_counts(c) for _, c in rows]])
    if len(n) != size:
        raise ValueError(f"{len(n)} sums for {size} n-grams")
    return n


def _texts(rows: pa.Table) -> pa.Array:
    return pa.chunked_array(rows["_text"].chunks, rows["_text"].type).cast(pa.large_string()).combine_chunks()


def side_of(target: Column, background: Column) -> Column:
    """0: target, 1: background, null: neither."""
    return F.when(F.coalesce(target, F.lit(False)), 0).when(F.coalesce(background, F.lit(False)), 1).cast("int")


def corpora(docs: DataFrame, text: str, target: Column, background: Column) -> DataFrame:
    """text, side (0: target, 1: background) of all rows of the two corpora."""
    return docs.select(F.col(text).alias("text"), side_of(target, background).alias("side")).where("side is not null and text is not null")


def fit(corpus: DataFrame) -> DataFrame:
    """The model of a corpus (text, side) is its rows: they are counted together with the texts to score."""
    return corpus.select(F.col("text").alias("_text"), F.col("side").cast("int").alias("_side"))


def score(docs: DataFrame, model: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep with n_tokens, target_loss, background_loss (bits a token) and score (their difference)."""
    kept = F.struct(F.lit(0).alias("_no"), *(keep or []))
    own = docs.select(kept.alias("_keep"), F.col(text).alias("_text"), F.lit(None).cast("int").alias("_side"), F.lit(True).alias("_own"))
    rest = model.select(F.lit(None).cast(own.schema["_keep"].dataType).alias("_keep"), "_text", "_side", F.lit(False).alias("_own"))
    return _scored(own.unionByName(rest), keep or [])


def score_members(docs: DataFrame, side: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score() of docs under the model of the same rows, each of which is sent once. side: as side_of() gives it."""
    kept = F.struct(F.lit(0).alias("_no"), *(keep or []))
    return _scored(docs.select(kept.alias("_keep"), F.col(text).alias("_text"), side.alias("_side"), F.lit(True).alias("_own")), keep or [])


def _scored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows: _keep, _text, _side (null: not counted), _own (whether to score)."""
    kept = rows.schema["_keep"]
    rows = cut(_in_blocks(rows), "lm-blocks")
    found = rows.agg(F.sum("size").alias("size"), F.count("*").alias("blocks")).first()
    ranges, count = max(LEAST_RANGES, (found["size"] or 0) // BLOCK_BYTES + 1), found["blocks"]
    words = cut(_word_counts(rows, ranges, count), "lm-words")
    found = words.where("block = -1").select("counts").collect()  # one row a range
    stats = np.sum([np.zeros(7), *[_numbers(r["counts"]).astype(np.float64) for r in found]], axis=0)
    vocabulary, edges, totals, unknown = stats[0] + 1, stats[1:3], np.maximum(stats[3:5], 1), stats[5:7]

    def read(texts: pa.Table, answers: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of a block, the sums of its words, the place of each token among them, where texts begin, bigrams."""
        rows = _opened(texts)
        h, at, first = _tokens(_texts(rows))
        n = _sums(answers, False, len(h))
        inside = n.sum(axis=1) >= MIN_COUNT
        return rows, np.where(inside[:, None], n, unknown), at, first, _pairs(np.where(inside, h, _UNKNOWN)[at], first)

    def ask(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows, _, _, first, pairs = read(texts, answers)
        found, at = np.unique(pairs, return_inverse=True)
        n = _per_side(at, len(found), np.repeat(_sides(rows["_side"].combine_chunks()), np.diff(first)))
        found = _rows(_asked(found, n, key[0].as_py(), ranges), _ASKED)
        release()
        return found

    def lose(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows, words, at, first, pairs = read(texts, answers)
        found, pair = np.unique(pairs, return_inverse=True)
        both, tokens, loss = _sums(answers, True, len(found)), np.diff(first), np.zeros((2, rows.num_rows))
        text_no = np.repeat(np.arange(rows.num_rows), tokens)
        for s in (0, 1):
            uni = words[at, s]
            p = MIX[0] * both[pair, s] / np.maximum(_before(uni, first, edges[s]), 1) + MIX[1] * uni / totals[s] + MIX[2] / vocabulary
            loss[s] = np.bincount(text_no, -np.log2(p), rows.num_rows) / np.maximum(tokens, 1)
        found = pa.table([rows["_keep"], pa.array(tokens), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])], ["_keep", "n_tokens", "target_loss", "background_loss", "score"])
        release()
        return found.filter(rows["_own"])

    asked = words.where((F.col("block") >= 0) & (F.col("range") < ranges))
    texts = rows.select("block", "rows").groupBy("block")
    pairs = texts.cogroup(asked.groupBy("block")).applyInArrow(ask, _ASKED).transform(_summed, count)
    schema = T.StructType([kept, *T.StructType.fromDDL("n_tokens long, target_loss double, background_loss double, score double").fields])
    out = texts.cogroup(asked.unionByName(pairs).groupBy("block")).applyInArrow(lose, schema)
    return out.select(*[F.col("_keep").getField(c).alias(c) for c in keep], "n_tokens", "target_loss", "background_loss", "score")
