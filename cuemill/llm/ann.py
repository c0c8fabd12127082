"""Nearest neighbours by inner product: multi-index hashing over learned binary codes, reranked on the vectors.

Vectors are scaled by the largest norm and given one more component, so that all lie on a sphere and the largest inner
product is the smallest angle; a query has 0 there. Rotations learned from a bounded sample (iterative quantization)
turn them into codes of CODE_BITS signs, split into m substrings of 8 bits, each with an index of its own: a bucket for
each value, held as a bitmap of its rows. A code within Hamming radius m (s + 1) - 1 of a query has one of its m
substrings within s of the query's (pigeonhole), so the buckets of all values within s of each substring hold every code
in that radius. s grows until the radius holds RERANK codes; only codes from probed buckets are compared. All of them no
farther than the RERANK-th, ties included, are reranked by exact inner products in double precision.

Rows are dealt evenly into blocks, each indexed by itself, and the queries visit all blocks in chunks, so tasks hold
bounded data; each gives k rows for a query, which a window merges. Every row is indexed; only the rotations come from a
sample of SAMPLE rows at most. Work grows with queries times blocks: where neighbours are far (as among vectors without
structure) no index can leave most buckets out, where they are near few buckets are probed.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. A query meets
vectors of its own length only; each length has codes of its own. Ties in score go to the smaller id. Repeated rows are
candidates each; a query id asks once, with the first of its vectors in the order of their components. A query meets no
row of its own id. Fewer than k candidates: all of them. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits of a code; codes that are reranked for each query and block at least.
CODE_BITS, RERANK = 256, 384
#: Rows of a block and queries of a chunk, about.
BLOCK, CHUNK = 16384, 8192
#: Vectors that the rotations are learned from, at most about.
SAMPLE = 10_000
ROUNDS = 15
#: Queries that probe at a time.
STEP = 32


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations(sample: np.ndarray, bits: int = CODE_BITS, seed: int = 0) -> np.ndarray:
    """(d, bits): columns of orthogonal matrices, each turned until the signs of the sample lie close to it."""
    d, draw, out = sample.shape[1], np.random.default_rng(seed), []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(draw.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(sample) >= d else 0):
            u, _, vt = np.linalg.svd(sample.T @ np.sign(sample @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def codes(lifted: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.packbits(lifted @ turn > 0, axis=1)


class MultiIndex:
    """Codes of a block. buckets[j, v] is the bitmap of the rows whose substring j has the value v."""

    def __init__(self, rows: np.ndarray):
        self.size, self.m = rows.shape
        self.words = np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint64).T)
        self.buckets = np.zeros((self.m, 256, -(-self.size // 64)), np.uint64)
        at = np.arange(self.size)
        for j in range(self.m):
            np.bitwise_or.at(self.buckets[j], (rows[:, j], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def radii(self) -> Iterator[tuple[int, np.ndarray]]:
        """s, and for each substring and value the bitmap of all buckets within s of it; one more bit at a time."""
        reach, values = self.buckets, np.arange(256)
        for s in range(9):
            yield s, reach
            wider = reach.copy()
            for bit in range(8):
                wider |= reach[:, values ^ (1 << bit)]
            reach = wider

    def far(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """In how many bits the codes of rows differ from a query's."""
        return sum(np.bitwise_count(column[rows] ^ word).astype(np.uint16) for column, word in zip(self.words, query))

    def within(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """For each query: all rows no farther than its least-th nearest code."""
        wide = np.ascontiguousarray(queries).view(np.uint64)
        out: list[np.ndarray | None] = [None] * len(queries)
        if self.size <= least:
            return [np.arange(self.size)] * len(queries)
        seen = np.zeros((len(queries), self.buckets.shape[2]), np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint16))] * len(queries)  # rows of probed buckets, how far they are
        pending = np.arange(len(queries))
        for s, reach in self.radii():
            later = []
            for lo in range(0, len(pending), STEP):
                own = pending[lo : lo + STEP]
                probed = reach[0][queries[own, 0]]
                for j in range(1, self.m):
                    probed |= reach[j][queries[own, j]]
                fresh = np.unpackbits((probed & ~seen[own]).view(np.uint8), axis=1, bitorder="little")
                seen[own] = probed
                for i, q in enumerate(own):
                    new = np.flatnonzero(fresh[i])
                    rows, far = np.concatenate([found[q][0], new]), np.concatenate([found[q][1], self.far(new, wide[q])])
                    if len(far) > least:  # what is beyond the least-th so far is beyond it in the end
                        near = far <= np.partition(far, least - 1)[least - 1]
                        rows, far = rows[near], far[near]
                    if np.count_nonzero(far < self.m * (s + 1)) >= least:
                        out[q], found[q] = np.sort(rows), None
                    else:
                        found[q] = rows, far
                        later.append(q)
            pending = np.array(later, int)
            if not len(pending):
                return out
        raise AssertionError("a radius of all bits holds all rows")


def _nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, turn: np.ndarray, largest: float, k: int) -> pa.Table:
    """The k nearest rows of a block for each query, by the index and the exact measure."""
    found = []
    if len(ids) and len(q_ids):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        index = MultiIndex(codes(_lift(x, largest), turn))
        q_codes = codes(np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1), turn)
        for lo in range(0, len(q), 1024):
            for i, near in enumerate(index.within(q_codes[lo : lo + 1024], RERANK), lo):
                near = near[ids[near] != q_ids[i]]
                scores = (x[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -scores))[:k]
                found.append((np.full(len(best), q_ids[i]), ids[near][best], scores[best]))
    join = lambda i, kind: pa.array(np.concatenate([f[i] for f in found]) if found else [], kind)
    return pa.table({"query_id": join(0, pa.int64()), "vec_id": join(1, pa.int64()), "score": join(2, pa.float64())})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which queries holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.size(vector).alias("d"), F.coalesce(queries, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(norm).alias("largest")).collect()  # one row a length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = F.xxhash64("id", "x").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    drawn = rows.where(part < min(1.0, SAMPLE / sum(r["n"] for r in sizes))).select("d", "x").toArrow()
    model = {}
    for r in sizes:
        x = np.array(drawn.filter(pa.array(drawn["d"].to_numpy() == r["d"]))["x"].to_pylist(), float).reshape(-1, r["d"])
        model[r["d"]] = rotations(_lift(x[np.lexsort(x.T)], r["largest"])), r["largest"]
    held = spark.sparkContext.broadcast(model)
    per = {r["d"]: (-(-r["n"] // BLOCK), max(1, -(-r["q"] // CHUNK))) for r in sizes}
    number = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, n in per.items() for x in (d, n[i])]), F.col("d"))
    several = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # Rows are dealt by their place in the table, so that one id with many rows is not one block.
    data = rows.select("d", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number(0)).cast("int").alias("block"), several(number(1)).alias("chunk"), "id", "x")
    asked = rows.where("asks").groupBy("id").agg(F.min("x").alias("x")).withColumn("d", F.size("x"))
    asked = asked.select("d", several(number(0)).alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), number(1)).cast("int").alias("chunk"), "id", "x")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        turn, largest = held.value[key[0].as_py()]
        matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        if not left.num_rows or not right.num_rows:
            left, right = left.slice(0, 0), right.slice(0, 0)
        return _nearest(left["id"].to_numpy(), matrix(left), right["id"].to_numpy(), matrix(right), turn, largest, k)

    place = ["d", "block", "chunk"]
    found = data.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
