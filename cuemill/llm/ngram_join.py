"""N-gram Jaccard self-join with prefix trees, and the classes that its links make.

A document's set holds the distinct runs of k words, after A-Z is lower-cased; with fewer words, the whole sequence is
its only member. Two documents link when their sets' Jaccard similarity reaches num / den; classes are the connected
components of the links.

1. Counts. Every task counts the n-grams of its sets (each different set once a task) in 2^32 counters, sent as two
   bytes an n-gram. The most frequent n-grams, at most HEAVY of them (8 bytes each), are broadcast. They define the
   global order: rare n-grams first by hash, then the frequent ones by rising count. Any order gives right results.
2. Prefixes. Linked sets share an n-gram among the first n - ceil(t n) + 1 of either, in the global order. Pairs that
   share too few of them to reach the threshold go, and pairs whose parity bitmaps differ too much; the connected
   components of the others, among sets of neighbouring sizes, are the candidate groups. No link is left out: the bounds
   are exact, and some group holds both sets of every link.
3. Tries. A group's sets meet once in a trie of their ordered n-grams. Each set walks it; sets below a node share the
   overlap counted so far, and a subtree goes when the overlap plus what remains on either side can't reach the
   threshold. Tasks give the links of a spanning forest, not all pairs.
4. Large groups. A group beyond BLOCK_SETS sets or GROUP_GRAMS n-grams is dealt into blocks of hashed members, which are
   joined each by itself. Then the most typical sets of the blocks' largest clusters, PIVOTS at most, visit all blocks. As a rule
   one cluster holds nearly all sets by then; each set outside it (the rest) meets every set of its group, in pairs of
   blocks. No link can be lost: one between two clusters has a set of the rest. A group of g sets with r in the rest moves
   about 2 g + 2 r g / GROUP_SETS sets, so near copies of one document cost no more than their number.

Equal sets are one set throughout, so groups of copies cost no more than one of them; copies come back by the set's
64-bit key. Null and empty texts have empty sets and link with nothing, as have texts without words. A null key is kept
and counts as the smallest id of its class only if no other exists. Repeated rows are copies; one id may carry several
texts. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_folder, remove, scratch, write
from ._spark import cut, schema_of, small
from ._words import blocks, mixed, release, shingles, split_words

#: Frequent n-grams whose order is by count (4 MB as broadcast); least count that is looked at.
HEAVY, HEAVY_COUNT = 1 << 19, 4
#: Ranges of the 32-bit counters; where many rows stream by, a range has a counter of 32 MB.
RANGES = 1024
#: N-grams that a task gathers before it sends their counts.
FLUSH = 2_000_000
#: Sets of an n-gram whose pairs are counted; with more, all join the least of them. In large corpora also n-grams that are
#: just too rare for HEAVY may have more sets; their pairs are counted too, as each set has some of them, and joined they
#: would make one group of nearly all sets. An n-gram of more than HOT sets is dealt into cells, as many as the root of its
#: count. Both change the cost, not the links.
PAIR_SETS, HOT = 32, 256
#: Entries of prefixes that are dealt by n-gram at a time, and how many times at most: a part of the n-grams at each.
PASS_ENTRIES, PASSES = 5_000_000, 4
#: Sets of a block of a large group; sets of a block where the rest meets all others; n-grams of either, about.
BLOCK_SETS, GROUP_SETS, GROUP_GRAMS = 250, 1000, 4_000_000
#: Sets of a large group that visit all its blocks before the rest is known. Changes the cost, not the links.
PIVOTS = 64
#: Keys that are broadcast to find their rows (under 100 bytes each); beyond, such a join is shuffled.
BROADCAST_KEYS = 500_000


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Row, sorted distinct n-grams and key of every text that has any."""
    for lo, hi in blocks(texts):
        grams, at = shingles(split_words(texts.slice(lo, hi - lo), lower=True), k)
        for i in range(hi - lo):
            if at[i + 1] > at[i]:
                own = np.unique(grams[at[i] : at[i + 1]])
                key = int(mixed((mixed(own + np.uint64(7)) * np.uint64(0x9FB21C651E98DF25)).sum(keepdims=True) + np.uint64(len(own)))[0].view(np.int64))
                yield lo + i, own, key


def _counts(docs: DataFrame, k: int) -> DataFrame:
    """(gram, n): the counts of at least HEAVY_COUNT of the n-grams' upper 32 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            grams = np.sort(np.concatenate(held))
            upper, lower = grams >> np.uint32(16), grams.astype(np.uint16)
            per = (1 << 16) // RANGES
            sizes = np.bincount(upper, minlength=1 << 16).astype(np.uint32)
            ends = np.cumsum(sizes.astype(np.int64))
            starts = np.concatenate([[0], ends])
            found = [(r, sizes[r * per : (r + 1) * per].tobytes() + lower[starts[r * per] : ends[(r + 1) * per - 1]].tobytes()) for r in range(RANGES)]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["range", "counts"])

        for batch in batches:
            for _, own, key in _sets(batch.column(0), k):
                if key not in seen:
                    seen.add(key)
                    held.append((own >> np.uint64(32)).astype(np.uint32))
                    size += len(own)
                    if size > FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per, now, sums, codes, held = (1 << 16) // RANGES, None, None, [], 0

        def out() -> pa.RecordBatch:
            if sums is None:
                at, n = np.unique(np.concatenate(codes), return_counts=True)
            else:
                if codes:
                    fold()
                at = np.arange(len(sums))
                n = sums
            some = n >= HEAVY_COUNT
            return pa.RecordBatch.from_arrays([pa.array(at[some].astype(np.int64) + now * (per << 16), pa.int64()), pa.array(n[some].astype(np.int64))], ["gram", "n"])

        def fold() -> None:
            """Many counts go into a counter for each n-gram of the range; few are sorted."""
            nonlocal sums
            new = np.bincount(np.concatenate(codes), minlength=per << 16)
            sums = new if sums is None else sums + new

        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != now:
                    if now is not None:
                        yield out()
                    now, sums, codes, held = r, None, [], 0
                raw = blob.as_buffer()
                sizes, lower = np.frombuffer(raw, np.uint32, per), np.frombuffer(raw, np.uint16, offset=4 * per)
                codes.append((np.repeat(np.arange(per, dtype=np.int32), sizes) << 16) + lower)
                held += len(lower)
                if held > FLUSH:
                    fold()
                    codes, held = [], 0
        if now is not None:
            yield out()

    parts = docs.mapInArrow(count, "range int, counts binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(total, "gram long, n long")


def _heavy(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper 32 bits of the most frequent n-grams, ascending, with their counts. At most HEAVY: the least count is
    the smallest that no more than HEAVY n-grams reach."""
    with scratch(docs.sparkSession):
        counts = cut(_counts(docs, k), "gram-counts")
        least, total = None, 0
        for row in counts.groupBy(F.least("n", F.lit(1 << 14)).alias("n")).count().orderBy(F.desc("n")).collect():
            total += row["count"]
            if total > HEAVY:
                break
            least = row["n"]
        if least is None:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        found = counts.where(F.col("n") >= least).toArrow()
    gram, n = found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy().astype(np.uint32)
    order = np.argsort(gram)
    return gram[order], n[order]


class _Order:
    """The global order of n-grams: rare ones by hash, then the frequent ones by count."""

    def __init__(self, heavy: tuple[np.ndarray, np.ndarray]):
        self.gram, self.count = heavy

    def sort(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """own (ascending and distinct) in the order, and the counts of its frequent n-grams (0 for the others)."""
        if not len(self.gram):
            return own, np.zeros(len(own), np.int64)
        upper = (own >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.gram, upper), len(self.gram) - 1)
        weight = np.where(self.gram[at] == upper, self.count[at], 0).astype(np.int64)
        order = np.argsort(weight, kind="stable")
        return own[order], weight[order]


def _cells(counts: np.ndarray, set_key: int) -> np.ndarray:
    """The cell of a set under n-grams of these counts: 0 for all but the hot ones, whose sets spread over the root of
    their count."""
    number = np.where(counts > HOT, np.ceil(np.sqrt(counts)), 0).astype(np.int64)
    return np.where(number > 0, 1 + set_key % np.maximum(number, 1), 0).astype(np.int32)


def prepared(docs: DataFrame, key: str, text: str, k: int, num: int, den: int) -> tuple[DataFrame, int]:
    """One row per document: key, row (hash of its text), n (size of its set), set_key (null if empty), and prefix, cells
    (of each n-gram of the prefix) and parity, null for a set that its task has met before. Written, as all later steps
    start from it. And the least count of a frequent n-gram (0 if none is)."""
    spark = docs.sparkSession
    heavy = spark.sparkContext.broadcast(_heavy(docs.select(text), k))
    least = int(heavy.value[1].min()) if len(heavy.value[1]) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(heavy.value), set()
        for batch in batches:
            n, (keys, prefixes, cells, parities) = np.zeros(batch.num_rows, np.int64), ([None] * batch.num_rows for _ in range(4))
            for i, own, set_key in _sets(batch.column(2), k):
                n[i], keys[i] = len(own), set_key
                if set_key not in seen:
                    seen.add(set_key)
                    size = len(own) - -(-num * len(own) // den) + 1
                    grams, counts = order.sort(own)
                    prefixes[i], cells[i], parities[i] = grams[:size].view(np.int64), _cells(counts[:size], set_key), parity(own)
            found = [pa.array(n), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32())), pa.array(parities, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], [key, "row", "n", "set_key", "prefix", "cells", "parity"])

    bare = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("_row"), F.col(text).alias("_text"))
    rows = bare.mapInArrow(run, schema_of(docs, [key], "row long, n long, set_key long, prefix array<long>, cells array<int>, parity binary"))
    return cut(rows, "prefixes"), least


def parity(own: np.ndarray) -> bytes:
    """Bits that tell whether an even number of the set's n-grams falls on them; at least two bits for each n-gram. No
    fewer n-grams are in only one of two sets than bits differ."""
    size = 1 << max(8, (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(5)).astype(np.int64) & (size - 1), minlength=size) & 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two parities differ; the longer one is folded to the other's length."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). (node, root) for every node of an edge, root being the least node of its component. Each
    round joins every node's greater neighbours, then its lesser ones, to the least (large and small star) until nothing
    changes; the graph stays in the shared folder between rounds."""
    spark, last = edges.sparkSession, None

    def kept(df: DataFrame) -> tuple[DataFrame, str | None]:
        """df written, and the folder of the round before."""
        nonlocal last
        before, last = last, new_folder(spark, "edges")
        write(df, last)
        return spark.read.schema(df.schema).parquet(last), before

    edges, _ = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a")
        after = star.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after, before = kept(after)
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, before)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


class PrefixTree:
    """A path-compressed trie of ordered sets of small integers."""

    def __init__(self, sets: list[np.ndarray], ids: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets, self.ids = [sets[i] for i in order], [ids[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        #: (edge, least and greatest size below, depth after the edge, children, sets that end here)
        self.root = self._node(0, len(self.sets), 0)

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        a, b = self.sets[lo][depth:], self.sets[hi - 1][depth:]  # in order: what these share, all between share
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        to = depth + (int(differ[0]) if len(differ) else m)
        ends = [i for i in range(lo, hi) if self.sizes[i] == to]
        children, at = [], lo + len(ends)  # sets that end here come first
        while at < hi:
            token, nxt = self.sets[at][to], at + 1
            while nxt < hi and self.sets[nxt][to] == token:
                nxt += 1
            children.append(self._node(at, nxt, to))
            at = nxt
        sizes = self.sizes[lo:hi]
        return self.sets[lo][depth:to], int(sizes.min()), int(sizes.max()), to, children, [self.ids[i] for i in ends]

    def walk(self, own: np.ndarray, member: np.ndarray, before: np.ndarray, num: int, den: int, skip) -> Iterator[int]:
        """Ids of the sets that reach the threshold with own. member: which integers own has; before: how many of own
        are below each integer; skip(ids): nothing to learn about these."""
        n, stack = len(own), [(self.root, 0)]
        while stack:
            (edge, least, most, depth, children, ends), overlap = stack.pop()
            if den * most < num * n or den * n < num * least or (not children and skip(ends)):
                continue
            if len(edge):
                overlap += int(member[edge].sum())
                left = n - int(before[edge[-1] + 1])
            else:
                left = n
            # The union is at least n + least - overlap, whatever may still be shared.
            best = overlap + min(left, most - depth)
            if den * best < num * (n + least - best):
                continue
            for i in ends:
                if den * overlap >= num * (n + self.size_of[i] - overlap):
                    yield i
            stack.extend((c, overlap) for c in children)


def forest(sets: list[np.ndarray], left: list[bool], right: list[bool], labels: list, num: int, den: int) -> tuple[list[tuple[int, int]], list[int], list[float]]:
    """Places of linked sets, one of each pair on the left and one on the right: as many links as join all that such links
    join; for each set the place that stands for its cluster, and how many sets hold an n-gram of it on average. Sets of
    one label are joined before."""
    parent, first = list(range(len(sets))), {}
    for i, label in enumerate(labels):
        parent[i] = first.setdefault(label, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    grams, ranks = np.unique(np.concatenate([s for s in sets]), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    own = [ranks[e - len(s) : e] for s, e in zip(sets, ends)]
    # One order for all sets here: those that most of them hold come first, so that paths are shared for long.
    holders = np.bincount(ranks, minlength=len(grams))
    typical = [float(holders[r].mean()) for r in own]
    by_count = np.argsort(-holders, kind="stable")
    place = np.empty(len(grams), np.int64)
    place[by_count] = np.arange(len(grams))
    own = [np.sort(place[s]) for s in own]
    among = [i for i in range(len(sets)) if right[i]]
    member, links = np.zeros(len(grams), bool), []
    if among:
        tree = PrefixTree([own[i] for i in among], among)
        tree.size_of = [len(s) for s in sets]
    for i in range(len(sets) if among else 0):
        if len(links) == len(first) - 1:
            break  # all are joined
        if not left[i]:
            continue
        member[own[i]] = True
        before = np.concatenate([[0], np.cumsum(member)])
        mine = i
        for j in tree.walk(own[i], member, before, num, den, lambda ids: all(find(x) == find(mine) for x in ids)):
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                links.append((i, j))
        member[own[i]] = False
    return links, [find(i) for i in range(len(sets))], typical


def _once(table: pa.Table) -> tuple[pa.Table, list[int], list[np.ndarray]]:
    """The table, one place for each set key of it (two tasks may have sent one set), and the sets at these places."""
    at = sorted({k: i for i, k in enumerate(table["set_key"].to_pylist())}.values())
    grams = table["grams"].combine_chunks()
    return table, at, [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in at]


def _alone(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets: root, blocks, block, set_key, grams. Each block joined by itself: root, blocks, block, n, set_key, label (the
    key of its cluster's most typical set, of these the least), grams (null for groups of one block, which are done)."""

    def run(table: pa.Table) -> pa.Table:
        table, at, sets = _once(table)
        every = [True] * len(at)
        _, cluster, typical = forest(sets, every, every, at, num, den)
        keys, centre = table["set_key"].take(pa.array(at, pa.int64())).to_pylist(), {}
        for key, c, t in zip(keys, cluster, typical):
            centre[c] = min((-t, key), centre.get(c, (-t, key)))
        kept = table.take(pa.array(at, pa.int64())).select(["root", "blocks", "block", "set_key", "grams"])
        if len(kept) and kept["blocks"][0].as_py() == 1:
            kept = kept.set_column(4, "grams", pa.nulls(len(kept), pa.binary()))
        return kept.append_column("n", pa.array([len(s) for s in sets], pa.int64())).append_column("label", pa.array([centre[c][1] for c in cluster], pa.int64()))

    return sets.groupBy("root", "block").applyInArrow(run, "root long, blocks int, block int, set_key long, grams binary, n long, label long")


def _between(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets: item, is_left, set_key, label, grams. a, b: labels of sets of an item that link, one on the left and one not; a
    set may be on both sides."""

    def run(table: pa.Table) -> pa.Table:
        table, at, sets = _once(table)
        keys, sides = table["set_key"].to_pylist(), table["is_left"].to_pylist()
        on = {side: {k for k, s in zip(keys, sides) if s == side} for side in (True, False)}
        labels = table["label"].take(pa.array(at, pa.int64())).to_pylist()
        links, _, _ = forest(sets, *([keys[i] in on[side] for i in at] for side in (True, False)), labels, num, den)
        return pa.table({"a": pa.array([labels[i] for i, _ in links], pa.int64()), "b": pa.array([labels[j] for _, j in links], pa.int64())})

    return sets.groupBy("item").applyInArrow(run, "a long, b long")


def _dealt(number: str, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("set_key", F.lit(seed)), F.col(number)).cast("int")


def _large_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets: what _alone gives for groups of several blocks, written. a, b: links between the labels of a group, which
    with the labels themselves join all that links join."""
    # Pivots: of each slot the label with most sets. Sizes in a group are alike, so they hold about GROUP_GRAMS n-grams.
    clusters = sets.groupBy("root", "label").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    slots = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.lit(GROUP_GRAMS) / F.col("n"))))
    chosen = clusters.groupBy("root", F.pmod(F.xxhash64("label"), slots).alias("slot")).agg(F.max(F.struct("size", "label")).alias("_most"))
    chosen = cut(chosen.select("root", F.col("_most.label").alias("set_key")), "pivots")
    pivots = sets.join(small(chosen, BROADCAST_KEYS), ["root", "set_key"], "left_semi")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    visits = pivots.select("root", others.alias("block"), F.lit(True).alias("is_left"), "set_key", "label", "grams")
    met = visits.unionByName(sets.select("root", "block", F.lit(False).alias("is_left"), "set_key", "label", "grams"))
    found = cut(_between(met.withColumn("item", F.struct("root", "block")), num, den), "pivot-links")

    # Classes of the labels so far, the largest one of each group, and how many sets are outside it.
    so_far = components(found).select(F.col("node").alias("label"), F.col("root").alias("_class"))
    so_far = small(cut(so_far, "labels"), BROADCAST_KEYS)
    classed = sets.join(so_far, "label", "left").withColumn("_class", F.coalesce("_class", "label"))
    counted = classed.groupBy("root", "_class").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    groups = counted.groupBy("root").agg(F.max(F.struct("size", "_class")).alias("_most"), F.sum("size").alias("g"), F.sum("n").alias("n"))
    groups = groups.select("root", F.col("_most._class").alias("_main"), "g", "n", (F.col("g") - F.col("_most.size")).alias("r")).where("r > 0")
    per = F.least(F.lit(GROUP_SETS), F.greatest(F.lit(BLOCK_SETS), F.col("r")))  # few in the rest: small blocks, as they are sent once
    groups = groups.withColumn("all_blocks", F.greatest(F.ceil(F.col("g") / per), F.ceil(F.col("n") / GROUP_GRAMS)).cast("int"))
    groups = groups.withColumn("rest_blocks", F.greatest(F.ceil(F.col("r") / per), F.ceil(F.col("n") * F.col("r") / F.col("g") / GROUP_GRAMS)).cast("int"))
    groups = cut(groups, "large-groups")
    if not groups.limit(1).count():
        return found
    open_ = classed.join(small(groups, BROADCAST_KEYS), "root")
    several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = open_.where("_class <> _main").select("root", _dealt("rest_blocks", 1).alias("i"), several("all_blocks").alias("j"), F.lit(True).alias("is_left"), "set_key", "_class", "grams")
    every = open_.select("root", several("rest_blocks").alias("i"), _dealt("all_blocks").alias("j"), F.lit(False).alias("is_left"), "set_key", "_class", "grams")
    met = rest.unionByName(every).withColumnRenamed("_class", "label").withColumn("item", F.struct("root", "i", "j"))
    return found.union(cut(_between(met, num, den), "rest-links"))


def _class(n: str, num: int, den: int) -> Column:
    """Classes of set sizes: sets that link differ by one at most (a hundredth more guards against rounding)."""
    return F.floor(F.log(n) / (1.01 * math.log(den / num))).cast("int") if num < den else F.col(n).cast("int")


def candidates(rows: DataFrame, num: int, den: int, least: int = 0) -> DataFrame:
    """rows: n, set_key, prefix, cells, parity. least: of a frequent n-gram's count. bucket, a, b: pairs of set keys; the components of each bucket hold all
    sets that can link there. Sets of class b meet those of class b and b - 1 in bucket b, and no others.

    Sets a and b can share no more than c n-grams of their prefixes and what comes after the prefix that ends first. An
    n-gram of at most PAIR_SETS sets gives all its pairs, so c is known up to the n-grams of more sets, which are
    counted as shared; a pair that can't reach the threshold goes, as does one whose parities differ in too many bits. An
    n-gram of more sets joins all of them in a bucket, by way of the least set of each cell. Rows are dealt by n-gram and
    cell, so that no task gets all sets of a hot n-gram; of large tables a part of the n-grams at a time, so that no more
    than that is on the way at once."""
    size = rows.agg(F.sum(F.size("prefix"))).first()[0] if PASSES > 1 else 0
    passes = max(1, min(PASSES, -(-(size or 0) // PASS_ENTRIES)))

    def shared_of(part: int) -> DataFrame:
        zipped = F.arrays_zip("prefix", "cells")
        zipped = zipped if passes == 1 else F.filter(zipped, lambda e: F.pmod(e["prefix"], F.lit(passes)) == part)
        members = rows.where("prefix is not null").select(F.explode(zipped).alias("_e"), "set_key", F.col("n").cast("int").alias("n"))
        entries = members.select(F.col("_e.prefix").alias("gram"), F.col("_e.cells").alias("cell"), "set_key", "n").repartition("gram", "cell").groupBy("gram", "cell", "set_key").agg(F.first("n").alias("n"))
        groups = entries.groupBy("gram", "cell").agg(F.count("*").alias("sets")).where("sets > 1 or cell > 0")
        return entries.join(groups, ["gram", "cell"]).withColumn("class", _class("n", num, den))

    parts = [cut(shared_of(p), "shared") for p in range(passes)]
    shared = reduce(DataFrame.union, parts)
    many = (F.col("sets") > max(PAIR_SETS, min(least, HOT))) | (F.col("cell") > 0)
    large = shared.where(many)
    few = shared.where(~many).select("gram", "set_key", "n", "class")
    other = few.select("gram", F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("class").alias("kb"))
    pairs = few.withColumnsRenamed({"set_key": "a", "n": "na", "class": "ka"}).join(other, "gram").where("a < b and abs(ka - kb) <= 1")
    common = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first(F.greatest("ka", "kb")).alias("bucket"), F.count("*").alias("c"))
    more = large.groupBy("set_key").agg(F.count("*").alias("m"))
    common = common.join(more.select(F.col("set_key").alias("a"), F.col("m").alias("ma")), "a", "left").join(more.select(F.col("set_key").alias("b"), F.col("m").alias("mb")), "b", "left")
    after = lambda n: F.ceil(num * F.col(n) / F.lit(den)) - 1  # noqa: E731  n-grams beyond the prefix
    needed = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(num + den)) - F.greatest(after("na"), after("nb"))
    kept = common.where(F.col("c") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))) >= needed).select("bucket", "a", "b", "na", "nb")
    bits = rows.where("parity is not null").groupBy("set_key").agg(F.any_value("parity").alias("p"))
    kept = kept.join(bits.select(F.col("set_key").alias("a"), F.col("p").alias("pa")), "a").join(bits.select(F.col("set_key").alias("b"), F.col("p").alias("pb")), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch["pa"], batch["pb"])], np.int64)
            both = batch["na"].to_numpy().astype(np.int64) + batch["nb"].to_numpy()
            fine = (num + den) * differ <= (den - num) * both  # |a and b| >= num / den |a or b|, by the sizes and what differs
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(fine)) for c in ("bucket", "a", "b")], ["bucket", "a", "b"])

    kept = kept.mapInArrow(near, "bucket int, a long, b long")
    return kept.union(_stars(large))


def _stars(large: DataFrame) -> DataFrame:
    """large: gram, cell, set_key, class. bucket, a, b: what joins the sets of every n-gram in each bucket that has a set
    of its own class; the members of a cell to its least set, and those of the cells to each other."""
    placed = large.select("gram", "cell", "set_key", "class", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("bucket"))
    cells = placed.groupBy("gram", "bucket", "cell").agg(F.min("set_key").alias("a"), F.collect_set("set_key").alias("sets"), F.max(F.col("class") == F.col("bucket")).alias("own"))
    cells = cut(cells, "cells")
    joined = cut(cells.groupBy("gram", "bucket").agg(F.min("a").alias("a"), F.collect_set("a").alias("sets"), F.max("own").alias("own")).where("own").drop("own"), "joined")
    inside = cells.drop("own").join(small(joined.select("gram", "bucket"), BROADCAST_KEYS), ["gram", "bucket"], "left_semi")
    found = joined.select("bucket", "a", "sets").union(inside.select("bucket", "a", "sets"))
    return found.select("bucket", "a", F.explode("sets").alias("b")).where("a <> b").distinct()


def groups_of(pairs: DataFrame) -> DataFrame:
    """pairs: bucket, a, b. set_key, root: the candidate groups of every set, one for each bucket at most."""
    node = lambda c: F.xxhash64("bucket", c)
    edges = cut(pairs.select(node("a").alias("a"), node("b").alias("b"), F.col("a").alias("ka"), F.col("b").alias("kb")), "pairs")
    keys = edges.select(F.col("a").alias("node"), F.col("ka").alias("set_key")).union(edges.select("b", "kb")).distinct()
    return components(edges.select("a", "b")).join(keys, "node").select("set_key", "root")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, edges). rows: key, row, n, set_key per document; edges: a, b: set keys; the
    components of these are those of all links."""
    spark = docs.sparkSession
    paths = [new_folder(spark, name) for name in ("documents", "groups")]
    with scratch(spark):  # prefixes are most of what is written, and over with the groups
        full, least = prepared(docs, key, text, k, num, den)
        made = full.select(key, "row", "n", "set_key"), groups_of(candidates(full, num, den, least))
        for df, path in zip(made, paths):
            write(df, path)
    rows, groups = (spark.read.schema(df.schema).parquet(path) for df, path in zip(made, paths))
    # The texts of the candidates: one document for each set.
    one = rows.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col(key).alias("id"), F.col("row").alias("row"))).alias("_id"), F.first("n").alias("_n"))
    wanted = cut(items_of(groups.join(one, "set_key")), "candidates")
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"))
    found = texts.join(small(wanted, BROADCAST_KEYS), F.col("_key").eqNullSafe(F.col("_id.id")) & (F.col("_hash") == F.col("_id.row")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            keys, keep, out = batch["set_key"].to_pylist(), [], []
            for i, own, set_key in _sets(batch["_text"], k):
                if set_key == keys[i] and set_key not in sent:  # another text may carry the same id
                    sent.add(set_key)
                    keep.append(i)
                    out.append(own.tobytes())
            rows_kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(rows_kept) for c in ("set_key", "items")], pa.array(out, pa.binary())], ["set_key", "items", "grams"])

    sets = found.select("_text", "set_key", "items").mapInArrow(grams, "set_key long, items array<struct<root:bigint,blocks:int>>, grams binary")
    dealt = sets.select("set_key", "grams", F.explode("items").alias("_i")).select("set_key", "grams", "_i.*").withColumn("block", _dealt("blocks"))
    joined = cut(_alone(dealt, num, den), "joined-blocks")
    edges = joined.where("set_key <> label").select(F.col("set_key").alias("a"), F.col("label").alias("b"))
    large = joined.where("blocks > 1")
    if large.limit(1).count():
        edges = edges.union(_large_groups(large, num, den))
    return rows, edges


def items_of(members: DataFrame) -> DataFrame:
    """members: root, set_key, _id, _n. set_key, _id, items: the groups in which a set is compared (root, blocks); a group
    that is large for a task has several blocks."""
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("_n") / GROUP_GRAMS)).cast("int").alias("blocks"))
    return members.join(sizes, "root").groupBy("set_key", "_id").agg(F.collect_list(F.struct("root", "blocks")).alias("items"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key of its class)."""
    rows, edges = links(docs, key, text, k, num, den)
    roots = components(edges).select(F.col("node").alias("set_key"), "root")
    labelled = rows.join(roots, "set_key", "left").withColumn("_class", F.coalesce("root", "set_key")).drop("root", "set_key")
    least = labelled.where("_class is not null").groupBy("_class").agg(F.min(key).alias("_least"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    least = small(cut(least, "least"), BROADCAST_KEYS)  # so that a large class is not gathered in one task
    return labelled.join(least, "_class", "left").select(key, F.col("n").alias("n_shingles"), F.coalesce("_least", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs with one row of each class: the one with the least key (null keys come last), of equal keys the one whose text
    has the least hash. Rows without words belong to no class and stay, each of them. Any columns may be in docs."""
    rows, edges = links(docs, key, text, k, num, den)
    roots = components(edges).select(F.col("node").alias("set_key"), "root")
    at = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col("row").alias("row"))
    labelled = rows.where("set_key is not null").join(roots, "set_key", "left").select(F.coalesce("root", "set_key").alias("_class"), at.alias("_at"))
    first = labelled.groupBy("_class").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    first = small(cut(first, "firsts"), BROADCAST_KEYS)  # so that a large class is not gathered in one task
    found = labelled.join(first, "_class").groupBy("_at").agg(F.max(F.col("_at") == F.col("_first")).alias("_stays"), F.count("*").alias("_times"))
    found = cut(found.select(F.col("_at.key").alias("_key"), F.col("_at.row").alias("_row"), "_stays", "_times"), "copies")
    bare = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_own"), F.xxhash64(F.col(text)).alias("_hash"))
    kept = bare.join(small(found, BROADCAST_KEYS), F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_row")), "left").where("coalesce(_stays, true)")
    if found.where("_stays and _times > 1").limit(1).count():  # the same row again: one of them
        again = kept.where("_times > 1").groupBy("_own", "_hash").agg(F.first("_doc").alias("_doc"))
        kept = kept.where("coalesce(_times, 1) = 1").select("_doc").unionByName(again.select("_doc"))
    return kept.select("_doc.*")
