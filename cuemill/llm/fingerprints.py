"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A text's shingles (runs of five words; the whole sequence if shorter) are hashed once. The top bits of a hash choose a
bin, and a bin keeps its least hash. An empty bin takes the value of a filled one: it walks its own pseudo-random order of bins,
alike for all documents, to the first filled one (after ATTEMPTS steps, the filled one that its hash ranks first). The
fingerprint holds BITS low-order bits of every bin in hexadecimal. Likeness is the share of equal bins, corrected for
the 2^-BITS that agree by chance.

Null, empty and wordless texts have the empty fingerprint "", which is alike (1) to itself and unlike (0) any other.
Equal texts have equal fingerprints, so repeated rows and ties need nothing special. All is DataFrame functions, in one
row each; texts of any length are read whole; other columns are not read. Where documents are paired with the next one
(with_edits), keys are numbers or times, null keys come first, rows of one key follow a hash of their texts, and an empty
table gives no rows. Ranges split null and repeated keys by that hash; rows alike in key and text stay together.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import shuffle_partitions

WORDS = 5
BINS = 256
#: Steps of an empty bin's walk before all filled bins are ranked.
ATTEMPTS = 4
#: Low-order bits kept of each bin; two hexadecimal digits.
BITS = 8
_BIN_BITS = BINS.bit_length() - 1
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hashes of the shingles, sorted."""
    words = F.array_remove(F.split(text, SPACE), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, runs).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(hashed, of))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def minima(hashes: Column) -> Column:
    """Of sorted hashes: the first of each bin (a bin is the top bits of the hash, as a signed number)."""
    return F.filter(hashes, lambda h, i: (i == 0) | (F.shiftright(h, 64 - _BIN_BITS) != F.shiftright(F.get(hashes, i - 1), 64 - _BIN_BITS)))


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """The hexadecimal fingerprint; "" without words."""
    bin_of = lambda h: F.shiftright(h, 64 - _BIN_BITS)
    bins = F.sequence(F.lit(-BINS // 2).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint"))

    def dense(found: Column, filled: Column) -> Column:
        """found: the minima in the order of their bins; filled: these bins."""

        def of(b: Column) -> Column:
            own = F.array_position(filled, b)
            return F.when(own > 0, F.element_at(found, own.cast("int"))).otherwise(F.coalesce(*[walk(b, a) for a in range(1, ATTEMPTS + 1)], nearest(b)))

        def walk(b: Column, attempt: int) -> Column:
            at = F.array_position(filled, F.pmod(F.xxhash64(b, F.lit(attempt)), F.lit(BINS)) - BINS // 2)
            return F.when(at > 0, F.element_at(found, at.cast("int")))

        def nearest(b: Column) -> Column:
            ranks = F.transform(filled, lambda x, i: F.xxhash64(b, x).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("bigint")))
            return F.element_at(found, (F.array_min(ranks).bitwiseAND(F.lit(BINS - 1)) + 1).cast("int"))

        return F.when(F.size(found) == BINS, found).otherwise(F.transform(bins, of))

    def packed(found: Column) -> Column:
        digits = F.transform(_let(F.transform(found, bin_of), lambda filled: dense(found, filled)), lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))
        return F.lower(F.array_join(digits, ""))

    return F.coalesce(_let(_let(shingle_hashes(F.coalesce(text, F.lit("")), k), minima), lambda m: F.when(F.size(m) > 0, packed(m)).otherwise("")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    size = BITS // 8

    def same(x: Column, y: Column) -> Column:
        at = lambda z, i: F.substring(z, i * size + 1, F.lit(size))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda acc, i: acc + (at(x, i) == at(y, i)).cast("int"))

    chance = 1.0 / (1 << BITS)
    equal = _let(F.unhex(a), lambda x: _let(F.unhex(b), lambda y: same(x, y)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (equal / float(BINS) - chance) / (1 - chance)))


def _list(values: list, kind: str) -> Column:
    """A constant array, as one literal however long it is."""
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f").cast(f"array<{kind}>")


def _bounds(docs: DataFrame, key: str, n: int) -> list[tuple]:
    """At most about n bounds (1, key, least hash) that deal docs into even ranges of (key, hash of the text); null keys
    come first, as (0, any key, least hash). A key that holds many rows has a bound for each of its parts."""
    shares = _list([i / n for i in range(1, n)], "double")
    found = docs.agg(F.percentile_approx(key, shares, 100 * n).alias("b"), F.count("*").alias("rows"), F.count(key).alias("keys"), F.min(key).alias("least")).first()
    if found["least"] is None:
        return []
    split = lambda c: [-(1 << 63) + i * (1 << 64) // c for i in range(c)]
    nulls = -(-n * (found["rows"] - found["keys"]) // found["rows"])
    out = [(0, found["least"], h) for h in split(max(1, nulls))[1:]] + [(1, found["least"], -(1 << 63))] * (nulls > 0)
    return sorted({*out, *((1, k, h) for k, c in Counter(found["b"]).items() for h in split(c))})


class _Ranges:
    """Ranges of rows by (key, hash), and the first row of each."""

    def __init__(self, docs: DataFrame, key: str, hashed: Column, n: int):
        self.key, self.hashed, self.kind = F.col(key), hashed, docs.schema[key].dataType.simpleString()
        self.bounds = _bounds(docs, key, n)
        first = docs.groupBy(self.of().alias("part")).agg(F.min(F.struct(self.key.isNotNull().cast("int").alias("a"), self.key.alias("b"), hashed.alias("c"))).alias("f")).orderBy("part").collect()  # a row a range
        self.parts, self.first = [r["part"] for r in first], [(r["f"]["a"], 0 if r["f"]["b"] is None else r["f"]["b"], r["f"]["c"]) for r in first]

    def of(self) -> Column:
        """A row's range: how many bounds are at most it, by binary search."""
        size = len(self.bounds)
        if not size:
            return F.lit(0)
        a, b, c = (_list([x[i] for x in self.bounds], kind) for i, kind in enumerate(("int", self.kind, "bigint")))
        own = self.key.isNotNull().cast("int")

        def passed(i: Column) -> Column:
            equal = (own == 0) | F.coalesce(F.get(b, i) == self.key, F.lit(False))
            return (F.get(a, i) < own) | ((F.get(a, i) == own) & (F.coalesce(F.get(b, i) < self.key, F.lit(False)) & (own == 1) | equal & (F.get(c, i) <= self.hashed)))

        steps = [1 << j for j in range(size.bit_length() - 1, -1, -1)]
        return F.aggregate(_list(steps, "int"), F.lit(0), lambda low, step: F.when(low + step > size, low).when(passed(low + step - 1), low + step).otherwise(low))

    def copied_to(self, part: Column) -> Column:
        """The range before a row's own, if the row is the first of its range; else null. Before the first is the last."""
        at = F.array_position(_list(self.parts, "int"), part).cast("int") - 1
        a, b, c = (_list([x[i] for x in self.first], kind) for i, kind in enumerate(("int", self.kind, "bigint")))
        same = (F.get(a, at) == self.key.isNotNull().cast("int")) & (F.get(c, at) == self.hashed) & (self.key.isNull() | (F.get(b, at) == self.key))
        return F.when(same, F.get(_list(self.parts[-1:] + self.parts[:-1], "int"), at))


def with_next(docs: DataFrame, key: str, columns: dict[str, Column]) -> tuple[DataFrame, Window]:
    """docs in ranges of key, each with a copy of the first row of the next range (_copy) behind it, the last range with
    that of the first; and the window in which the next row is the next document. Rows of one key follow the hash of the
    first of columns. The driver sees as many bounds as there are ranges, four for each shuffle partition."""
    hashed = F.xxhash64(next(iter(columns.values())))
    ranges = _Ranges(docs, key, hashed, 4 * shuffle_partitions(docs.sparkSession))
    rows = docs.select(F.col(key), *[c.alias(n) for n, c in columns.items()], hashed.alias("_hash"), ranges.of().alias("_part"))
    ranges.hashed = F.col("_hash")
    if not ranges.parts:
        return rows.withColumn("_copy", F.lit(0)), Window.partitionBy("_part").orderBy("_copy", F.col(key).asc_nulls_first(), "_hash")
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy"))
    before = ranges.copied_to(F.col("_part"))
    places = F.when(before.isNotNull(), F.array(own, F.struct(before.alias("part"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    rows = rows.select(key, *columns, "_hash", F.explode(places).alias("_at")).select(key, *columns, "_hash", F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy"))
    return rows, Window.partitionBy("_part").orderBy("_copy", F.col(key).asc_nulls_first(), "_hash")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last half replaced by the start of the next document in the order of the keys. One shuffle of the texts."""
    bare = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows, order = with_next(bare, key, {"_text": F.col("_text")})
    paired = rows.select(key, "_part", "_copy", "_hash", "_text", F.length("_text").alias("n_chars"), F.lead("_text").over(order).alias("_next"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars") - half), F.substring(F.coalesce("_next", "_text"), F.lit(1), half))
    printed = paired.select(
        key, "_part", "_copy", "_hash", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), fingerprint(F.col("_text")).alias("fingerprint"),
        F.when(F.col("_copy") == 0, fingerprint(edited)).alias("edited_fingerprint"),
    )
    after = printed.withColumn("_next", F.lead("fingerprint").over(order)).where("_copy = 0")
    return after.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("_next", "fingerprint")).alias("near_next"))
