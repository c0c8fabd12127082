"""Mixing sources to target weights: repetition rates per source, whole copies per document.

The rate of a source is target / size. Every document is emitted floor(rate) times; one more copy goes to the documents
whose hash lies under the source's threshold. The threshold starts from the fraction of the rate: it is the point up to
which the documents, in the order of their hashes, hold that fraction of the source's words. So the copy has the
probability of the fraction, drawn by one hash of key and text, while the words taken miss the target by half a document
at most, also for sources of a few documents where free draws would miss it by far.

Null text has size 0 and is never copied more often than others of its source; a null source is a source of its own,
last in order. A null key is a key like others. Rows with one key and different texts draw apart. Rows alike in key and
text share a draw, and if the threshold falls among them, as many of them get the copy as come nearest to the target. An
empty table gives an empty result. Columns that carry names used here stay untouched in mix(); plan() returns its own
columns only.

No task holds more than the root of a source's documents, or a part of a partition: the threshold is sought in as many
cells of the hashes as the root of the number of rows, then among the documents of one cell. More sources than
BROADCAST_SOURCES are ranked in ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import cut, shuffle_partitions, small

WEIGHTS = (5, 2, 1)
CAP = 3
#: Cells of the hashes in which sizes are summed first, at least.
LEAST_CELLS = 1024
#: Sources whose table is broadcast or ranked in one task at most (under 100 bytes each); beyond, the join is shuffled.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 1 << 48


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column) -> Column:
    """48 bits of the MD5 of key and text as a long: the row's draw."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 12), 16, 10).cast("long")


def _upto(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums in an order without ties, each row's own value included. Few rows are one window; many are
    dealt into ranges of the order, each of which starts from what the ranges before it hold."""
    if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.sum(c).over(rows) for n, c in sums.items()})
    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts, "ranges")
    rows = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_from{n}") for n in sums])
    own = parts.withColumns({n: F.sum(c).over(rows) for n, c in sums.items()}).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return own.withColumns({n: F.col(n) + F.col(f"_from{n}") for n in sums}).drop("_part", "_p", *[f"_from{n}" for n in sums])


def targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sized: _source, _size. One row per source: _source, _source_size, _target.

    Shares by weight of the total; a source stops at cap times its size and its excess goes to the others by weight.
    In the order of cap * size / weight, the capped sources are a prefix, so one pass of running sums gives the level.
    Only sums come to the driver.
    """
    per = cut(sized.groupBy("_source").agg(F.sum("_size").alias("_source_size")), "sources")
    total = per.agg(F.sum("_source_size")).first()[0] or 0
    per = _upto(per, [F.col("_source").isNull(), F.col("_source")], {"_n": F.lit(1)})
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    per = cut(per.withColumn("_limit", F.lit(cap) * F.col("_source_size")), "weights")
    all_w = per.agg(F.sum("_w")).first()[0] or 0
    per = _upto(per, [F.col("_limit") / F.col("_w"), F.col("_n")], {"_limits": F.col("_limit"), "_ws": F.col("_w")})
    # What is left for a source and those after it, by weight: the level at which the shares stop.
    per = per.withColumn("_level", (F.lit(total) - (F.col("_limits") - F.col("_limit"))).cast("double") / (F.lit(all_w) - (F.col("_ws") - F.col("_w"))))
    per = cut(per.withColumn("_free", F.col("_limit") >= F.col("_level") * F.col("_w")), "levels")
    water = per.where("_free").agg(F.min(F.struct(F.col("_limit") / F.col("_w"), "_n", "_level")).alias("x")).first()["x"]
    level, capped = F.lit(float(water["_level"]) if water else 0.0), F.col("_limit").cast("double")
    return per.select("_source", "_source_size", F.when(F.col("_free"), level * F.col("_w")).otherwise(capped).alias("_target"))


def _columns(source: Column, text: Column, key: Column) -> list[Column]:
    return [source.alias("_source"), words(text).alias("_size"), draw(key, text).alias("_u"), key.alias("_key"), F.monotonically_increasing_id().alias("_no")]


def rates(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: _source, _source_size, _target, _base (copies for all), and who gets one more: draws up to
    _below, and rows before _last (draw, key, size) or alike, of which _take of _alike get it."""
    cells = max(LEAST_CELLS, math.isqrt(sized.count()))
    width = DRAWS // cells
    per = targets(sized, weights, cap)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    per = cut(per.withColumn("_base", F.floor(rate)).withColumn("_need", F.col("_target") - F.col("_base") * F.col("_source_size")), "sources")
    # The words of each cell, then the cell in which the running sum passes what is needed.
    sums = sized.groupBy("_source", (F.col("_u") / width).cast("long").alias("_cell")).agg(F.sum("_size").alias("_cell_size"))
    upto = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        sums.withColumn("_upto", F.sum("_cell_size").over(upto))
        .join(per.select(F.col("_source").alias("_s"), "_need"), F.col("_source").eqNullSafe(F.col("_s")))
        .where((F.col("_need") > 0) & (F.col("_upto") >= F.col("_need")))
        .groupBy("_source", "_need")
        .agg(F.min(F.struct("_cell", "_upto", "_cell_size")).alias("_x"))
        .select(F.col("_source").alias("_s"), "_need", F.col("_x._cell").alias("_at"), (F.col("_x._upto") - F.col("_x._cell_size")).alias("_before"))
    )
    crossing = cut(crossing, "crossing")
    inside = sized.join(small(crossing, BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_s")) & ((F.col("_u") / width).cast("long") == F.col("_at")))
    alike = inside.groupBy("_source", "_u", "_key", "_size", "_need", "_before").agg(F.count("*").alias("_alike"))
    order = Window.partitionBy("_source").orderBy("_u", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_need") - F.col("_before") - F.coalesce(F.sum(F.col("_size") * F.col("_alike")).over(order), F.lit(0))
    take = F.when(F.col("_size") == 0, F.col("_alike")).otherwise(F.least(F.col("_alike"), F.floor(F.col("_room") / F.col("_size") + 0.5)))
    last = alike.withColumn("_room", room).where(F.col("_room") - F.col("_size") / 2 >= 0).withColumn("_take", take)
    last = last.groupBy("_source").agg(F.max(F.struct(F.struct(F.col("_u").alias("u"), F.col("_key").alias("key"), F.col("_size").alias("size")).alias("last"), "_take", "_alike")).alias("_x"))
    last = last.select(F.col("_source").alias("_s"), F.col("_x.last").alias("_last"), F.col("_x._take").alias("_take"), F.col("_x._alike").alias("_alike"))
    below = crossing.select("_s", (F.col("_at") * width - 1).alias("_below"))
    per = per.join(below, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    per = per.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return cut(per.select("_source", "_source_size", "_target", "_base", "_below", "_last", "_take", "_alike"), "rates")


def _copies(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (_source, _u, _key, _size, _no) with _source_size, _target and _copies."""
    mine = F.struct(F.col("_u").alias("u"), F.col("_key").alias("key"), F.col("_size").alias("size"))
    among = F.coalesce((F.col("_take") < F.col("_alike")) & mine.eqNullSafe(F.col("_last")), F.lit(False))
    more = F.coalesce(F.col("_u") <= F.col("_below"), F.lit(False)) | F.coalesce(mine <= F.col("_last"), F.lit(False))
    found = rows.join(small(per.withColumnRenamed("_source", "_of"), BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    copied = found.withColumn("_copies", F.col("_base") + more.cast("long"))
    if not per.where("_take < _alike").limit(1).count():
        return copied
    # The threshold falls among rows that are alike: the first ones in the order of their numbers get the copy. A
    # partition's rows are numbered by themselves, after those of the partitions before it.
    tied = cut(found.where(among).withColumn("_part", F.shiftright("_no", 33)), "tied")
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tied.groupBy("_source", "_part").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "_from")
    numbered = tied.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_no")))
    numbered = numbered.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    numbered = numbered.withColumn("_copies", F.col("_base") + (F.col("_rank") + F.col("_from") <= F.col("_take")).cast("long"))
    return copied.where(~among).unionByName(numbered.select(*copied.columns))


def plan(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of docs: the key, _size, _source_size, _target, _copies. The texts are read once, for the sizes."""
    sized = cut(docs.select(*_columns(F.col(source), F.col(text), F.col(key))), "sizes")
    found = _copies(sized, rates(sized, weights, cap))
    return found.select(F.col("_key").alias(key), "_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, in the columns of docs. Map-only over the documents
    once the small table of sources is known."""
    per = rates(cut(docs.select(*_columns(F.col(source), F.col(text), F.col(key))), "sizes"), weights, cap)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"))
    of = F.col("_doc").getField
    bare = whole.select("_doc", *_columns(of(source), of(text), of(key)))
    found = _copies(bare, per).where("_copies > 0")
    return found.select(F.explode(F.array_repeat("_doc", F.col("_copies").cast("int"))).alias("_doc")).select("_doc.*")
