"""Aggregates over jobs, cues and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import Scan
from ..functions import text as X, vocab


def vote_language(results: DataFrame, fixed: str | None = None) -> DataFrame:
    """media_id, language: the most frequent of the chunks' languages, the first seen among equals; null if none is
    known. A fixed language wins."""
    if fixed:
        return results.select("media_id").distinct().withColumn("language", F.lit(fixed))
    counts = results.where("language is not null").groupBy("media_id", "language").agg(F.count("*").alias("n"), F.min("chunk_no").alias("first"))
    best = counts.groupBy("media_id").agg(F.min_by("language", F.struct(-F.col("n"), "first", "language")).alias("language"))
    return results.select("media_id").distinct().join(best, "media_id", "left")


def run_summary(tasks: DataFrame) -> DataFrame:
    """tasks: status, segments, stopped. One row with totals and the exit status: 130 stopped, 3 all failed, 2 some, 0."""
    sums = tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.coalesce(F.max("stopped"), F.lit(False)).alias("stopped"))
    return sums.withColumn("exit_status", F.when(F.col("stopped"), 130).when((F.col("failed") > 0) & (F.col("failed") == F.col("total")), 3).when(F.col("failed") > 0, 2).otherwise(0))


def duplicate_stems(media: DataFrame) -> DataFrame:
    return media.groupBy("media_id").agg(F.count("*").alias("files")).where("files > 1")


def queue_stage_counts(media: DataFrame) -> DataFrame:
    """media: stage. Files per state of the queue."""
    state = F.when(F.col("stage") == "done", "complete").when(F.col("stage").isin("translate", "translate_output", "translating"), "translating").when(F.col("stage").isin("extracting", "transcribing"), "active").when(F.col("stage") == "asr", "pending").otherwise("waiting")
    return media.groupBy(state.alias("state")).agg(F.count("*").alias("files"))


def progress_rollup(planned: DataFrame, events: DataFrame) -> DataFrame:
    """media_id, progress: the mean over all planned chunks of the highest fraction reported, 0 without a report.
    events: media_id, chunk_no, fraction."""
    top = events.groupBy("media_id", "chunk_no").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fraction"))).alias("top"))
    return planned.join(top, ["media_id", "chunk_no"], "left").groupBy("media_id").agg(F.avg(F.coalesce("top", F.lit(0.0))).alias("progress"))


def two_phase_progress(asr: Column, translation: Column, backend: str, translate_only: Column) -> Column:
    ceiling = vocab.ASR_CEILING[backend]
    return F.when(translate_only, translation).otherwise(asr * ceiling + translation * (1.0 - ceiling))


def failure_streak(outcomes: DataFrame, limit: int = 3, huge: bool = False) -> DataFrame:
    """outcomes: backend, at, ok. Adds streak (failures in a row up to here) and breach (the streak reaches limit). huge:
    backends may have more outcomes than a task holds."""
    failed = Scan(outcomes, "backend", ["at"], huge).add(_failed=("sum", (~F.col("ok")).cast("int")))
    since = failed.add(_before=("max", F.when(F.col("ok"), F.coalesce("_failed", F.lit(0))))).done()
    return since.withColumn("streak", F.col("_failed") - F.coalesce("_before", F.lit(0))).withColumn("breach", F.col("streak") == limit).drop("_failed", "_before")


def cue_quality_audit(cues: DataFrame, parents: DataFrame | None = None, huge: bool = False) -> DataFrame:
    """Per media item and language: how many cues break each rule. parents (media_id, start_ms, end_ms): the segments that
    cues were made of; outside counts the cues that none of them holds whole. A cue without a duration or with a null time
    lies inside where a segment holds what is known of it."""
    length, span = F.length("text"), F.col("end_ms") - F.col("start_ms")
    fast = length.cast("long") * 1000 > X.reading_speed(X.speed_language(F.col("lang")), F.col("text")) * span
    more = []
    if parents is not None:
        cues = inside_parents(cues, parents, huge)
        more = [F.count_if(~F.col("inside")).alias("outside")]
    return cues.groupBy("media_id", "lang").agg(
        F.count("*").alias("cues"), F.count_if(X.strip(F.col("text")) == "").alias("empty"), F.count_if(span <= 0).alias("no_time"), F.count_if(length > vocab.MAX_CHARS).alias("too_long"),
        F.count_if(span > vocab.MAX_CUE_MS).alias("too_slow"), F.count_if((span > 0) & fast).alias("too_fast"), F.max(length).cast("long").alias("longest"), F.sum(span).alias("total_ms"), *more,
    )


def inside_parents(cues: DataFrame, parents: DataFrame, huge: bool = False) -> DataFrame:
    """cues with inside: whether a segment of the media item begins no later and ends no earlier. A segment that does is
    found without pairs: of those that have begun, the latest end is carried along the starts, and is late enough."""
    both = cues.select(F.col("media_id"), F.col("start_ms").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct(*cues.columns).alias("_cue"))
    begun = parents.where("start_ms is not null and end_ms is not null").select("media_id", F.col("start_ms").alias("_at"), F.lit(0).alias("_kind"), F.col("end_ms").cast("long").alias("_end"), F.lit(None).cast(both.schema["_cue"].dataType).alias("_cue"))
    held = Scan(both.unionByName(begun), "media_id", ["_at", "_kind"], huge).add(_latest=("max", F.col("_end"))).done().where("_kind = 1")
    return held.select("_cue.*", F.coalesce(F.col("_latest") >= F.col("_cue.end_ms"), F.lit(False)).alias("inside"))


#: Accuracy of the sketches: with this k, the rank of a quantile is off by less than 1.5 % (99 of 100 times).
SKETCH_K = 400


def quality_sketches(cues: DataFrame) -> DataFrame:
    """Per language: cues, and mergeable sketches (KLL) of characters a second in thousandths (cues with a duration), of
    characters and of milliseconds. Sketches of many tables or days are merged by kll_merge_agg_bigint."""
    span = F.col("end_ms") - F.col("start_ms")
    sketch = lambda c: F.kll_sketch_agg_bigint(c.cast("long"), SKETCH_K)
    return cues.groupBy("lang").agg(F.count("*").alias("cues"), sketch(F.when(span > 0, F.floor(F.length("text").cast("long") * 1_000_000 / span))).alias("speed"), sketch(F.length("text")).alias("chars"), sketch(span).alias("ms"))


def quality_quantiles(sketches: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per language: the quantiles of each sketch, as arrays in the order of at; null where no cue had a value."""
    ranks = F.array(*[F.lit(float(q)) for q in at])
    value = lambda c: F.when(F.kll_sketch_get_n_bigint(c) > 0, F.kll_sketch_get_quantile_bigint(c, ranks))
    return sketches.select("lang", "cues", *[value(F.col(c)).alias(c) for c in ("speed", "chars", "ms")])


def first_k(cues: DataFrame, k: int = 5) -> DataFrame:
    return cues.withColumn("_n", F.row_number().over(Window.partitionBy("media_id").orderBy("cue_no"))).where(F.col("_n") <= k).drop("_n")


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row number of each key."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def realtime_factor(runs: DataFrame) -> DataFrame:
    """runs: media_id, media_ms, wall_ms. Media seconds handled in a second, in thousandths."""
    return runs.groupBy("media_id").agg(F.sum("media_ms").alias("media_ms"), F.sum("wall_ms").alias("wall_ms")).withColumn("milli_factor", F.when(F.col("wall_ms") > 0, F.floor(F.col("media_ms") * 1000 / F.col("wall_ms")).cast("long")))
