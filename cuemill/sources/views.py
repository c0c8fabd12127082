"""Subtitle-shaped views of the tables at hand, for the registered queries. Their DuckDB forms are in queries/_registry.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import table

#: Milliseconds that a character takes on the made-up timeline.
MS_PER_CHAR = 60


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, cue_no, start_ms, end_ms, lang, text: the lines of each document, one after another; each 11th has no
    duration."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("doc_id").cast("string").alias("media_id"), "lang", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("_p", "text"))
    order = Window.partitionBy("media_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.length("text")).over(order) * MS_PER_CHAR
    timed = lines.withColumn("cue_no", F.col("_p") + 1).withColumn("_upto", upto)
    start = F.col("_upto") - F.length("text").cast("long") * MS_PER_CHAR
    return timed.select("media_id", "cue_no", start.alias("start_ms"), F.when(F.col("cue_no") % 11 == 0, start).otherwise(F.col("_upto")).alias("end_ms"), "lang", "text")


#: Letters and marks, and the signs that stand for them in each third cue of mixed_cues.
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz.!;,", "日月火水木金土山川田人口手目耳足力男女子学校生先。！；、"


def mixed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cues, each third of them in CJK signs, as the tables hold none."""
    found = cues(spark, sf_dir)
    return found.withColumn("text", F.when(F.col("cue_no") % 3 == 0, F.translate("text", LETTERS, SIGNS)).otherwise(F.col("text")))


def segments_of(found: DataFrame) -> DataFrame:
    """Cues in the shape of recogniser segments of one chunk."""
    return found.select("media_id", F.lit(0).alias("chunk_no"), F.col("cue_no").alias("seg_no"), "start_ms", "end_ms", "text", "lang")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping segments of four chunks, from events; ten users make up a media item, so items grow in number."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    span = F.round(F.col("value") * 60000).cast("long")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).cast("string").alias("media_id"), (F.col("event_id") % 4).cast("int").alias("chunk_no"), F.col("event_id").alias("seg_no"), at.alias("start_ms"), (at + span).alias("end_ms"), F.col("event_type").alias("text")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").where("text is not null")
    return talks.select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").cast("int").alias("cue_no"), "role", "text")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("backend"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("event_type"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, size, duration_ms, fp, translated, changed: documents with their labels as states."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality"), F.col("toxic"))
    rows = docs.join(marks, docs.doc_id == F.col("_id"), "left")
    return rows.select(F.col("doc_id").cast("string").alias("media_id"), F.col("doc_id"), F.col("n_chars").alias("size"), (F.col("n_chars") * MS_PER_CHAR).alias("duration_ms"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("translated"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("changed"), F.col("_id").isNotNull().alias("known"), "source", "lang")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """directory, file_name: subtitle families of pages, in the shapes that a rename plan meets."""
    kinds = F.element_at(F.lit([".srt;.bilingual.srt;.jpn.srt", ".srt", ".srt;.jpn.srt;.chs.srt", ".srt;.bilingual.srt", ".bilingual.srt;.eng.srt"]), (F.col("page_id") % 5 + 1).cast("int"))
    stem = F.concat(F.lit("v"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".part").otherwise(""))
    directory = F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"))
    rows = table(spark, sf_dir, "pages").select(directory.alias("directory"), stem.alias("_stem"), F.explode(F.split(kinds, ";")).alias("_tail"))
    return rows.select("directory", F.concat("_stem", "_tail").alias("file_name"))
