"""Work planning by joins: what is complete, what has changed, what is left to do, which files are to be renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, vocab


def outputs_complete(media: DataFrame, inventory: DataFrame, suffixes: list[str]) -> DataFrame:
    """media_id, complete. media: media_id. inventory: media_id, dir ("flat" or "nested"), suffix, length, valid (of
    subtitles). Complete if all suffixes are there in either folder: subtitles valid, others not empty."""
    places = [F.struct(F.lit(s).alias("suffix"), F.lit(d).alias("dir")) for s in suffixes for d in ("flat", "nested")]
    wanted = media.select("media_id", F.explode(F.array(*places)).alias("_w")).select("media_id", "_w.*")
    fine = F.when(F.col("suffix").endswith("srt"), F.coalesce("valid", F.lit(False))).otherwise(F.coalesce(F.col("length") > 0, F.lit(False)))
    found = wanted.join(inventory, ["media_id", "dir", "suffix"], "left").groupBy("media_id", "dir").agg(F.min(fine).alias("_all"))
    return found.groupBy("media_id").agg(F.max("_all").alias("complete"))


def fingerprint_match(inventory: DataFrame, progress: DataFrame) -> DataFrame:
    """media_id, unchanged: all four fields of the fingerprint are equal and one is stored. Both: media_id, fp."""
    stored = progress.select("media_id", F.col("fp").alias("_fp"))
    same = F.col("_fp").isNotNull()
    for f in ("size", "mtime", "head_tail_hash", "duration"):
        same = same & F.col(f"fp.{f}").eqNullSafe(F.col(f"_fp.{f}"))
    return inventory.select("media_id", "fp").join(stored, "media_id", "left").select("media_id", same.alias("unchanged"))


def plan_work(media: DataFrame, complete: DataFrame, unchanged: DataFrame, sources: DataFrame, translate: bool = True, force: bool = False, compat: bool = False) -> DataFrame:
    """media_id, mode: done, translate_only or full. sources: media_id of valid source subtitles in the output. A changed
    item is done anew in full; in compat mode an old valid subtitle is translated instead."""
    rows = media.select("media_id").join(complete, "media_id", "left").join(unchanged, "media_id", "left").join(sources.select("media_id").distinct().withColumn("_source", F.lit(True)), "media_id", "left")
    done = F.coalesce("complete", F.lit(False)) & F.coalesce("unchanged", F.lit(False))
    again = F.lit(translate) & F.coalesce("_source", F.lit(False)) & (F.lit(compat) | F.coalesce("unchanged", F.lit(False)))
    return rows.select("media_id", F.when(F.lit(force), "full").when(done, "done").when(again, "translate_only").otherwise("full").alias("mode"))


def classify_media(media: DataFrame, translate: bool = True) -> DataFrame:
    """media: media_id, is_srt, input_valid, both_translations, output_srt, beside_srt. Adds stage as an interactive user
    sees it."""
    target = F.lit(translate)
    return media.withColumn(
        "stage",
        F.when(F.col("is_srt") & ~target, "done").when(F.col("is_srt"), F.when(F.col("both_translations"), "done").when(F.col("input_valid"), "translate").otherwise("asr"))
        .when(target & F.col("both_translations"), "done").when(F.col("output_srt"), F.when(target, "translate_output").otherwise("done")).when(F.col("beside_srt"), F.when(target, "translate").otherwise("done")).otherwise("asr"),
    )


def source_language(media: DataFrame, remembered: DataFrame, configured: str = "auto") -> DataFrame:
    """media_id, language: the configured one unless auto, else the remembered one, else null."""
    return media.select("media_id").join(remembered.select("media_id", F.col("language").alias("_known")), "media_id", "left").select("media_id", (F.col("_known") if configured == "auto" else F.lit(configured)).alias("language"))


def pending(media: DataFrame, complete: DataFrame) -> DataFrame:
    return media.join(complete.where("complete").select("media_id"), "media_id", "left_anti")


def classify_names(names: DataFrame, target: str) -> DataFrame:
    """names: directory, file_name. Adds stem, role (default, old_bilingual, source_copy, migrated) and tag."""
    suffix = X.player_suffix(F.lit(target))
    parts = F.split(F.regexp_replace("file_name", r"\.srt$", ""), "[.]")
    n, last = F.size(parts), F.element_at(parts, -1)
    head = lambda k: F.array_join(F.slice(parts, F.lit(1), F.greatest(n - k, F.lit(0))), ".")
    tags = list(vocab.PLAYER_SUFFIX.values())
    role = F.when(n == 1, "default").when(last == suffix, "migrated").when(last == "bilingual", "old_bilingual").when(last.isin(tags), "source_copy").otherwise("default")
    two = (n >= 3) & (last == suffix) & (F.get(parts, n - 2) == "bilingual")
    stem = F.when(role == "default", F.array_join(parts, ".")).when(two, head(2)).otherwise(head(1))
    return names.withColumn("role", role).withColumn("stem", stem).withColumn("tag", F.when(role == "source_copy", last))


def families(names: DataFrame, target: str) -> DataFrame:
    """One row per directory and stem: the file of each role (the last by name) and the number of migrated ones."""
    roles = classify_names(names, target)
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("file_name")))
    return roles.groupBy("directory", "stem").agg(pick("default").alias("default_name"), pick("old_bilingual").alias("bilingual_name"), pick("source_copy").alias("copy_name"), F.count_if(F.col("role") == "migrated").alias("migrated"))


def blocked_targets(moves: DataFrame, names: DataFrame) -> DataFrame:
    """moves: directory, source, target. Targets that exist and are not moved away themselves."""
    there = names.select("directory", F.col("file_name").alias("target")).distinct()
    freed = moves.select("directory", F.col("source").alias("target")).distinct()
    return moves.join(there, ["directory", "target"], "left_semi").join(freed, ["directory", "target"], "left_anti").select("directory", "target").distinct()


def plan_renames(names: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(moves: directory, source, target; warnings: directory, stem, reason). Nothing on disk is touched."""
    todo = families(names, target).where((F.col("migrated") == 0) & F.col("default_name").isNotNull() & (F.col("bilingual_name").isNotNull() | F.col("copy_name").isNotNull()))
    suffix = X.player_suffix(F.lit(target))
    move = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    moves = todo.select(
        "directory",
        F.explode(
            F.array(
                move(F.col("default_name"), F.concat("stem", F.lit("."), suffix, F.lit(".srt"))),
                move(F.col("bilingual_name"), F.concat("stem", F.lit("."), X.bilingual_suffix(F.lit(target)), F.lit(".srt"))),
                move(F.col("copy_name"), F.concat("stem", F.lit(".srt"))),
            )
        ).alias("_m"),
    ).select("directory", "_m.*").where("source is not null")
    blocked = blocked_targets(moves, names)
    missing = todo.where("copy_name is null").select("directory", "stem", F.lit("no source copy").alias("reason"))
    skipped = blocked.select("directory", F.col("target").alias("stem"), F.lit("target exists").alias("reason"))
    return moves.join(blocked, ["directory", "target"], "left_anti").select("directory", "source", "target"), missing.unionByName(skipped)
