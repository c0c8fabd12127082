"""Queries of planning joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import batching as E, metrics as J
from ..plans import work as G
from ..session import table
from ..sources import views
from ._registry import CUES, MEDIA, NAMES, SEGMENTS, query

_WANTED = ["srt", "chs.srt", "txt"]

# Every item has its subtitle in the flat folder, translated ones the translation there too, every fourth all three nested.
OUTPUTS = """
v_outputs AS (SELECT media_id, doc_id, 'flat' AS dir, 'srt' AS suffix, size AS length, size > 50 AS valid FROM v_media UNION ALL
  SELECT media_id, doc_id, 'flat', 'chs.srt', size, size > 50 FROM v_media WHERE translated UNION ALL SELECT media_id, doc_id, 'flat', 'txt', size, false FROM v_media UNION ALL
  SELECT media_id, doc_id, 'nested', s, size, true FROM v_media, (SELECT unnest(['srt', 'chs.srt', 'txt']) AS s) WHERE doc_id % 4 = 0)"""
_COMPLETE = "(translated AND size > 50) OR (doc_id % 4 = 0 AND size > 0)"


def _outputs(m: DataFrame) -> DataFrame:
    row = lambda d, s, v: m.select("media_id", F.lit(d).alias("dir"), F.lit(s).alias("suffix"), F.col("size").alias("length"), v.alias("valid"))
    out = row("flat", "srt", F.col("size") > 50).union(row("flat", "chs.srt", F.col("size") > 50).join(m.where("translated").select("media_id"), "media_id", "left_semi")).union(row("flat", "txt", F.lit(False)))
    nested = m.where("doc_id % 4 = 0")
    for s in _WANTED:
        out = out.union(nested.select("media_id", F.lit("nested"), F.lit(s), "size", F.lit(True)))
    return out


def _prints(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    fp = lambda size: F.struct(size.alias("size"), F.lit(1).cast("long").alias("mtime"), F.sha2(F.col("media_id"), 256).alias("head_tail_hash"), F.round(F.col("duration_ms") / 1000.0, 1).alias("duration"))
    now = m.select("media_id", fp(F.col("size")).alias("fp"))
    return now, m.where("known").select("media_id", fp(F.col("size") + F.col("changed").cast("long")).alias("fp"))


@query(f"SELECT media_id, {_COMPLETE} AS complete FROM v_media", MEDIA)
def g1_outputs_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    return G.outputs_complete(m, _outputs(m), _WANTED)


@query("SELECT media_id, known AND NOT changed AS unchanged FROM v_media", MEDIA)
def g2_fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fingerprint_match(*_prints(views.media(spark, sf_dir)))


@query(f"SELECT media_id, CASE WHEN ({_COMPLETE}) AND known AND NOT changed THEN 'done' WHEN size > 50 AND known AND NOT changed THEN 'translate_only' ELSE 'full' END AS mode FROM v_media", MEDIA)
def g3_plan_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    return G.plan_work(m, G.outputs_complete(m, _outputs(m), _WANTED), G.fingerprint_match(*_prints(m)), m.where("size > 50"))


_STAGE = "CASE WHEN doc_id % 5 = 0 THEN CASE WHEN translated THEN 'done' WHEN size > 50 THEN 'translate' ELSE 'asr' END WHEN translated THEN 'done' WHEN doc_id % 3 = 0 THEN 'translate_output' WHEN doc_id % 7 = 0 THEN 'translate' ELSE 'asr' END"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    m = views.media(spark, sf_dir).withColumns({"is_srt": d % 5 == 0, "input_valid": F.col("size") > 50, "both_translations": F.col("translated"), "output_srt": d % 3 == 0, "beside_srt": d % 7 == 0})
    return G.classify_media(m)


@query(f"SELECT media_id, {_STAGE} AS stage FROM v_media", MEDIA)
def g4_classify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("media_id", "stage")


@query("SELECT media_id, CASE WHEN known THEN lang END AS language FROM v_media", MEDIA)
def g5_source_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    return G.source_language(m, m.where("known").withColumnRenamed("lang", "language"))


@query("SELECT media_id, chunk_no, CASE WHEN bool_or(text = 'error') THEN NULL ELSE 'no result returned' END AS error FROM v_segments GROUP BY media_id, chunk_no", SEGMENTS)
def g6_missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with an error event count as answered."""
    s = views.segments(spark, sf_dir)
    return E.missing_results(s.select("media_id", "chunk_no").distinct(), s.where("text = 'error'").select("media_id", "chunk_no").distinct().withColumn("error", F.lit(None).cast("string")))


@query(f"SELECT media_id, size FROM v_media WHERE NOT ({_COMPLETE})", MEDIA)
def c4_pending_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    return G.pending(m, G.outputs_complete(m, _outputs(m), _WANTED)).select("media_id", "size")


_ROLES = """
v_parts AS (SELECT directory, file_name, string_split(regexp_replace(file_name, '\\.srt$', ''), '.') AS p FROM v_names),
v_roles AS (SELECT *, CASE WHEN len(p) = 1 THEN 'default' WHEN p[-1] = 'chs' THEN 'migrated' WHEN p[-1] = 'bilingual' THEN 'old_bilingual' WHEN p[-1] IN ('jpn', 'eng') THEN 'source_copy' ELSE 'default' END AS role FROM v_parts),
v_stems AS (SELECT *, CASE WHEN role = 'default' THEN array_to_string(p, '.') ELSE array_to_string(p[1:len(p) - 1], '.') END AS stem FROM v_roles),
v_families AS (SELECT directory, stem, max(file_name) FILTER (WHERE role = 'default') AS default_name, max(file_name) FILTER (WHERE role = 'old_bilingual') AS bilingual_name,
  max(file_name) FILTER (WHERE role = 'source_copy') AS copy_name, count(*) FILTER (WHERE role = 'migrated') AS migrated FROM v_stems GROUP BY directory, stem)"""
_MOVES = """
v_todo AS (SELECT * FROM v_families WHERE migrated = 0 AND default_name IS NOT NULL AND (bilingual_name IS NOT NULL OR copy_name IS NOT NULL)),
v_moves AS (SELECT directory, default_name AS source, stem || '.chs.srt' AS target FROM v_todo UNION ALL SELECT directory, bilingual_name, stem || '.bilingual.chs.srt' FROM v_todo WHERE bilingual_name IS NOT NULL
  UNION ALL SELECT directory, copy_name, stem || '.srt' FROM v_todo WHERE copy_name IS NOT NULL)"""


@query("SELECT * FROM v_families", NAMES, _ROLES)
def j9_classify_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.families(views.names(spark, sf_dir), "zh")


@query("SELECT * FROM v_moves", NAMES, _ROLES, _MOVES)
def j10_plan_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_renames(views.names(spark, sf_dir), "zh")[0]


@query("SELECT DISTINCT n.directory, n.stem || '.srt' AS target FROM v_stems n JOIN v_stems e ON e.directory = n.directory AND e.file_name = n.stem || '.srt' WHERE n.role = 'old_bilingual'", NAMES, _ROLES)
def g7_blocked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of every bilingual file to its family's default name."""
    names = views.names(spark, sf_dir)
    roles = G.classify_names(names, "zh").where("role = 'old_bilingual'")
    moves = roles.select("directory", F.col("file_name").alias("source"), F.concat("stem", F.lit(".srt")).alias("target"))
    return G.blocked_targets(moves, names)


@query("SELECT media_id, text AS language FROM (SELECT media_id, text, row_number() OVER (PARTITION BY media_id ORDER BY count(*) DESC, min(chunk_no), text) AS n FROM v_segments GROUP BY media_id, text) WHERE n = 1", SEGMENTS)
def j1_vote_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.vote_language(views.segments(spark, sf_dir).withColumnRenamed("text", "language"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE NOT changed) AS done, count(*) FILTER (WHERE changed) AS failed, CAST(sum(size) AS BIGINT) AS segments, false AS stopped, CASE WHEN count(*) FILTER (WHERE changed) = 0 THEN 0 ELSE 2 END AS exit_status FROM v_media", MEDIA)
def j2_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    return J.run_summary(m.select(F.when(F.col("changed"), "failed").otherwise("done").alias("status"), F.col("size").alias("segments"), F.lit(False).alias("stopped")))


@query("SELECT lang || source AS media_id, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) > 1")
def j3_duplicate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.duplicate_stems(table(spark, sf_dir, "documents").select(F.concat("lang", "source").alias("media_id")))


@query(f"SELECT CASE stage WHEN 'done' THEN 'complete' WHEN 'asr' THEN 'pending' ELSE 'translating' END AS state, count(*) AS files FROM (SELECT {_STAGE} AS stage FROM v_media) GROUP BY 1", MEDIA)
def j4_queue_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.queue_stage_counts(_classified(spark, sf_dir))


_PROGRESS = "v_top AS (SELECT user_id // 10 AS m, event_id % 4 AS c, max(greatest(0, least(1, value / 100.0))) FILTER (WHERE event_type <> 'error' AND event_id % 4 < 3) AS top FROM events GROUP BY ALL)"


def _progress(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All chunks, and reports of all but the last one."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("string").alias("media_id"), (F.col("event_id") % 4).cast("int").alias("chunk_no"), (F.col("value") / 100.0).alias("fraction"), "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    return e.select("media_id", "chunk_no").distinct(), e.where("event_type <> 'error' and chunk_no < 3")


@query("SELECT CAST(m AS VARCHAR) AS media_id, CAST(round(avg(coalesce(top, 0)) * 1000000) AS BIGINT) AS progress FROM v_top GROUP BY m", _PROGRESS)
def j5_progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.progress_rollup(*_progress(spark, sf_dir)).withColumn("progress", F.round(F.col("progress") * 1000000).cast("long"))


@query("SELECT CAST(m AS VARCHAR) AS media_id, CAST(round(CASE WHEN m % 4 = 0 THEN 0.5 ELSE avg(coalesce(top, 0)) * 0.75 + 0.5 * 0.25 END * 1000000) AS BIGINT) AS progress FROM v_top GROUP BY m", _PROGRESS)
def j6_two_phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = J.progress_rollup(*_progress(spark, sf_dir))
    both = J.two_phase_progress(F.col("progress"), F.lit(0.5), "web", F.col("media_id").cast("int") % 4 == 0)
    return p.select("media_id", F.round(both * 1000000).cast("long").alias("progress"))


@query("SELECT backend, event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY backend, island ORDER BY event_id) AS BIGINT) AS streak, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY backend, island ORDER BY event_id) = 3 AS breach FROM (SELECT CAST(user_id AS VARCHAR) AS backend, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)")
def j7_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.failure_streak(views.outcomes(spark, sf_dir)).select("backend", F.col("at").alias("event_id"), "streak", "breach")


_SPEED = "CASE WHEN lang = 'en' THEN 17 WHEN regexp_matches(text, '[぀-ヿ㐀-鿿가-힯]') THEN 10 WHEN regexp_matches(text, '[A-Za-z]') THEN 17 ELSE 18 END"


# Four cues in a row make a parent; each third parent ends too early by one millisecond.
_PARENTS = """
v_parents AS (SELECT media_id, cue_no // 4 AS p, min(start_ms) AS p_start, max(end_ms) - CASE WHEN (cue_no // 4) % 3 = 0 THEN 1 ELSE 0 END AS p_end FROM v_cues GROUP BY media_id, cue_no // 4),
v_outside AS (SELECT * FROM v_cues c WHERE NOT EXISTS (SELECT 1 FROM v_parents q WHERE q.media_id = c.media_id AND q.p_start <= c.start_ms AND q.p_end >= c.end_ms))"""


@query(f"SELECT v_cues.media_id, v_cues.lang, count(*) AS cues, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE end_ms <= start_ms) AS no_time, count(*) FILTER (WHERE length(text) > 40) AS too_long, count(*) FILTER (WHERE end_ms - start_ms > 7000) AS too_slow, count(*) FILTER (WHERE end_ms > start_ms AND length(text) * 1000 > {_SPEED} * (end_ms - start_ms)) AS too_fast, max(length(text)) AS longest, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, CAST((SELECT count(*) FROM v_outside o WHERE o.media_id = v_cues.media_id AND o.lang IS NOT DISTINCT FROM v_cues.lang) AS BIGINT) AS outside FROM v_cues GROUP BY v_cues.media_id, v_cues.lang", CUES, _PARENTS)
def j8_cue_quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = views.cues(spark, sf_dir)
    group = F.floor(F.col("cue_no") / 4)
    parents = cues.groupBy("media_id", group.alias("p")).agg(F.min("start_ms").alias("start_ms"), (F.max("end_ms") - F.when(F.col("p") % 3 == 0, 1).otherwise(0)).alias("end_ms"))
    return J.cue_quality_audit(cues, parents)


@query()
def j8_cue_quality_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and tails by language, from mergeable sketches (approximate, so without SQL)."""
    return J.quality_quantiles(J.quality_sketches(views.cues(spark, sf_dir)))


@query("SELECT text, min(event_id) AS first_at FROM (SELECT event_type || '/' || user_id AS text, event_id FROM events) GROUP BY text")
def j12_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("text"), F.col("event_id").alias("first_at"))
    return J.ordered_distinct(e, "text", "first_at")


@query("SELECT media_id, media_ms, wall_ms, CAST(floor(media_ms * 1000 / wall_ms) AS BIGINT) AS milli_factor FROM (SELECT media_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS media_ms, CAST(sum(chunk_no * 10 + 5) AS BIGINT) AS wall_ms FROM v_segments GROUP BY media_id)", SEGMENTS)
def j13_realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir)
    return J.realtime_factor(s.select("media_id", (F.col("end_ms") - F.col("start_ms")).alias("media_ms"), (F.col("chunk_no") * 10 + 5).alias("wall_ms")))
