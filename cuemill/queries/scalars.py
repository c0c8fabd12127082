"""Queries of scalar functions, predicates and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X, vocab
from ..operators import segments as D
from ..session import new_folder, table
from ..sources import srt, views
from ..sources.progress import ProgressStore
from ._registry import CUES, ENGLISH, MEDIA, MIXED, NAMES, clock, query

_MAP = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"
_SRT_LINE = f"CAST(cue_no AS VARCHAR) || chr(10) || {clock('start_ms')} || ' --> ' || {clock('end_ms')} || chr(10) || {{0}} || chr(10)"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT media_id, cue_no, start_ms / 1000.0 AS seconds FROM v_cues", CUES)
def b1_srt_ts_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cues(spark, sf_dir)
    return c.select("media_id", "cue_no", X.srt_ts_to_seconds(X.format_ms_srt(F.col("start_ms"))).alias("seconds"))


_S = "(start_ms / 1000.0)"
_CUT = f"printf('%02d:%02d:%02d,%03d', CAST(floor({_S}) AS BIGINT) // 3600, CAST(floor({_S}) AS BIGINT) // 60 % 60, CAST(floor({_S}) AS BIGINT) % 60, CAST(floor(({_S} - floor({_S})) * 1000) AS BIGINT))"


@query(f"SELECT media_id, cue_no, {_CUT} AS cut, {clock('start_ms')} AS rounded FROM v_cues", CUES)
def b2_format_ts_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("start_ms") / 1000.0
    return views.cues(spark, sf_dir).select("media_id", "cue_no", X.format_ts_srt(s).alias("cut"), X.format_ts_srt(s, round_ms=True).alias("rounded"))


@query("SELECT media_id, cue_no, printf('[%02d:%02d:%02d]', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS stamp FROM v_cues", CUES)
def b3_format_ts_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).select("media_id", "cue_no", X.format_ts_md(F.col("start_ms") / 1000.0).alias("stamp"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), ' ') AS folded FROM documents WHERE text IS NOT NULL")
def b4_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.fold_lines(F.col("text")).alias("folded"))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS request FROM documents WHERE text IS NOT NULL")
def b5_flatten_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.flatten_request(F.col("text")).alias("request"))


@query(f"SELECT media_id, cue_no, lang = 'en' AS fixed, {ENGLISH.format('text')} AS by_script FROM v_cues", CUES)
def b6_script_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).select("media_id", "cue_no", X.is_english(F.col("lang"), F.col("text")).alias("fixed"), X.is_english(F.lit("auto"), F.col("text")).alias("by_script"))


@query("SELECT doc_id, CASE WHEN lang IN ('zh', 'ja', 'en', 'ko', 'auto') THEN lang ELSE 'auto' END AS speed_lang, CASE WHEN lang IN ('zh', 'ja', 'en', 'ko', 'auto') THEN lang ELSE 'ja' END AS compat_lang FROM documents")
def b7_normalize_cps_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.speed_language(F.col("lang")).alias("speed_lang"), X.speed_language(F.col("lang"), compat=True).alias("compat_lang"))


@query("SELECT media_id, cue_no, CASE WHEN lang = 'en' THEN 17 WHEN regexp_matches(text, '[぀-ヿ㐀-鿿가-힯]') THEN 10 WHEN regexp_matches(text, '[A-Za-z]') THEN 17 ELSE 18 END AS speed FROM v_cues", CUES)
def b8_reading_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).select("media_id", "cue_no", X.reading_speed(X.speed_language(F.col("lang")), F.col("text")).alias("speed"))


@query(f"SELECT a.media_id, a.cue_no, {_STRIP.format('a.text')} || CASE WHEN {ENGLISH.format('(a.text || b.text)')} THEN ' ' ELSE '' END || {_STRIP.format('b.text')} AS joined FROM v_cues a JOIN v_cues b ON a.media_id = b.media_id AND b.cue_no = a.cue_no + 1", CUES)
def b9_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cues(spark, sf_dir)
    after = c.select("media_id", (F.col("cue_no") - 1).alias("cue_no"), F.col("text").alias("next"))
    return c.join(after, ["media_id", "cue_no"]).select("media_id", "cue_no", X.join_text(F.lit("auto"), F.col("text"), F.col("next")).alias("joined"))


_SUFFIX = f"coalesce({_MAP(vocab.PLAYER_SUFFIX)}[lang], lang)"


@query(f"SELECT doc_id, {_SUFFIX} AS suffix, 'bilingual.' || {_SUFFIX} AS bilingual, doc_id || '.' || {_SUFFIX} || '.srt' AS file_name FROM documents")
def b10_player_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.player_suffix(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("suffix"), X.bilingual_suffix(F.col("lang")).alias("bilingual"), F.concat(F.col("doc_id").cast("string"), F.lit("."), s, F.lit(".srt")).alias("file_name"))


_CODE = "(['zh', ' ZH-TW ', 'auto', 'fr', '', 'zh-hans'][doc_id % 6 + 1])"
_PROVIDER = lambda s: f"coalesce({_MAP(vocab.PROVIDER_CODES[s])}[lower(trim(coalesce(nullif({_CODE}, ''), '{vocab.PROVIDER_DEFAULT[s]}')))], lower(trim(coalesce(nullif({_CODE}, ''), '{vocab.PROVIDER_DEFAULT[s]}'))))"


@query(f"SELECT doc_id, {_PROVIDER('edge')} AS edge, {_PROVIDER('gtx')} AS gtx FROM documents")
def b11_normalize_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.lit(["zh", " ZH-TW ", "auto", "fr", "", "zh-hans"]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.provider_code("edge", code).alias("edge"), X.provider_code("gtx", code).alias("gtx"))


@query(f"SELECT doc_id, {_STRIP.format('text')} AS answer FROM documents WHERE text IS NOT NULL")
def b12_clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as models dress them: after their reasoning, in quotes, or behind an open mark."""
    docs, text = table(spark, sf_dir, "documents").where("text is not null"), F.col("text")
    quoted = F.concat(F.lit("<think>why</think> \""), text, F.lit("\" "))
    reply = F.when(F.col("doc_id") % 3 == 0, quoted).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  '"), text, F.lit("'"))).otherwise(F.concat(F.lit("<think>"), text))
    return docs.select("doc_id", X.clean_response(reply).alias("answer"))


@query("SELECT page_id, substr(sha1(url || chr(0) || length(html) || chr(0) || page_id), 1, 10) AS content_key FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def b13_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("url is not null and html is not null").select("page_id", X.content_key(F.col("url"), F.length("html"), F.col("page_id")).alias("content_key"))


@query("SELECT doc_id, CASE WHEN n_chars // 3600 > 0 THEN printf('%dh%02dm', n_chars // 3600, n_chars // 60 % 60) ELSE printf('%dm%02ds', n_chars // 60, n_chars % 60) END AS label FROM documents")
def b14_duration_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.duration_label(F.col("n_chars")).alias("label"))


_STAGES = list(vocab.STAGE_SPANS)
_FRACTION = "greatest(0, least(1, value / 100.0))"


@query("SELECT event_id, CAST(round((CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {a} + ({b} - {a}) * {_FRACTION}" for i, (a, b) in enumerate(vocab.STAGE_SPANS.values())) + " END) * 10000) AS BIGINT) AS progress FROM events")
def b15_stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.lit(_STAGES), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(X.stage_progress(stage, F.col("value") / 100.0) * 10000).cast("long").alias("progress"))


@query("SELECT directory, file_name FROM v_names WHERE lower(string_split(file_name, '.')[-1]) = 'srt'", NAMES)
def c1_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.names(spark, sf_dir).where(X.extension(F.col("file_name")).isin("srt"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'ok' WHEN event_id % 9 IN (1, 2, 3) THEN 'transient' ELSE 'permanent' END AS failure FROM events")
def c3_classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.lit([200, 429, 503, 408, 400, 401, 403, 404, 501]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.classify_failure(status).alias("failure"))


_ENDS = f"CASE WHEN {ENGLISH.format('text')} THEN len(regexp_extract_all(text, '[.!?' || chr(10) || ']')) ELSE len(regexp_extract_all(text, '[。！？!?…' || chr(10) || ']')) END"


@query(f"SELECT media_id, cue_no, (end_ms - start_ms <= 7000 AND length(text) <= 40 AND {_ENDS} <= 1) = false AS splits FROM v_mixed", CUES, MIXED)
def d4_needs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.mixed_cues(spark, sf_dir)
    return c.select("media_id", "cue_no", D.needs_split(F.lit("auto"), F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("splits"))


@query(f"SELECT media_id, string_agg({_SRT_LINE.format('text')}, chr(10) ORDER BY cue_no) AS content FROM v_cues GROUP BY media_id", CUES)
def a7_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.to_srt(views.cues(spark, sf_dir))


@query(f"SELECT media_id, string_agg({_STRIP.format('text')}, CASE WHEN (SELECT {ENGLISH.format('string_agg(c.text, chr(32))')} FROM v_cues c WHERE c.media_id = v_cues.media_id AND c.cue_no <= 5) THEN ' ' ELSE '' END ORDER BY cue_no) || chr(10) AS content FROM v_cues GROUP BY media_id".replace("string_agg(" + _STRIP.format("text") + ", CASE", "replace(string_agg(" + _STRIP.format("text") + ", chr(1) ORDER BY cue_no), chr(1), CASE").replace("ELSE '' END ORDER BY cue_no)", "ELSE '' END)"), CUES)
def a8_to_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.to_plaintext(views.cues(spark, sf_dir).withColumn("lang", F.lit("auto")))


@query(f"SELECT media_id, string_agg(printf('[%02d:%02d:%02d]', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || ' ' || {_STRIP.format('text')} || chr(10), '' ORDER BY cue_no) AS content FROM v_cues GROUP BY media_id", CUES)
def a9_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.to_markdown(views.cues(spark, sf_dir))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).withColumn("idx", F.col("cue_no")).withColumn("translation", F.when(F.col("cue_no") % 4 == 0, "").otherwise(F.concat(F.lit("> "), "text")))


_OUT = "CASE WHEN cue_no % 4 = 0 THEN text ELSE '> ' || text END"


@query(f"SELECT media_id, string_agg({_SRT_LINE.format(_OUT)}, chr(10) ORDER BY cue_no) AS content FROM v_cues GROUP BY media_id", CUES)
def a10_to_translated_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.to_translated_srt(_translated(spark, sf_dir))


@query(f"SELECT media_id, string_agg({_SRT_LINE.format('text || chr(10) || ' + _OUT)}, chr(10) ORDER BY cue_no) AS content FROM v_cues GROUP BY media_id", CUES)
def a11_to_bilingual_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.to_bilingual_srt(_translated(spark, sf_dir))


@query(f"SELECT media_id, 'srt' AS format, media_id || '.srt' AS file_name, md5(string_agg({_SRT_LINE.format('text')}, chr(10) ORDER BY cue_no)) AS digest FROM v_cues GROUP BY media_id UNION ALL SELECT media_id, 'md', media_id || '.md', md5(string_agg(printf('[%02d:%02d:%02d]', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || ' ' || {_STRIP.format('text')} || chr(10), '' ORDER BY cue_no)) FROM v_cues GROUP BY media_id", CUES)
def a12_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cues(spark, sf_dir)
    return srt.documents(c, c, ["srt", "md", "ass"]).select("media_id", "format", "file_name", F.md5("content").alias("digest"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files of documents as (path, content)."""
    return srt.to_srt(views.cues(spark, sf_dir)).select(F.concat("media_id", F.lit(".srt")).alias("path"), "content")


@query(f"SELECT media_id || '.srt' AS path, cue_no, CAST(cue_no AS BIGINT) AS idx, start_ms, end_ms, {_STRIP.format('text')} AS text FROM v_cues", CUES)
def a3_read_srt_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.cues_of(srt.read_srt(_files(spark, sf_dir), "strict")).select("path", "cue_no", "idx", "start_ms", "end_ms", "text")


@query(f"SELECT media_id || '.srt' AS path, CAST(row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS INTEGER) AS cue_no, start_ms, end_ms, {_STRIP.format('text')} AS text, CAST(n // 7 AS INTEGER) AS skipped FROM (SELECT *, max(cue_no) OVER (PARTITION BY media_id) AS n FROM v_cues) WHERE cue_no % 7 <> 0", CUES)
def a4_read_srt_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose seventh cues have lost their text and whose third ones have lost their index."""
    c = views.cues(spark, sf_dir)
    number = F.when(F.col("cue_no") % 3 == 0, "").otherwise(F.concat(F.col("cue_no").cast("string"), F.lit("\n")))
    line = F.concat(number, X.format_ms_srt(F.col("start_ms")), F.lit(" --> "), X.format_ms_srt(F.col("end_ms")), F.lit("\n"), F.when(F.col("cue_no") % 7 == 0, "").otherwise(F.concat("text", F.lit("\n"))))
    files = srt._joined(c, line).select(F.concat("media_id", F.lit(".srt")).alias("path"), "content")
    read = srt.read_srt(files, "lenient")
    return srt.cues_of(read).join(read.select("path", "skipped"), "path").select("path", "cue_no", "start_ms", "end_ms", "text", "skipped")


@query("SELECT path, how, message, skipped, cues FROM (SELECT media_id || '.srt' AS path, CASE WHEN CAST(media_id AS BIGINT) % 5 = 0 THEN 'error' WHEN CAST(media_id AS BIGINT) % 5 = 1 THEN 'lenient' ELSE 'strict' END AS how, CASE WHEN CAST(media_id AS BIGINT) % 5 = 0 THEN 'no usable cue' END AS message, 0 AS skipped, CAST(CASE WHEN CAST(media_id AS BIGINT) % 5 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS cues FROM v_cues GROUP BY media_id)", CUES)
def a5_read_srt_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good files, files with a headline (lenient) and files that are no subtitles (errors)."""
    files = _files(spark, sf_dir)
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 5
    body = F.when(n == 0, "no subtitle at all").when(n == 1, F.concat(F.lit("A headline\n\n"), "content")).otherwise(F.col("content"))
    return srt.read_srt(files.withColumn("content", body), "auto").select("path", "how", "message", "skipped", F.size("cues").alias("cues"))


_BYTES = "CAST(sum(length(CAST(cue_no AS VARCHAR)) + 29 + 3 + octet_length(encode(text))) + count(*) - 1 AS BIGINT)"


@query(f"SELECT media_id || '.srt' AS path, CAST(media_id AS BIGINT) % 4 = 0 AND {_BYTES} > 50 AS valid FROM v_cues GROUP BY media_id", CUES)
def a6_srt_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good files, files with bytes that are no UTF-8, without time lines, and too short."""
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 4
    good = F.col("content").cast("binary")
    content = F.when(n == 1, F.concat(good, F.lit(b"\xff\xfe"))).when(n == 2, F.replace("content", F.lit("-->"), F.lit("--")).cast("binary")).when(n == 3, F.substring(good, 1, 50)).otherwise(good)
    return _files(spark, sf_dir).withColumn("content", content).select("path", srt.srt_valid(F.octet_length("content"), F.col("content")).alias("valid"))


def _folders(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' subtitle files, in one folder for each last digit."""
    folder = new_folder(spark, "scan")
    files = srt.to_srt(views.cues(spark, sf_dir)).select(F.concat(F.substring("media_id", -1, 1), F.lit("/"), "media_id", F.lit(".srt")).alias("file_name"), "content")
    srt.write_documents(files, folder, as_files=True, turns=4)
    return folder


@query(f"SELECT media_id || '.srt' AS name, media_id, {_BYTES} AS length FROM v_cues GROUP BY media_id", CUES)
def a1_scan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.scan_media(spark, _folders(spark, sf_dir), ["SRT"]).select("name", "media_id", "length")


@query(f"SELECT media_id || '.srt' AS name, media_id, {_BYTES} AS length FROM v_cues GROUP BY media_id", CUES)
def a2_collect_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that overlap: all folders, and the whole once more; each file comes once."""
    folder = _folders(spark, sf_dir)
    return srt.collect_srt(spark, [f"{folder}/*", folder]).select("name", "media_id", "length")


@query(f"SELECT media_id, CASE WHEN doc_id % 2 = 0 THEN 'done' WHEN known THEN 'failed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN lang END AS language FROM v_media", MEDIA)
def a13_progress_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of a store."""
    m = views.media(spark, sf_dir)
    stored = m.select("media_id", F.when(F.col("known"), "failed").otherwise("pending").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("language"))
    new = m.where("doc_id % 2 = 0").select("media_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("language"))
    store = ProgressStore(spark, new_folder(spark, "progress"))
    store.upsert(stored)
    store.upsert(new)
    return store.read().select("media_id", "status", "language")
