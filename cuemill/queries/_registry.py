"""Where queries register, and the DuckDB forms of the views that they start from."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

CUES = """
v_lines AS (SELECT CAST(doc_id AS VARCHAR) AS media_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL),
v_line AS (SELECT media_id, lang, unnest(l) AS text, generate_subscripts(l, 1) AS cue_no FROM v_lines),
v_upto AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY media_id ORDER BY cue_no) * 60 AS BIGINT) AS upto FROM v_line),
v_cues AS (SELECT media_id, CAST(cue_no AS INTEGER) AS cue_no, CAST(upto - length(text) * 60 AS BIGINT) AS start_ms,
  CAST(CASE WHEN cue_no % 11 = 0 THEN upto - length(text) * 60 ELSE upto END AS BIGINT) AS end_ms, lang, text FROM v_upto)"""

SEGMENTS = """
v_segments AS (SELECT CAST(user_id // 10 AS VARCHAR) AS media_id, CAST(event_id % 4 AS INTEGER) AS chunk_no, event_id AS seg_no, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + CAST(round(value * 60000) AS BIGINT) AS end_ms, event_type AS text FROM events)"""

MEDIA = """
v_media AS (SELECT CAST(d.doc_id AS VARCHAR) AS media_id, d.doc_id, d.n_chars AS size, d.n_chars * 60 AS duration_ms, coalesce(l.quality = 1, false) AS translated,
  coalesce(l.toxic = 1, false) AS changed, l.doc_id IS NOT NULL AS known, d.source, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

NAMES = """
v_names AS (SELECT 'd' || (page_id % 7) AS directory, 'v' || page_id || CASE WHEN page_id % 3 = 0 THEN '.part' ELSE '' END ||
  unnest(string_split(['.srt;.bilingual.srt;.jpn.srt', '.srt', '.srt;.jpn.srt;.chs.srt', '.srt;.bilingual.srt', '.bilingual.srt;.eng.srt'][page_id % 5 + 1], ';')) AS file_name FROM pages)"""

#: Cues of which each third is written in other signs. LETTERS and SIGNS are as in the view of Spark.
MIXED = f"""
v_mixed AS (SELECT media_id, cue_no, start_ms, end_ms, lang, CASE WHEN cue_no % 3 = 0 THEN translate(text, '{views.LETTERS}', '{views.SIGNS}') ELSE text END AS text FROM v_cues)"""

ENGLISH = "regexp_matches({0}, '[A-Za-z]') AND NOT regexp_matches({0}, '[぀-ヿ㐀-鿿가-힯]')"


def clock(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def query(sql: str | None = None, *starts: str):
    """Registers a function under its name; sql may start from the views."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH RECURSIVE {', '.join(starts)}" if starts else ""  # sql may go on with views of its own after a comma
            ORACLE_SQL[f.__name__] = head + ("" if sql.startswith(",") else "\n") + sql
        return f

    return put
