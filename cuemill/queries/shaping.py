"""Queries of segment restructuring, batching and model calls."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import batching as E, segments as D
from ..session import table
from ..sources import views
from ._registry import CUES, ENGLISH, MEDIA, MIXED, SEGMENTS, query

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_MARKS = "'[^.!?' || chr(10) || ']*[.!?' || chr(10) || ']|[^.!?' || chr(10) || ']+'"
_PIECES = "'(?s).{1,40}\\z|.{0,39}[.!?' || chr(10) || ']|.{0,39}[;:]|.{0,39}[,]|.{1,40} |.{1,40}'"
_CJK_PIECES = "'(?s).{1,40}\\z|.{0,39}[。！？!?…' || chr(10) || ']|.{0,39}[；;]|.{0,39}[，,、]|.{1,40} |.{1,40}'"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments_of(views.cues(spark, sf_dir))


@query("SELECT media_id, chunk_no, seg_no, start_ms + chunk_no * 1000 AS start_ms, end_ms + chunk_no * 1000 AS end_ms, text FROM v_segments", SEGMENTS)
def d1_shift_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir)
    chunks = s.select("media_id", "chunk_no").distinct().withColumn("offset_ms", F.col("chunk_no").cast("long") * 1000)
    return D.shift_chunks(s, chunks).select("media_id", "chunk_no", "seg_no", "start_ms", "end_ms", "text")


@query(
    """, a AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, chunk_no, seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_segments),
b AS (SELECT *, sum(CASE WHEN latest IS NULL OR start_ms >= latest THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, chunk_no, seg_no ROWS UNBOUNDED PRECEDING) AS span FROM a),
c AS (SELECT *, min(start_ms) OVER (PARTITION BY media_id, span) AS first_ms, row_number() OVER (PARTITION BY media_id, span ORDER BY start_ms, chunk_no, seg_no) AS n FROM b)
SELECT media_id, CAST(span AS INTEGER) AS seg_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max_by(text, n) FILTER (WHERE n = 1 OR end_ms - start_ms > latest - first_ms) AS text, count(*) AS parts FROM c GROUP BY media_id, span""".lstrip(),
    SEGMENTS,
)
def d2_combine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.combine_chunks(views.segments(spark, sf_dir)).select("media_id", "seg_no", "start_ms", "end_ms", "text", "parts")


@query(
    """, g AS (SELECT *, sum(CASE WHEN end_ms > start_ms THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY cue_no ROWS UNBOUNDED PRECEDING) AS grp FROM v_cues)
SELECT media_id, min(cue_no) AS seg_no, min_by(start_ms, cue_no) AS start_ms, min_by(end_ms, cue_no) AS end_ms, string_agg(text, ' ' ORDER BY cue_no) AS text FROM g WHERE grp > 0 GROUP BY media_id, grp""",
    CUES,
)
def d3_absorb_zero_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.absorb_zero_length(_segments(spark, sf_dir)).select("media_id", "seg_no", "start_ms", "end_ms", "text")


@query(f"SELECT media_id, cue_no, array_to_string(regexp_extract_all(text, {_MARKS}), '|') AS pieces FROM v_cues WHERE {ENGLISH.format('text')} UNION ALL SELECT media_id, cue_no, array_to_string(regexp_extract_all(text, '[^。！？!?…]*[。！？!?…]|[^。！？!?…]+'), '|') FROM v_cues WHERE NOT ({ENGLISH.format('text')})", CUES)
def d5_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).select("media_id", "cue_no", F.array_join(D.split_sentences(F.lit("auto"), F.col("text")), "|").alias("pieces"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, CASE WHEN {ENGLISH.format('text')} THEN {_PIECES} ELSE {_CJK_PIECES} END), '|') AS pieces FROM documents WHERE text IS NOT NULL".replace(f"regexp_extract_all(text, CASE WHEN {ENGLISH.format('text')} THEN {_PIECES} ELSE {_CJK_PIECES} END)", f"CASE WHEN {ENGLISH.format('text')} THEN regexp_extract_all(text, {_PIECES}) ELSE regexp_extract_all(text, {_CJK_PIECES}) END"))
def d6_d7_split_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by marks, else after spaces, else hard; the pieces make up the whole text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(D.split_semantic(F.lit("auto"), F.col("text")), "|").alias("pieces"))


@query()
def d8_split_english_phrase_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that marks alone do not cut."""
    c = views.cues(spark, sf_dir)
    text, auto = F.col("text"), F.lit("auto")
    hard = c.where((F.length(text) > 40) & X.is_english(auto, text) & (F.array_join(D.split_semantic(auto, text, hard=False), "") != text))
    return hard.select("media_id", "cue_no", F.posexplode(D.split_english_phrase_safe(text)).alias("pos", "piece"))


_CJK_MARKS = "'[^。！？!?…]*[。！？!?…]|[^。！？!?…]+'"
_PIECE = f"p0 AS (SELECT media_id, cue_no, start_ms, end_ms, text, CASE WHEN {ENGLISH.format('text')} THEN regexp_extract_all(text, {_MARKS}) ELSE regexp_extract_all(text, {_CJK_MARKS}) END AS l FROM v_mixed), p AS (SELECT media_id, cue_no, start_ms, end_ms, text, unnest(l) AS piece, generate_subscripts(l, 1) AS piece_no FROM p0)"
_CHAIN = "SELECT media_id, cue_no, CAST(piece_no AS INTEGER) AS piece_no, piece, CAST(floor((least(start_ms * 1000 + upto - own, end_ms * 1000) + 500) / 1000) AS BIGINT) AS start_ms, CAST(floor((least(start_ms * 1000 + upto, end_ms * 1000) + 500) / 1000) AS BIGINT) AS end_ms FROM u"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.mixed_cues(spark, sf_dir)
    return c.select("media_id", "cue_no", "start_ms", "end_ms", "text", F.posexplode(D.split_sentences(F.lit("auto"), F.col("text"))).alias("_p", "piece")).withColumn("piece_no", F.col("_p") + 1).drop("_p")


@query(
    """, s AS (SELECT *, CAST(least(floor(length(piece) * (end_ms - start_ms) * 1000 / sum(length(piece)) OVER (PARTITION BY media_id, cue_no)), 7000000) AS BIGINT) AS own FROM p),
u AS (SELECT *, CAST(sum(own) OVER (PARTITION BY media_id, cue_no ORDER BY piece_no) AS BIGINT) AS upto FROM s) """ + _CHAIN,
    CUES,
    MIXED,
    _PIECE,
)
def d9_time_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.time_by_share(_sentences(spark, sf_dir), ["media_id", "cue_no"]).select("media_id", "cue_no", "piece_no", "piece", "start_ms", "end_ms")


@query(
    """, m AS (SELECT *, CAST(floor(length(piece) * 1000000 / (CASE WHEN regexp_matches(piece, '[぀-ヿ㐀-鿿가-힯]') THEN 10 WHEN regexp_matches(piece, '[A-Za-z]') THEN 17 ELSE 18 END)) AS BIGINT) AS least_us, CAST(floor(length(piece) * ((end_ms - start_ms) * 1000) / length(text)) AS BIGINT) AS share FROM p),
r AS (SELECT *, sum(least_us) OVER (PARTITION BY media_id, cue_no) <= (end_ms - start_ms) * 1000 AS room FROM m),
s AS (SELECT *, least(CASE WHEN room THEN greatest(share, least_us) ELSE share END, 7000000) AS own FROM r),
u AS (SELECT *, CAST(sum(own) OVER (PARTITION BY media_id, cue_no ORDER BY piece_no) AS BIGINT) AS upto FROM s) """ + _CHAIN,
    CUES,
    MIXED,
    _PIECE,
)
def d10_time_by_reading_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _sentences(spark, sf_dir).withColumn("total_chars", F.length("text")).withColumn("lang", F.lit("auto"))
    return D.time_by_reading_speed(pieces, ["media_id", "cue_no"]).select("media_id", "cue_no", "piece_no", "piece", "start_ms", "end_ms")


_JOINED = f"{_STRIP.format(chr(40) + 'regexp_replace(r.t, ' + chr(39) + chr(92) + 's+$' + chr(39) + ', ' + chr(39) * 2 + ') || CASE WHEN ' + ENGLISH.format('(r.t || chr(32) || m.text)') + ' THEN chr(32) ELSE ' + chr(39) * 2 + ' END || regexp_replace(m.text, ' + chr(39) + '^' + chr(92) + 's+' + chr(39) + ', ' + chr(39) * 2 + ')' + chr(41))}"


@query(
    f""", q AS (SELECT media_id, cue_no, start_ms // 10 AS start_ms, end_ms // 10 AS end_ms, CAST(length(text) AS VARCHAR) || ' ' || right(text, 1) AS text FROM v_cues),
o AS (SELECT *, lag(end_ms) OVER w AS pe, lag(text) OVER w AS pt FROM q WINDOW w AS (PARTITION BY media_id ORDER BY cue_no)),
m AS (SELECT media_id, cue_no, start_ms, end_ms, text, pe IS NULL OR start_ms - pe > 350 OR start_ms - pe < -50
  OR CASE WHEN {ENGLISH.format('pt')} THEN regexp_matches(pt, '[.!?\\n]\\s*$') ELSE regexp_matches(pt, '[。！？!?…\\n]\\s*$') END AS new FROM o),
r AS (SELECT media_id, cue_no AS n, cue_no AS head, start_ms AS s, end_ms AS e, text AS t FROM m WHERE cue_no = 1 UNION ALL
SELECT media_id, n, CASE WHEN fits THEN head ELSE n END, CASE WHEN fits THEN s ELSE ns END, ne, CASE WHEN fits THEN joined ELSE nt END FROM
  (SELECT r.media_id, m.cue_no AS n, r.head, r.s, m.start_ms AS ns, m.end_ms AS ne, m.text AS nt, {_JOINED} AS joined,
    NOT m.new AND (m.end_ms - m.start_ms < 800 OR r.e - r.s < 800) AND length({_JOINED}) <= 40 AS fits FROM r JOIN m ON m.media_id = r.media_id AND m.cue_no = r.n + 1))
SELECT media_id, head AS seg_no, max_by(s, n) AS start_ms, max_by(e, n) AS end_ms, max_by(t, n) AS text, 'auto' AS lang FROM r GROUP BY media_id, head""",
    CUES,
)
def d11_merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, told by their length and last sign, on a fast timeline, so that many cues are short."""
    c = views.cues(spark, sf_dir)
    times = [F.floor(F.col(t) / 10).alias(t) for t in ("start_ms", "end_ms")]
    return D.merge_short(c.select("media_id", F.col("cue_no").alias("seg_no"), *times, F.concat_ws(" ", F.length("text").cast("string"), F.substring("text", -1, 1)).alias("text"), F.lit("auto").alias("lang")))


@query()
def d12_split_for_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_for_srt(_segments(spark, sf_dir)).select("media_id", "cue_no", "start_ms", "end_ms", "text")


@query("SELECT media_id, seg_no, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seg_no) AS INTEGER) AS cue_no FROM v_segments", SEGMENTS)
def d13_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.renumber(views.segments(spark, sf_dir)).select("media_id", "seg_no", "cue_no")


@query("SELECT media_id, CAST(c AS INTEGER) AS chunk_no, c * csize AS offset_ms, least(csize, duration_ms - c * csize) AS length_ms FROM (SELECT *, unnest(range(CAST(greatest(ceil(duration_ms / csize), 1) AS BIGINT))) AS c FROM (SELECT *, CASE WHEN duration_ms <= greatest(30, duration_ms // 4000) * 1000 THEN greatest(duration_ms, 1) ELSE greatest(30, duration_ms // 4000) * 1000 END AS csize FROM v_media))", MEDIA)
def e1_plan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.plan_chunks(views.media(spark, sf_dir).select("media_id", "duration_ms"))


@query("SELECT media_id, cue_no, CAST((row_number() OVER (PARTITION BY media_id ORDER BY cue_no) - 1) // 5 AS INTEGER) AS batch_no, CAST((row_number() OVER (PARTITION BY media_id ORDER BY cue_no) - 1) % 5 AS INTEGER) AS pos FROM v_cues", CUES)
def e2_batch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_fixed(views.cues(spark, sf_dir), 5).select("media_id", "cue_no", "batch_no", "pos")


@query("SELECT media_id, cue_no, CAST((row_number() OVER (PARTITION BY media_id ORDER BY cue_no) - 1) // 4 AS INTEGER) AS batch_no, CAST((row_number() OVER (PARTITION BY media_id ORDER BY cue_no) - 1) % 4 AS INTEGER) AS pos FROM v_cues WHERE cue_no % 6 <> 0", CUES)
def e3_batch_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth line is blank."""
    c = views.cues(spark, sf_dir).withColumn("text", F.when(F.col("cue_no") % 6 == 0, " ").otherwise(F.col("text")))
    return E.batch_nonempty(c, 4).select("media_id", "cue_no", "batch_no", "pos")


@query("SELECT media_id, cue_no, CASE WHEN cue_no % 6 = 0 THEN '' ELSE text END AS sent, cue_no % 6 <> 0 AS is_sent FROM v_cues", CUES)
def c2_non_empty_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines keep their place and come back empty."""
    c = views.cues(spark, sf_dir).withColumn("text", F.when(F.col("cue_no") % 6 == 0, " ").otherwise(F.col("text")))
    sent = E.batch_nonempty(c).select("media_id", "cue_no", F.col("text").alias("_sent"))
    return c.join(sent, ["media_id", "cue_no"], "left").select("media_id", "cue_no", F.coalesce("_sent", F.lit("")).alias("sent"), F.col("_sent").isNotNull().alias("is_sent"))


@query(
    """, c AS (SELECT media_id, cue_no, greatest(1, length(text) // 2) + 10 AS cost FROM v_cues),
r AS (SELECT media_id, cue_no, 0 AS batch_no, cost AS used FROM c WHERE cue_no = 1 UNION ALL
SELECT c.media_id, c.cue_no, r.batch_no + CASE WHEN r.used + c.cost > 400 THEN 1 ELSE 0 END, c.cost + CASE WHEN r.used + c.cost > 400 THEN 0 ELSE r.used END FROM r JOIN c ON c.media_id = r.media_id AND c.cue_no = r.cue_no + 1)
SELECT media_id, cue_no, CAST(batch_no AS INTEGER) AS batch_no FROM r""",
    CUES,
)
def e4_batch_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_by_budget(views.cues(spark, sf_dir))


_BATCH = "b AS (SELECT *, (cue_no - 1) // 4 AS batch_no, (cue_no - 1) % 4 AS pos, count(*) OVER (PARTITION BY media_id, (cue_no - 1) // 4) AS size FROM v_cues)"


@query(f", {_BATCH} SELECT media_id, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS lines, CASE WHEN count(*) > 1 THEN '{E.TEMPLATE}' ELSE '' END || string_agg(CASE WHEN size > 1 THEN (pos + 1) || '. ' ELSE '' END || text, chr(10) ORDER BY pos) AS request_text FROM b GROUP BY media_id, batch_no", CUES)
def e5_pack_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pack_numbered(E.batch_fixed(views.cues(spark, sf_dir), 4)).select("media_id", "batch_no", "lines", "request_text")


@query(f", {_BATCH} SELECT media_id, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS lines, string_agg(text, chr(10) ORDER BY pos) AS request_text FROM b GROUP BY media_id, batch_no", CUES)
def e6_pack_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pack_newline(E.batch_fixed(views.cues(spark, sf_dir), 4)).select("media_id", "batch_no", "lines", "request_text")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered replies to batches of four lines: each 17th cue's number is lost, each 13th comes twice."""
    b = E.batch_fixed(views.cues(spark, sf_dir), 4).withColumn("_cue", F.col("cue_no"))
    number = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "))
    line = F.when(F.col("_cue") % 17 == 0, "lost").when(F.col("_cue") % 13 == 0, F.concat(number, F.col("text"), F.lit("\n"), number, F.lit("again"))).otherwise(F.concat(number, F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"])
    return b.groupBy("media_id", "batch_no").agg(F.count("*").alias("expected"), F.array_join(F.concat(F.array(F.lit("Here you are:")), lines), "\n").alias("reply"))


@query(f", {_BATCH} SELECT media_id, CAST(batch_no AS INTEGER) AS batch_no, CAST(pos AS INTEGER) AS pos, {_STRIP.format('text')} AS translation FROM b WHERE (media_id, batch_no) NOT IN (SELECT media_id, batch_no FROM b WHERE cue_no % 17 = 0)", CUES)
def e7_parse_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parse_numbered(_replies(spark, sf_dir))


@query(f", {_BATCH} SELECT media_id, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS expected, CAST(count(*) FILTER (WHERE cue_no % 17 <> 0) AS INTEGER) AS received FROM b GROUP BY media_id, batch_no HAVING count(*) <> count(*) FILTER (WHERE cue_no % 17 <> 0)", CUES)
def e8_alignment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.batch_fixed(views.cues(spark, sf_dir), 4)
    replies = b.groupBy("media_id", "batch_no").agg(F.count("*").alias("expected"), F.collect_list(F.when(F.col("cue_no") % 17 != 0, F.col("text"))).alias("texts"))
    return E.alignment_guard(replies)[1]


@query(f", {_BATCH}, f AS (SELECT *, size // 2 AS half FROM b WHERE size > 1 AND (media_id, batch_no) IN (SELECT media_id, batch_no FROM b WHERE cue_no % 17 = 0)) SELECT media_id, cue_no, CAST(batch_no * 2 + CASE WHEN pos >= half THEN 1 ELSE 0 END AS BIGINT) AS batch_no, CAST(CASE WHEN pos >= half THEN pos - half ELSE pos END AS INTEGER) AS pos FROM f", CUES)
def e9_halve_failed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.batch_fixed(views.cues(spark, sf_dir), 4)
    failed = b.where("cue_no % 17 = 0").select("media_id", "batch_no").distinct()
    return E.halve_failed_groups(b.join(failed, ["media_id", "batch_no"])).select("media_id", "cue_no", "batch_no", "pos")


@query("SELECT media_id, cue_no, CASE WHEN cue_no % 3 = 0 THEN text ELSE '> ' || text END AS translation FROM v_cues", CUES)
def e10_merge_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cues(spark, sf_dir)
    some = c.where("cue_no % 3 <> 0").select("media_id", "cue_no", F.concat(F.lit("> "), "text").alias("translation"))
    return E.merge_translations(c, some).select("media_id", "cue_no", "translation")


@query("SELECT media_id, cue_no, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w = 'the' THEN 'le' WHEN w = 'and' THEN 'et' ELSE w END), ' ') AS translation FROM v_cues", CUES)
def e11_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = E.translate(views.cues(spark, sf_dir), lambda: E.provider("glossary", words={"the": "le", "and": "et"}), "en", "fr", workers=4)
    return done.select("media_id", "cue_no", "translation")


class _Strict(E.Glossary):
    """Refuses batches with a long line, and loses a line of those that are long together."""

    batch_size = 8
    longest, together = 400, 500

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        if max(map(len, texts)) > self.longest:
            raise E.TransientError("line too long")
        out = super().translate_batch(texts, source, target)
        return out[1:] if len(texts) > 1 and sum(map(len, texts)) > self.together else out


@query("SELECT media_id, cue_no, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w = 'the' THEN 'le' ELSE w END), ' ') AS translation FROM v_cues WHERE media_id NOT IN (SELECT media_id FROM v_cues WHERE length(text) > 400)", CUES)
def e11_translate_with_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that refuses some lines, whose media items are lost, and drops lines of long requests, which are halved."""
    done, _ = E.translate(views.cues(spark, sf_dir), lambda: _Strict({"the": "le"}), "en", "fr", halve=True, delay_s=0, workers=4)
    return done.select("media_id", "cue_no", "translation")


@query("SELECT media_id, CAST(1 AS BIGINT) AS sent FROM v_cues GROUP BY media_id", CUES)
def u4_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that refuses everything is asked once for each media item."""
    refuse = lambda: _Refusing({})
    _, attempts = E.translate(views.cues(spark, sf_dir), refuse, "en", "fr", workers=4)
    return attempts.groupBy("media_id").agg(F.count("*").alias("sent"))


class _Refusing(_Strict):
    longest = -1


def _listen(text: str, offset: int, length: int, options: dict) -> tuple[list, str]:
    """Reads a document as if it were audio of 60 ms a character: the words of a chunk in two segments."""
    own = text[offset // views.MS_PER_CHAR : (offset + length) // views.MS_PER_CHAR]
    if not re.search("[A-Za-z]", own):
        raise RuntimeError("no speech")
    half = len(own) // 2
    middle = offset + half * views.MS_PER_CHAR
    return [(offset, middle, own[:half], -0.1), (middle, offset + length, own[half:], -0.2)], "en" if " the " in own else "xx"


_HEARD = """v_chunks AS (SELECT media_id, doc_id, CAST(c AS INTEGER) AS chunk_no, c * csize AS a, least(csize, duration_ms - c * csize) AS l FROM (SELECT *, unnest(range(CAST(greatest(ceil(duration_ms / csize), 1) AS BIGINT))) AS c
  FROM (SELECT *, CASE WHEN duration_ms <= greatest(30, duration_ms // 4000) * 1000 THEN greatest(duration_ms, 1) ELSE greatest(30, duration_ms // 4000) * 1000 END AS csize FROM v_media))),
v_heard AS (SELECT media_id, chunk_no, substr(text, a // 60 + 1, (a + l) // 60 - a // 60) AS own FROM v_chunks JOIN documents USING (doc_id) WHERE text IS NOT NULL)"""


def _heard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the documents, and what was heard in them."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("media_id"), "text")
    planned = E.plan_chunks(views.media(spark, sf_dir).select("media_id", "duration_ms").join(texts, "media_id"))
    return planned, E.transcribe(planned, lambda: _listen, reference="text")


@query("SELECT media_id, chunk_no, CASE WHEN regexp_matches(own, '[A-Za-z]') THEN CASE WHEN contains(own, ' the ') THEN 'en' ELSE 'xx' END END AS language, CASE WHEN regexp_matches(own, '[A-Za-z]') THEN md5(own) END AS digest, CASE WHEN NOT regexp_matches(own, '[A-Za-z]') THEN 'no speech' END AS error FROM v_heard", MEDIA, _HEARD)
def e12_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as audio, through a recogniser that reads them."""
    results = _heard(spark, sf_dir)[1]
    return results.select("media_id", "chunk_no", "language", F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("digest"), "error")


@query("SELECT media_id, printf('%d/%d chunk(s) failed transcription: %s', CAST(count(*) FILTER (WHERE NOT regexp_matches(own, '[A-Za-z]')) AS BIGINT), CAST(count(*) AS BIGINT), 'no speech') AS message FROM v_heard GROUP BY media_id HAVING count(*) FILTER (WHERE NOT regexp_matches(own, '[A-Za-z]')) > 0", MEDIA, _HEARD)
def e12_chunk_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chunk_failures(E.missing_results(*_heard(spark, sf_dir)))


@query("SELECT media_id, cue_no, role, text FROM (SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(turn AS INTEGER) AS cue_no, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL) WHERE n <= 5")
def j11_first_k_per_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metrics

    return metrics.first_k(views.turns(spark, sf_dir)).select("media_id", "cue_no", "role", "text")
