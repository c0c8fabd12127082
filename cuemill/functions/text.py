"""Scalar functions over columns: times, scripts, joins, names, replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import vocab

_CJK = "[぀-ヿ㐀-鿿가-힯]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def srt_ts_to_seconds(ts: Column) -> Column:
    """"HH:MM:SS,mmm" (or a point) as seconds; 1 to 3 digits are a decimal fraction."""
    part = F.split(F.replace(ts, F.lit(","), F.lit(".")), ":")
    return F.get(part, F.lit(0)).cast("double") * 3600 + F.get(part, F.lit(1)).cast("double") * 60 + F.get(part, F.lit(2)).cast("double")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def srt_ts_to_ms(ts: Column) -> Column:
    """Milliseconds of "HH:MM:SS,m", with 1 to 3 digits after the comma or point."""
    number = lambda at, n: F.substring(ts, at, n).cast("long")
    return ((number(1, 2) * 60 + number(4, 2)) * 60 + number(7, 2)) * 1000 + F.rpad(F.substring(ts, 10, 3), 3, "0").cast("long")


def _clock(whole: Column) -> list[Column]:
    return [(whole / 3600).cast("long"), (whole % 3600 / 60).cast("long"), whole % 60]


def format_ts_srt(seconds: Column, round_ms: bool = False) -> Column:
    """"HH:MM:SS,mmm"; milliseconds are cut off the double, or rounded."""
    if round_ms:
        return format_ms_srt(F.round(seconds * 1000).cast("long"))
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(whole), F.floor((seconds - whole) * 1000).cast("long"))


def format_ms_srt(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(F.floor(ms / 1000).cast("long")), ms % 1000)


def format_ts_md(seconds: Column) -> Column:
    return F.format_string("[%02d:%02d:%02d]", *_clock(F.floor(seconds).cast("long")))


def fold_lines(text: Column) -> Column:
    """A cue of several lines as one: lines stripped, blank ones dropped, joined by a space."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != ""), " ")


# What ends a line.
LINE_ENDS = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"


def flatten_request(text: Column) -> Column:
    """The text's lines joined by spaces; what ends the last line goes."""
    return F.regexp_replace(F.regexp_replace(text, LINE_ENDS + r"\z", ""), LINE_ENDS, " ")


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_cjk(text: Column) -> Column:
    return text.rlike(_CJK)


def is_english(lang: Column, text: Column) -> Column:
    """Whether English spacing rules hold: fixed by language, or by script for "auto"."""
    return F.when(lang == "en", True).when(lang != "auto", False).otherwise(text.rlike("[A-Za-z]") & ~text.rlike(_CJK))


def speed_language(lang: Column, compat: bool = False) -> Column:
    """The language whose reading rules hold. Others are inferred by script, or read as Japanese in compat mode."""
    return F.when(lang.isin(*vocab.SPEED_LANGUAGES), lang).otherwise("ja" if compat else "auto")


def reading_speed(lang: Column, text: Column) -> Column:
    out = F.when(lang == "auto", F.when(text.rlike(_CJK), vocab.READING_SPEED["ja"]).when(text.rlike("[A-Za-z]"), vocab.READING_SPEED["en"]).otherwise(vocab.DEFAULT_SPEED))
    for code, speed in vocab.READING_SPEED.items():
        out = out.when(lang == code, speed)
    return out.otherwise(vocab.DEFAULT_SPEED)


def join_separator(lang: Column, text: Column) -> Column:
    return F.when(is_english(lang, text), " ").otherwise("")


def join_text(lang: Column, left: Column, right: Column) -> Column:
    seam = join_separator(lang, F.concat_ws(" ", left, right))
    return strip(F.concat(F.regexp_replace(left, r"(?U)\s+$", ""), seam, F.regexp_replace(right, r"(?U)^\s+", "")))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def player_suffix(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in vocab.PLAYER_SUFFIX.items() for x in kv]), code), code)


def bilingual_suffix(code: Column) -> Column:
    return F.concat(F.lit("bilingual."), player_suffix(code))


def provider_code(scheme: str, code: Column) -> Column:
    lowered = F.lower(strip(F.coalesce(F.when(code != "", code), F.lit(vocab.PROVIDER_DEFAULT[scheme]))))
    codes = F.create_map(*[F.lit(x) for kv in vocab.PROVIDER_CODES[scheme].items() for x in kv])
    return F.coalesce(F.try_element_at(codes, lowered), lowered)


def clean_response(text: Column) -> Column:
    """A model's answer without its reasoning and one pair of equal quotes around it."""
    after = F.when(F.locate("</think>", text) > 0, F.substring(text, F.locate("</think>", text) + 8, F.length(text))).otherwise(text)
    bare = strip(F.regexp_replace(strip(after), r"^<think>", ""))
    quoted = (F.length(bare) >= 2) & (F.substring(bare, 1, 1) == F.substring(bare, -1, 1)) & F.substring(bare, 1, 1).isin(*"\"'`“”‘’")
    return F.when(quoted, strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def content_key(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", path, size.cast("string"), mtime.cast("string")).cast("binary")), 1, 10)


def duration_label(seconds: Column) -> Column:
    h, m, s = _clock(F.floor(seconds).cast("long"))
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm%02ds", m, s))


def stage_progress(stage: Column, fraction: Column) -> Column:
    """The job's progress at a fraction of a stage, both 0 to 1."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    start, end = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in vocab.STAGE_SPANS.items():
        start, end = F.when(stage == name, a).otherwise(start), F.when(stage == name, b).otherwise(end)
    return start + (end - start) * inside


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "[.]"), -1))


def classify_failure(status: Column, connection_error: Column | None = None) -> Column:
    hit = status.isin(*vocab.TRANSIENT)
    if connection_error is not None:
        hit = hit | connection_error
    return F.when(status == 200, "ok").when(hit, "transient").otherwise("permanent")
