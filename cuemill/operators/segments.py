"""Restructuring of timed segments, per media item: media_id, chunk_no, seg_no, start_ms, end_ms, text, lang.

All windows share partitionBy(media_id) and order by time, so a chain of operators needs one exchange. Times are whole
milliseconds; shares of a span are taken in microseconds and rounded at the end.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X, vocab
from .scan import Scan

STRONG = {True: r"[.!?\n]", False: "[。！？!?…\\n]"}
MEDIUM = {True: "[;:]", False: "[；;]"}
WEAK = {True: "[,]", False: "[，,、]"}


def shift_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds each chunk's offset to its segments' times. chunks: media_id, chunk_no, offset_ms."""
    moved = segments.join(chunks, ["media_id", "chunk_no"])
    return moved.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms")).drop("offset_ms")


def combine_chunks(segments: DataFrame, huge: bool = False) -> DataFrame:
    """Overlapping segments become one span: the end is the latest, the text that of the last segment which is longer
    than the span before it; texts that went are listed. huge: media items may have more segments than a task holds."""
    rows = Scan(segments, "media_id", ["start_ms", "chunk_no", "seg_no"], huge).add(before=True, _latest=("max", F.col("end_ms")))
    rows.df = rows.df.withColumn("_new", F.coalesce(F.col("start_ms") >= F.col("_latest"), F.lit(True)))
    # Starts rise, so the latest start of a span is where it begins.
    marked = rows.add(_span=("sum", F.col("_new").cast("long")), _from=("max", F.when(F.col("_new"), F.col("start_ms")))).done()
    wins = F.col("_new") | (F.col("end_ms") - F.col("start_ms") > F.col("_latest") - F.col("_from"))
    merged = marked.groupBy("media_id", "_span").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max_by("text", F.when(wins, F.struct("start_ms", "chunk_no", "seg_no"))).alias("text"), F.count("*").alias("parts")
    )
    return merged.withColumn("seg_no", F.col("_span").cast("int")).drop("_span")


def absorb_zero_length(segments: DataFrame, huge: bool = False) -> DataFrame:
    """A segment without duration adds its text to the segment before; at the start of a media item it goes. huge: media
    items may have more segments than a task holds."""
    held = Scan(segments, "media_id", ["seg_no"], huge).add(_group=("sum", (F.col("end_ms") > F.col("start_ms")).cast("int"))).done().where("_group > 0")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"]), " ")
    first = [F.min_by(c, "seg_no").alias(c) for c in segments.columns if c not in ("media_id", "seg_no", "text")]
    return held.groupBy("media_id", "_group").agg(F.min("seg_no").alias("seg_no"), texts.alias("text"), *first).drop("_group")


def sentence_marks(lang: Column, text: Column) -> Column:
    return F.when(X.is_english(lang, text), F.regexp_count(text, F.lit(STRONG[True]))).otherwise(F.regexp_count(text, F.lit(STRONG[False])))


def needs_split(lang: Column, text: Column, start: Column, end: Column) -> Column:
    return ~((end - start <= vocab.MAX_CUE_MS) & (F.length(text) <= vocab.MAX_CHARS) & (sentence_marks(lang, text) <= 1))


def split_sentences(lang: Column, text: Column) -> Column:
    """Pieces that end with a sentence mark each, and the rest."""
    of = lambda e: F.regexp_extract_all(text, F.lit(f"[^{STRONG[e][1:-1]}]*{STRONG[e]}|[^{STRONG[e][1:-1]}]+"), F.lit(0))
    return F.when(X.is_english(lang, text), of(True)).otherwise(of(False))


def _semantic(english: bool, most: int, hard: bool) -> str:
    tail = rf"|.{{1,{most}}} |.{{1,{most}}}" if hard else ""
    return rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}{STRONG[english]}|.{{0,{most - 1}}}{MEDIUM[english]}|.{{0,{most - 1}}}{WEAK[english]}" + tail


def split_semantic(lang: Column, text: Column, most: int = vocab.MAX_CHARS, hard: bool = True) -> Column:
    """Pieces of at most so many characters, each cut after its last strong, medium or weak mark. Where none is in
    reach: after the last space, else anywhere (hard). Without hard, such stretches are left out, so a caller must
    compare the joined pieces with the text."""
    of = lambda e: F.regexp_extract_all(text, F.lit(_semantic(e, most, hard)), F.lit(0))
    return F.when(X.is_english(lang, text), of(True)).otherwise(of(False))


class PhraseBreaks:
    """English line breaks that part no protected phrase and leave no function word behind.

    One pass over a text's words grades every boundary between two of them; lines are then cut one after another, each
    with a choice among the gaps of a bounded window."""

    #: Grades of a gap: a function word stands before it or a phrase spans it; one begins the next line; neither.
    NONE, LOOSE, STRICT = range(3)

    def __init__(self, most: int = vocab.MAX_CHARS):
        self.most, self.reach = most, most + vocab.PHRASE_OVERFLOW
        self.space, self.word = re.compile(r"\s+"), re.compile(r"[A-Za-z']+")
        self.function = frozenset(vocab.FUNCTION_WORDS)
        self.phrases: dict[str, list[list[str]]] = {}
        for words in map(str.split, vocab.PROTECTED_PHRASES):
            self.phrases.setdefault(words[0], []).append(words)

    def _grades(self, words: list[str]) -> tuple[list[int], list[int]]:
        """For the boundary before each word: its grade but for phrases, and where the last phrase across it begins."""
        plain = [self.STRICT] + [self.NONE if a in self.function else self.LOOSE if b in self.function else self.STRICT for a, b in zip(words, words[1:])] + [self.STRICT]
        across = [-1] * len(plain)
        for i, w in enumerate(words):
            for phrase in self.phrases.get(w, ()):
                if words[i : i + len(phrase)] == phrase:
                    across[i + 1 : i + len(phrase)] = [i] * (len(phrase) - 1)
        return plain, across

    def _ranked(self, far: int, grade: int) -> tuple[int, int]:
        """How good a gap is as the end of a line, far characters from its start; the highest wins."""
        if far > self.most:
            return (4, -far) if grade == self.STRICT else (0, 0)
        if grade == self.STRICT and far >= 0.75 * self.most:
            return 3, far
        return (2, far) if grade != self.NONE else (0, 0)

    def split(self, text: str) -> list[str]:
        text = text.strip()
        found = list(self.word.finditer(text))
        plain, across = self._grades([m[0].lower() for m in found])
        starts, gaps = [m.start() for m in found], [m.span() for m in self.space.finditer(text)]
        before = [bisect.bisect_left(starts, a) for a, _ in gaps]  # words before each gap
        out, at, g = [], 0, 0
        while len(text) - at > self.most:
            first = bisect.bisect_left(starts, at)

            def grade(i: int) -> int:
                w = before[i]
                if w in (first, len(starts)):  # no words on one side
                    return self.STRICT
                return self.NONE if across[w] >= first else plain[w]

            best, chosen, i = (0, 0), None, g
            while i < len(gaps) and gaps[i][0] - at <= self.reach:
                rank = self._ranked(gaps[i][0] - at, grade(i))
                if rank > best:
                    best, chosen = rank, i
                i += 1
            if chosen is None:
                chosen = next((j for j in range(g, len(gaps)) if gaps[j][0] - at > self.most and grade(j) != self.NONE), None)
            if chosen is None:
                break
            out.append(text[at : gaps[chosen][0]])
            at, g = gaps[chosen][1], chosen + 1
        return [*out, text[at:]] if text else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _phrase_safe(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    breaks = PhraseBreaks()
    for batch in texts:
        yield batch.map(lambda t: None if t is None else breaks.split(t))


def split_english_phrase_safe(text: Column) -> Column:
    """Runs Python; keep it behind a filter for texts that marks alone do not cut."""
    return _phrase_safe(text)


def _parent(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def _share(keys: tuple = ("media_id", "seg_no")) -> Column:
    """Microseconds of a piece by its share of the pieces' length."""
    return F.floor(F.length("piece").cast("long") * (F.col("end_ms") - F.col("start_ms")) * 1000 / F.sum(F.length("piece")).over(_parent(keys)))


def _speed(keys: tuple = ("media_id", "seg_no")) -> Column:
    """Microseconds by its share of the parent's text, but what it takes to read if the parent can hold that for all."""
    span = (F.col("end_ms") - F.col("start_ms")) * 1000
    least = F.floor(F.length("piece").cast("long") * 1000000 / X.reading_speed(F.col("lang"), F.col("piece"))).cast("long")
    share = F.floor(F.length("piece").cast("long") * span / F.col("total_chars")).cast("long")
    return F.when(F.sum(least).over(_parent(keys)) <= span, F.greatest(share, least)).otherwise(share)


def time_by_share(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces: keys of the parent, piece_no, piece, start_ms, end_ms of the parent. Each piece gets its share of the
    parent's time by length, 7 s at most, one after another, within the parent."""
    return _timed(pieces.where("piece <> ''"), keys, _share(tuple(keys)))


def time_by_reading_speed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """As time_by_share, but a piece gets the time it takes to read if the parent can hold that for all. pieces also has
    total_chars (of the parent's text) and lang."""
    return _timed(pieces, keys, _speed(tuple(keys)))


def _timed(pieces: DataFrame, keys: list[str], own: Column) -> DataFrame:
    """pieces with own times, one after another from the parent's start; where own is null, the parent's times."""
    capped = pieces.withColumn("_own", F.least(own, F.lit(vocab.MAX_CUE_MS * 1000)).cast("long"))
    upto = F.sum("_own").over(_parent(keys).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begin, end = F.col("start_ms") * 1000, F.col("end_ms") * 1000
    ms = lambda us: F.floor((us + 500) / 1000).cast("long")
    from_us, to_us = F.least(begin + F.col("_upto") - F.col("_own"), end), F.least(begin + F.col("_upto"), end)
    timed = capped.withColumn("_upto", upto).select("*", F.when(F.col("_own").isNull(), F.col("start_ms")).otherwise(ms(from_us)).alias("_b"), F.when(F.col("_own").isNull(), F.col("end_ms")).otherwise(ms(to_us)).alias("_e"))
    return timed.drop("_own", "_upto", "start_ms", "end_ms").withColumnsRenamed({"_b": "start_ms", "_e": "end_ms"})


def merge_islands(cues: DataFrame) -> DataFrame:
    """Adds island: runs of cues without a pause or a sentence end between neighbours."""
    order = Window.partitionBy("media_id").orderBy("seg_no")
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    before = F.lag("text").over(order)
    ends = F.when(X.is_english(F.lag("lang").over(order), before), before.rlike(r"[.!?\n]\s*$")).otherwise(before.rlike("[。！？!?…\\n]\\s*$"))
    new = (gap > vocab.MAX_MERGE_GAP_MS) | (gap < vocab.MIN_MERGE_GAP_MS) | ends
    return cues.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


_CUE = T.StructType([T.StructField("seg_no", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@F.pandas_udf(T.ArrayType(_CUE))
def _folded(seg_no: pd.Series, start: pd.Series, end: pd.Series, text: pd.Series, lang: pd.Series, latin: pd.Series, cjk: pd.Series) -> pd.Series:
    """The cues of islands, short neighbours joined. latin and cjk: whether each text has such letters."""
    seam_left, seam_right, ends = re.compile(r"\s+\Z"), re.compile(r"\A\s+"), re.compile(r"\A\s+|\s+\Z")

    def fold(rows: list[tuple]) -> list[dict]:
        done: list[list] = []
        for number, a, b, t, code, has_latin, has_cjk in rows:
            if done:
                last = done[-1]
                english = last[4] == "en" or last[4] == "auto" and (last[5] or has_latin) and not (last[6] or has_cjk)
                joined = ends.sub("", seam_left.sub("", last[3]) + (" " if english else "") + seam_right.sub("", t))
                if len(joined) <= vocab.MAX_CHARS and (b - a < vocab.MIN_CUE_MS or last[2] - last[1] < vocab.MIN_CUE_MS):
                    last[2], last[3], last[5], last[6] = b, joined, last[5] or has_latin, last[6] or has_cjk
                    continue
            done.append([number, a, b, t, code, has_latin, has_cjk])
        return [dict(zip(_CUE.names, d)) for d in done]

    return pd.Series([None if row[0] is None else fold(list(zip(*map(list, row)))) for row in zip(seg_no, start, end, text, lang, latin, cjk)])


def merge_short(cues: DataFrame) -> DataFrame:
    """Neighbours become one cue if either is short, the joined text fits a line, and they share an island. One pass over
    each island's cues, which pauses keep small."""
    marked = merge_islands(cues).select("media_id", "island", F.struct(F.col("seg_no").cast("int").alias("seg_no"), "start_ms", "end_ms", "text", "lang", X.has_latin(F.col("text")).alias("latin"), X.has_cjk(F.col("text")).alias("cjk")).alias("_c"))
    held = marked.groupBy("media_id", "island").agg(F.array_sort(F.collect_list("_c")).alias("_cues"))
    several = lambda c: F.when(F.size("_cues") > 1, F.col(f"_cues.{c}"))  # noqa: E731  null for islands of one cue, which stay
    alone = F.transform("_cues", lambda c: F.struct(*[c[n].alias(n) for n in _CUE.names]))
    folded = held.withColumn("_joined", _folded(*map(several, (*_CUE.names, "latin", "cjk"))))
    return folded.select("media_id", F.explode(F.coalesce("_joined", alone)).alias("_c")).select("media_id", "_c.*")


def split_for_srt(segments: DataFrame) -> DataFrame:
    """Readable cues of raw segments: zero lengths absorbed, sentences and long stretches split, times dealt, short
    neighbours merged, numbered from 1."""
    base = absorb_zero_length(segments.select("media_id", "seg_no", "start_ms", "end_ms", "text", "lang")).withColumn("lang", X.speed_language(F.col("lang")))
    lang, text = F.col("lang"), F.col("text")
    split = needs_split(lang, text, F.col("start_ms"), F.col("end_ms"))
    base = base.withColumn("_how", F.when(~split, "keep").when(sentence_marks(lang, text) > 0, "sentence").otherwise("length"))
    sentence = base.select("*", F.posexplode(F.when(F.col("_how") == "sentence", split_sentences(lang, text)).otherwise(F.array(text))).alias("_s", "_sentence"))
    own = F.col("_sentence")
    long = (F.col("_how") != "keep") & (F.length(own) > vocab.MAX_CHARS)
    # Cut by marks where that keeps the whole text, else hard, or in English at phrase-safe places: null here, as that
    # runs Python for these lines only.
    marked = X.let(split_semantic(lang, own, hard=False), lambda m: F.when(F.array_join(m, "") == own, m).when(X.is_english(lang, own), F.lit(None)).otherwise(split_semantic(lang, own)))
    sentence = sentence.withColumn("_cut", F.when(~long, F.array(own)).otherwise(marked))
    sentence = sentence.withColumn("_safe", split_english_phrase_safe(F.when(F.col("_cut").isNull(), own)))
    pieces = sentence.select("*", F.posexplode(F.coalesce("_cut", "_safe")).alias("_p", "piece")).withColumn("total_chars", F.length("text"))
    pieces = pieces.withColumn("piece_no", F.col("_s").cast("long") * 1000000 + F.col("_p")).drop("_safe", "_cut", "_sentence", "_s", "_p")
    timed = _timed(pieces.where("_how <> 'sentence' or piece <> ''"), ["media_id", "seg_no"], F.when(F.col("_how") == "sentence", _share()).when(F.col("_how") == "length", _speed()))
    order = Window.partitionBy("media_id").orderBy("seg_no", "piece_no")
    cues = timed.select("media_id", "seg_no", "piece_no", "start_ms", "end_ms", X.strip(F.col("piece")).alias("text"), "lang").where("text <> ''")
    cues = cues.withColumn("_n", F.row_number().over(order)).drop("seg_no", "piece_no").withColumnRenamed("_n", "seg_no")
    return renumber(merge_short(cues))


def renumber(cues: DataFrame) -> DataFrame:
    """cue_no from 1 in order."""
    return cues.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_no")))
