from pyspark.sql import functions as F

from cuemill.functions import vocab
from cuemill.operators import segments as D

ROW = "media_id string, chunk_no int, seg_no int, start_ms long, end_ms long, text string, lang string"


def rows(spark, found):
    return spark.createDataFrame([("m", 0, i + 1, a, b, t, lang) for i, (a, b, t, lang) in enumerate(found)], ROW)


def split(spark, found):
    return [(r.start_ms, r.end_ms, r.text) for r in D.split_for_srt(rows(spark, found)).orderBy("cue_no").collect()]


def test_phrase_safe_breaks():
    breaks = D.PhraseBreaks(40)
    assert breaks.split("update to the luminary and i got a lot of tips and tricks") == ["update to the luminary and i got", "a lot of tips and tricks"]
    assert breaks.split("we are talking about the day one update for everyone")[0].endswith("the day one update")
    assert breaks.split("x" * 100) == ["x" * 100]


def test_breaks_part_no_phrase_and_lose_no_text():
    import random

    draw, breaks = random.Random(0), D.PhraseBreaks(40)
    words = [*vocab.FUNCTION_WORDS, "word", "subtitle", "x", "it's", "42", "--", "antidisestablishmentarianism"]
    for _ in range(300):
        text = " ".join(draw.choice(vocab.PROTECTED_PHRASES) if draw.random() < 0.2 else draw.choice(words) for _ in range(draw.randrange(60)))
        lines = breaks.split(text)
        assert " ".join(lines) == text
        for n, (line, after) in enumerate(zip(lines, lines[1:])):
            letters = any(c.isalpha() for c in " ".join(lines[n + 1 :]))
            assert line.split()[-1] not in vocab.FUNCTION_WORDS or not letters
            assert not any(line.endswith(" ".join(p.split()[:i])) and f"{after} ".startswith(" ".join(p.split()[i:]) + " ") and f" {line}".endswith(" " + " ".join(p.split()[:i])) for p in vocab.PROTECTED_PHRASES for i in range(1, len(p.split())))


def test_breaks_take_linear_time():
    import time

    began = time.time()
    assert len(D.PhraseBreaks(40).split("some words of a long text without marks " * 20_000)) > 10_000
    assert time.time() - began < 10


def test_short_parent_keeps_durations(spark):
    got = split(spark, [(4000, 5639, "this is a line of fifty seven characters and has no marks", "auto")])
    assert len(got) == 2 and all(b > a for a, b, _ in got) and got[-1][1] <= 5639


def test_short_neighbours_merge(spark):
    assert split(spark, [(0, 450, "uh", "en"), (450, 1200, "welcome everyone", "en")]) == [(0, 1200, "uh welcome everyone")]
    assert len(split(spark, [(0, 450, "Uh.", "en"), (450, 1200, "welcome everyone", "en")])) == 2
    assert len(split(spark, [(0, 450, "uh", "en"), (900, 1200, "welcome", "en")])) == 2


def test_sentences(spark):
    assert [t for *_, t in split(spark, [(0, 4000, "Hello. How are you?", "en")])] == ["Hello.", "How are you?"]
    assert [t for *_, t in split(spark, [(0, 4000, "こんにちは。元気ですか？", "ja")])] == ["こんにちは。", "元気ですか？"]


def test_text_is_conserved_and_cues_are_readable(spark):
    text = {"zh": "今天我们要介绍一个新的项目，" * 12, "ja": "これはとても長い文章です、" * 12, "en": "this is a long line without any stop that goes on, and on, for a while " * 4}
    for lang, body in text.items():
        got = split(spark, [(0, 60000, body, lang)])
        assert "".join(t for *_, t in got).replace(" ", "") == body.replace(" ", "")
        assert all(0 < len(t) <= vocab.MAX_CHARS + vocab.PHRASE_OVERFLOW and b - a <= vocab.MAX_CUE_MS and b <= 60000 for a, b, t in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_zero_lengths(spark):
    got = D.absorb_zero_length(rows(spark, [(0, 0, "lost", "en"), (0, 900, "a", "en"), (900, 900, "b", "en"), (900, 800, "c", "en"), (950, 1200, "d", "en")])).orderBy("seg_no").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("a b c", 0, 900), ("d", 950, 1200)]


def test_overlaps(spark):
    found = [(0, 1000, "a", "en"), (500, 3000, "longer", "en"), (2900, 3100, "c", "en"), (3100, 4000, "d", "en")]
    expected = [(0, 3100, "longer"), (3100, 4000, "d")]
    for n in (1, 3):
        got = D.combine_chunks(rows(spark, found).repartition(n)).orderBy("start_ms").collect()
        assert [(r.start_ms, r.end_ms, r.text) for r in got] == expected


def test_semantic_pieces(spark):
    one = spark.createDataFrame([("AAAAA!AAAAA?BBBBB!CCC",), ("no marks here at all",), ("",)], "t string")
    got = [r.p for r in one.select(D.split_semantic(F.lit("en"), F.col("t"), 10).alias("p")).collect()]
    assert got == [["AAAAA!", "AAAAA?", "BBBBB!CCC"], ["no marks ", "here at ", "all"], []]
