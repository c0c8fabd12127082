"""The operators without SQL, restated one step after another in plain Python."""

import random
import re

import pytest

from cuemill.functions import vocab
from cuemill.operators import segments as D
from cuemill.queries import QUERIES
from cuemill.sources import views

LATIN, CJK = re.compile("[A-Za-z]"), re.compile("[぀-ヿ㐀-鿿가-힯]")
MARKS = {True: (".!?\n", ";:", ","), False: ("。！？!?…\n", "；;", "，,、")}
FUNCTION = set(vocab.FUNCTION_WORDS)


def english(lang, text):
    return lang == "en" or (lang == "auto" and bool(LATIN.search(text)) and not CJK.search(text))


def speed(lang, text):
    if lang == "auto":
        return 10 if CJK.search(text) else 17 if LATIN.search(text) else 18
    return {"zh": 15, "ja": 10, "en": 17, "ko": 12}[lang]


def by_marks(text, marks):
    """Pieces that end after the last strong, else medium, else weak mark within 40 characters; None where there is none."""
    out = []
    while len(text) > 40:
        at = next((i for kind in marks if (i := max(text[:40].rfind(c) for c in kind)) >= 0), None)
        if at is None:
            return None
        out.append(text[: at + 1])
        text = text[at + 1 :]
    return [*out, text] if text else out


def hard(text, marks):
    out = []
    while len(text) > 40:
        at = next((i + 1 for kind in marks if (i := max(text[:40].rfind(c) for c in kind)) >= 0), None) or (text[1:41].rfind(" ") + 2 if " " in text[1:41] else 40)
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def safe(text):
    """Lines of English that end at gaps: the first safe one of up to 12 characters too many; else the last safe one from
    three quarters of a line on; else the last that leaves no function word and parts no phrase; else the first later such."""
    text, out = text.strip(), []
    while len(text) > 40:
        words = [(m.start(), m[0].lower()) for m in re.finditer("[A-Za-z']+", text)]
        names = [w for _, w in words]
        gaps = []
        for m in re.finditer(r"\s+", text):
            k = sum(s < m.start() for s, _ in words)
            if k in (0, len(words)):
                kind = "safe"
            elif names[k - 1] in FUNCTION or any(names[i : i + len(p)] == p and i < k < i + len(p) for p in map(str.split, vocab.PROTECTED_PHRASES) for i in range(max(0, k - 4), k)):
                kind = "no"
            else:
                kind = "relaxed" if names[k] in FUNCTION else "safe"
            gaps.append((m.start(), m.end(), kind))
        over = [g for g in gaps if 40 < g[0] <= 52 and g[2] == "safe"]
        late = [g for g in gaps if 30 <= g[0] <= 40 and g[2] == "safe"]
        some = [g for g in gaps if 0 < g[0] <= 40 and g[2] != "no"]
        later = [g for g in gaps if g[0] > 40 and g[2] != "no"]
        chosen = over[0] if over else late[-1] if late else some[-1] if some else later[0] if later else None
        if not chosen:
            break
        out.append(text[: chosen[0]])
        text = text[chosen[1] :]
    return [*out, text] if text else out


def cut(lang, text):
    if len(text) <= 40:
        return [text]
    is_english = english(lang, text)
    found = by_marks(text, MARKS[is_english])
    return found if found is not None else safe(text) if is_english else hard(text, MARKS[False])


def cues(segments):
    """segments of a media item: (seg_no, start_ms, end_ms, text, lang)."""
    base = []
    for _, a, b, text, lang in sorted(segments):
        if b > a:
            base.append([a, b, text, lang if lang in vocab.SPEED_LANGUAGES else "auto"])
        elif base:
            base[-1][2] += " " + text
    timed = []
    for a, b, text, lang in base:
        strong = MARKS[english(lang, text)][0]
        marks, span = sum(text.count(c) for c in strong), (b - a) * 1000
        if b - a <= 7000 and len(text) <= 40 and marks <= 1:
            timed.append((a, b, text, lang))
            continue
        if marks:
            sentences = re.findall(f"[^{strong}]*[{strong}]|[^{strong}]+", text)
            pieces = [p for s in sentences for p in cut(lang, s) if p]
            own = [len(p) * span // sum(map(len, pieces)) for p in pieces]
        else:
            pieces = cut(lang, text)
            least, share = [len(p) * 1_000_000 // speed(lang, p) for p in pieces], [len(p) * span // len(text) for p in pieces]
            own = [max(x, y) for x, y in zip(share, least)] if sum(least) <= span else share
        at = a * 1000
        for p, us in zip(pieces, own):
            us = min(us, 7_000_000)
            timed.append(((min(at, b * 1000) + 500) // 1000, (min(at + us, b * 1000) + 500) // 1000, p, lang))
            at += us
    done, before = [], None
    for a, b, text, lang in [(a, b, p.strip(), lang) for a, b, p, lang in timed if p.strip()]:
        if before:
            gap, ends = a - before[1], MARKS[english(before[3], before[2])][0]
            apart = gap > 350 or gap < -50 or before[2].rstrip()[-1:] in ends
            last = done[-1]
            seam = " " if english(last[3], last[2] + " " + text) else ""
            joined = (last[2].rstrip() + seam + text.lstrip()).strip()
            if not apart and len(joined) <= 40 and (b - a < 800 or last[1] - last[0] < 800):
                last[1], last[2] = b, joined
                before = (a, b, text, lang)
                continue
        done.append([a, b, text, lang])
        before = (a, b, text, lang)
    return [(i + 1, a, b, t) for i, (a, b, t, _) in enumerate(done)]


def test_phrase_safe_lines_are_those_restated():
    draw, breaks = random.Random(3), D.PhraseBreaks(40)
    words = [*vocab.FUNCTION_WORDS, "word", "subtitle", "x", "it's", "42", "--", "antidisestablishmentarianism", "Right", "Now"]
    for _ in range(1500):
        text = "".join((draw.choice(vocab.PROTECTED_PHRASES) if draw.random() < 0.2 else draw.choice(words)) + draw.choice([" ", " ", " ", "  "]) for _ in range(draw.randrange(45))).strip()
        assert breaks.split(text) == safe(text), text


def compare(found, segments):
    got = {}
    for r in found.collect():
        got.setdefault(r.media_id, []).append((r.cue_no, r.start_ms, r.end_ms, r.text))
    by_item = {}
    for r in segments.collect():
        by_item.setdefault(r.media_id, []).append((r.seg_no, r.start_ms, r.end_ms, r.text, r.lang))
    for media_id, own in by_item.items():
        assert sorted(got.get(media_id, [])) == cues(own), media_id
    assert set(got) <= set(by_item)


@pytest.mark.parametrize("seed", [0, 1])
def test_cues_of_random_segments_are_those_restated(spark, seed):
    draw = random.Random(seed)
    words = ["a lot of", "the", "tips", "and", "hello", "x" * 50, "Stop.", "why?", "well,", "so;", "uh", "日本語の", "字幕。", "です、", "今天我们介绍一个项目", "한국어", "…", "\n", "42", "Ünï"]
    made = []
    for item in range(60):
        at = 0
        for n in range(draw.randrange(1, 9)):
            kinds = words[:11] if item % 3 else words
            text = draw.choice([" ", ""] if item % 4 == 0 else [" "]).join(draw.choice(kinds) for _ in range(draw.choice([1, 1, 2, 5, 20, 40])))
            long = draw.choice([0, 0, 300, 700, 3000, 9000, 60000])
            made.append((f"m{item}", 0, n, at, at + long, text, draw.choice(["en", "auto", "ja", "zh", "ko", "fr"])))
            at += long + draw.choice([-100, -20, 0, 0, 100, 400])
    rows = spark.createDataFrame(made, "media_id string, chunk_no int, seg_no int, start_ms long, end_ms long, text string, lang string")
    compare(D.split_for_srt(rows), rows)


def test_the_query_gives_what_is_restated(spark, sf_dir):
    compare(QUERIES["d12_split_for_srt"](spark, sf_dir), views.segments_of(views.cues(spark, sf_dir)))
