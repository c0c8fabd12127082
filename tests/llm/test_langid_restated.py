"""Language identification restated in plain Python: counts, scores of words, best paths, shares."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuemill.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def spread(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def buckets(word):
    data, out = b" " + word.lower().encode() + b" ", []
    for at in range(len(data) - 1):
        code = 0
        for k in range(1, 6):
            if at + k > len(data):
                break
            code = (code * 257 + data[at + k - 1] + 1) & MASK
            out.append(spread((code + (k << 56)) & MASK) % langid.BUCKETS)
    return out


def script(word):
    """The script of the first letter, by the ranges of the module."""
    for c in word:
        if c.isalpha():
            return [name for first, name in langid._RANGES if first <= ord(c)][-1]
    return None


def learned(rows):
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for w in WORD.findall(text or ""):
            if script(w):
                counts[lang].update(buckets(w))
                letters[lang][script(w)] += len(w)
            else:
                counts[lang].update({})
    names = sorted(counts)
    totals = {x: sum(counts[x].values()) + 0.3 * langid.BUCKETS for x in names}
    logp = {x: lambda b, x=x: math.log((counts[x][b] + 0.3) / totals[x]) for x in names}
    allowed = {s: [x for x in names if letters[x][s] and letters[x][s] >= 0.02 * max(1, sum(letters[x].values()))] or names for s in langid.SCRIPTS}
    return names, logp, allowed


def predicted(text, model):
    names, logp, allowed = model
    words = WORD.findall(text or "")
    if not names or not any(map(script, words)):
        return "und", 0.0
    scores = []
    for w in words:
        if not script(w):
            scores.append([0.0] * len(names))
            continue
        sums = [sum(logp[x](b) for b in buckets(w)) / 5 for x in names]
        scores.append([s - max(sums) - (0 if x in allowed[script(w)] else 50) for s, x in zip(sums, names)])
    best, back = [list(scores[0])], []
    for own in scores[1:]:
        before = best[-1]
        top = max(range(len(names)), key=lambda j: (before[j], -j))
        from_ = [j if before[j] >= before[top] - langid.PENALTY else top for j in range(len(names))]
        back.append(from_)
        best.append([max(before[j], before[top] - langid.PENALTY) + own[j] for j in range(len(names))])
    state = max(range(len(names)), key=lambda j: (best[-1][j], -j))
    path = [state]
    for from_ in reversed(back):
        state = from_[state]
        path.append(state)
    held = Counter()
    for w, j in zip(words, reversed(path)):
        held[j] += len(w.encode()) if script(w) else 0
    top = max(range(len(names)), key=lambda j: (held[j], -j))
    return names[top], held[top] / sum(held.values())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_languages_are_those_restated(spark, seed):
    draw = random.Random(seed)
    sounds = {"aa": "ka ta ri mo ne", "bb": "sch ung ein ver ich", "cc": "ção ão lhe nha que", "rr": "при сло дел во на", "rs": "сла вље ђу ње ко"}
    word = lambda x: "".join(draw.choice(sounds[x].split()) for _ in range(draw.randrange(1, 4)))
    text = lambda x, n: " ".join(word(x) if draw.random() < 0.9 else draw.choice(["42", "...", "X1", "Ωμ", "-"]) for _ in range(n))
    known = [(text(x, draw.randrange(1, 40)), x) for x in sounds for _ in range(6)] + [(None, "aa"), ("", "bb"), ("words of none", None)]
    asked = [text(draw.choice(list(sounds)), draw.randrange(1, 30)) for _ in range(30)]
    asked += [" ".join(text(draw.choice(list(sounds)), draw.randrange(3, 15)) for _ in range(3)) for _ in range(30)] + [None, "", "12 34 ...", "日本 語", asked[0]]
    model = langid.fit(langid.training(spark.createDataFrame(known, "text string, lang string"), "text", "lang", F.lit(True)))
    table = spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(table, model, keep=["doc_id"]).collect()}
    own = learned([(t, x) for t, x in known if t is not None and x is not None])
    for i, t in enumerate(asked):
        lang, score = predicted(t, own)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, (i, t, got[i], lang, score)
