"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word's score in a language is the log probability of its character n-grams (1 to 5 bytes of the lower-cased word with
its edges) in hashed buckets. The script of its first letter narrows the languages to those that wrote a noticeable part
of their training text in it. The best path over a document's words pays a penalty for each change of language, which
gives spans; the document's language is the one whose spans hold most bytes of words with letters, and the score is its
share of them. Words without letters follow their neighbours.

Null, empty and letterless texts get "und" with score 0. Ties go to the language that comes first by name. Texts of any
length are labelled whole. Repeated rows get equal labels; other columns are not read. An empty training table leaves
no languages: every text is then "und".
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import body, schema_of, with_body
from ._words import blocks, mixed, release, split_words

UND = "und"
#: Hash buckets of n-grams in each language; 4 bytes each and language are broadcast.
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4, 5)
#: Training rows per language at most, drawn by hash over the whole table.
SAMPLE = 3000
#: Languages up to which batches and what is remembered have their full size; beyond, they shrink as languages grow.
LANGUAGES = 64
PENALTY = 8.0
#: Share of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.02
#: Texts that share one run of the Viterbi loop, in bytes.
BATCH_BYTES = 6 << 20
#: Words whose scores a task remembers.
REMEMBERED = 250_000

# First code points of Unicode script ranges, with the script that holds up to the next one.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFDD, "other"), (0x20000, "han"), (0x32000, "other"),
]
_FIRST = [a for a, _ in _RANGES]
SCRIPTS = sorted({s for _, s in _RANGES})
_SCRIPT_NO = {s: i for i, s in enumerate(SCRIPTS)}


def script_of(word: str) -> int:
    """The number of the script of a word's first letter; -1 without letters."""
    for c in word:
        if c.isalpha():
            return _SCRIPT_NO[_RANGES[bisect.bisect_right(_FIRST, ord(c)) - 1][1]]
    return -1


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, those of one word together, and where each word's begin."""
    data = np.frombuffer((" " + " ".join(words).lower() + " ").encode("utf-8", "replace"), np.uint8)
    gap = np.flatnonzero(data == 32)
    region, end = gap[:-1], gap[1:]  # a word with the space before it; the space after it is its end
    n = len(data)
    until = np.repeat(end, end - region)  # for each byte, the end of its word
    at = np.arange(region[0], end[-1])
    found, owner = [], np.repeat(np.arange(len(region)), end - region)
    base = data.astype(np.uint64)
    code, out_b, out_w = np.zeros(len(at), np.uint64), [], []
    for k in ORDERS:
        nxt = at + k - 1
        code = code * np.uint64(257) + base[np.minimum(nxt, n - 1)] + np.uint64(1)
        inside = nxt <= until
        out_b.append((mixed(code[inside] + np.uint64(k << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        out_w.append(owner[inside])
    found, owner = np.concatenate(out_b), np.concatenate(out_w)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(region)))


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages)
    allowed: np.ndarray  # (scripts, languages) bool

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores; whether a word has letters."""
        scripts = np.array([script_of(w) for w in words])
        if not self.languages:
            return np.zeros((len(words), 0), np.float32), scripts >= 0
        most = max(1, (1 << 20) // len(self.languages))
        if len(words) > most:
            return np.concatenate([self.score(words[i : i + most])[0] for i in range(0, len(words), most)]), scripts >= 0
        grams, starts = word_grams(words)
        sums = np.add.reduceat(self.logp[grams], starts, axis=0) / len(ORDERS)
        sums -= sums.max(axis=1, keepdims=True)
        sums[~self.allowed[scripts]] -= 50.0
        sums[scripts < 0] = 0
        return sums.astype(np.float32), scripts >= 0


def training(docs: DataFrame, text: str, lang: str, rows: Column) -> DataFrame:
    """A sample of rows with a language: at most about SAMPLE per language, by a hash of the text."""
    labelled = docs.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = labelled.groupBy("lang").count()
    share = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), SAMPLE / F.col("count")).alias("_share"))
    part = (F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    return labelled.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(part < F.col("_share")).select("text", "lang")


def fit(sample: DataFrame) -> Model:
    """Counts n-grams in tasks; the summed counts (BUCKETS per language at most) come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang in sums:
                at, sc = np.flatnonzero(sums[lang]), np.flatnonzero(scripts[lang])
                places = np.concatenate([at, BUCKETS + sc])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(np.concatenate([sums[lang][at], scripts[lang][sc]]))], ["lang", "place", "n"])
            sums.clear()
            scripts.clear()

        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lo, hi in blocks(batch["text"]):
                found = split_words(batch["text"].slice(lo, hi - lo))
                per: dict[str, list[np.ndarray]] = {}
                for i in range(hi - lo):
                    per.setdefault(langs[lo + i], []).append(np.arange(found.first[i], found.first[i + 1]))
                for lang, at in per.items():
                    at = np.concatenate(at)
                    if not len(at):
                        continue
                    _, one, times = np.unique(found.hash[at], return_index=True, return_counts=True)
                    words = [found.word(i) for i in at[one]]
                    kinds = np.array([script_of(w) for w in words])
                    grams, starts = word_grams(words)
                    weight = np.repeat(np.where(kinds < 0, 0, times), np.diff(np.append(starts, len(grams))))
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, weight, BUCKETS)
                    lengths = np.array([len(w) for w in words]) * times
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(kinds[kinds >= 0], lengths[kinds >= 0], len(SCRIPTS))
                if len(sums) > LANGUAGES:
                    yield from out()
        yield from out()

    total = sample.mapInArrow(count, "lang string, place long, n double").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(pc.unique(total["lang"]).to_pylist())
    counts = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    if names:
        counts[pc.index_in(total["lang"], pa.array(names, pa.string())).to_numpy(), total["place"].to_numpy()] = total["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.3, counts[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
    allowed[~allowed.any(axis=1)] = True
    return Model(names, np.ascontiguousarray(logp), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word on its text's best path. All texts walk in step, the longest first, so the loop has
    as many turns as the longest text has words."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[:-1][order], lengths[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts with more than t words
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    v = np.zeros((len(order), scores.shape[1]), np.float64)
    for t in range(steps):
        a = active[t]
        at, now = begin[:a] + t, v[:a]
        if t:
            top = now.max(axis=1, keepdims=True) - penalty
            stay[at] = now >= top
            best[at] = now.argmax(axis=1)
            np.maximum(now, top, out=now)
        now += scores[at]
    path = np.zeros(len(scores), np.int16)
    state = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at, now = begin[:a] + t, state[:a]
        path[at] = now
        if t:
            state[:a] = np.where(stay[at, now], now, best[at])
    return path


def label(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """The columns in keep with lang_pred and score; spans adds the spans as an array of (first word, words, lang)."""
    keep = keep or []
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(docs, keep, "lang_pred string, score double" + ", spans array<struct<first:int,words:int,lang:string>>" * spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known: dict[int, int] = {}
        shrink = max(1, len(m.languages) / LANGUAGES)
        table, lettered = np.zeros((1024, len(m.languages)), np.float32), np.zeros(1024, bool)
        for batch in batches:
            texts = body(batch, place)
            for lo, hi in blocks(texts, int(BATCH_BYTES / shrink)):
                ids, weights, firsts, base = [], [], [0], 0
                for a, b in blocks(texts.slice(lo, hi - lo)):
                    found = split_words(texts.slice(lo + a, b - a))
                    firsts.extend((found.first[1:] + base).tolist())
                    base += len(found.hash)
                    if not len(found.hash):
                        continue
                    if len(known) > REMEMBERED / shrink and not ids:
                        known.clear()
                    own, one, back = np.unique(found.hash, return_index=True, return_inverse=True)
                    rows = np.array([known.get(h, -1) for h in own.tolist()])
                    new = np.flatnonzero(rows < 0)
                    if len(new):
                        scores, letters = m.score([found.word(i) for i in one[new]])
                        rows[new] = np.arange(len(known), len(known) + len(new))
                        while len(table) < len(known) + len(new):
                            table, lettered = np.concatenate([table, np.zeros_like(table)]), np.concatenate([lettered, np.zeros_like(lettered)])
                        table[rows[new]], lettered[rows[new]] = scores, letters
                        known.update(zip(own[new].tolist(), rows[new].tolist()))
                    ids.append(rows[back])
                    weights.append(found.end - found.start)
                ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                weights = np.concatenate(weights) if weights else np.zeros(0, np.int64)
                first = np.array(firsts)
                path = viterbi(table[ids], first, penalty) if m.languages and len(ids) else np.zeros(len(ids), np.int16)
                weights = weights * lettered[ids]
                text_no = np.repeat(np.arange(hi - lo), np.diff(first))
                n = max(1, len(m.languages))
                sums = np.bincount(text_no * n + path, weights, (hi - lo) * n).reshape(-1, n)
                top, total = sums.argmax(axis=1), sums.sum(axis=1)
                some = (total > 0) & bool(m.languages)
                langs = [m.languages[t] if s else UND for t, s in zip(top, some)]
                score = np.where(some, sums.max(axis=1) / np.maximum(total, 1), 0.0)
                out = [batch[c].slice(lo, hi - lo) for c in keep] + [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    rows = []
                    for i in range(hi - lo):
                        own = path[first[i] : first[i + 1]]
                        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                        rows.append([{"first": a, "words": b - a, "lang": m.languages[own[a]]} for a, b in zip(cuts, cuts[1:]) if b > a] if some[i] else [])
                    out.append(pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", *["spans"] * spans])
        release()

    rows, place = with_body(docs, keep, text)
    return rows.mapInArrow(run, schema)
