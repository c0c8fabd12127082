"""Quality scores by Bradley-Terry ranking: document scores learned from preference pairs.

Every pair of a document labelled 1 and one labelled 0 is a preference. The score is linear in features of the whole
text, fitted by the logistic loss on feature differences. The threshold is a quantile of the training scores: the level
(Model.quantile) is the one that parts the labels best. The reported score is the logistic function of the distance to
that threshold.

The fit is bounded by two parameters: SAMPLE labelled rows, drawn by hash over the whole table, and PAIRS preference
pairs drawn from them with a fixed seed (of up to SAMPLE^2 / 4). Scoring covers every row.

Null and empty texts have all features 0 and get a score like any other. Texts of any length are read whole. Repeated
rows get equal scores; a label that comes twice counts once, labels that contradict each other both count, an id with
several texts trains with one of them (by hash). Other columns are not read. Without labels of both kinds there is
nothing to learn: every score is 0.5. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import body, schema_of, with_body
from ._words import blocks, release, split_words

#: Labelled rows that the fit takes at most, drawn by a hash of the text; about 300 bytes each come to the driver.
SAMPLE = 20_000
#: Preference pairs of the fit, and those whose differences are held at a time.
PAIRS, PAIR_STEP = 200_000, 4096
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, _MARK, _OTHER, _SPACE, _LINE = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x0A] = _LINE
_CLASS[list(b".?!")] = _STOP
_CLASS[list(b",;:'\"-()")] = _MARK

NAMES = ("length", "upper", "digit", "high", "stop", "mark", "other", "line", "word_length", "repeated", "distinct", "symbol_words", "short_words", "long_words", "stop_words", "mark_words", "upper_words", "word_spread")


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features): shares of kinds of bytes and words, all computed over whole texts."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi in blocks(texts):
        found = split_words(texts.slice(lo, hi - lo))
        n = np.diff(found.first)
        size = np.diff(found.offsets)
        if not len(found.data) or not len(found.start):
            continue
        text_no = np.repeat(np.arange(hi - lo), size)
        kinds = np.bincount(text_no * 9 + _CLASS[found.data], minlength=(hi - lo) * 9).reshape(-1, 9)
        ink = np.maximum(size - kinds[:, _SPACE] - kinds[:, _LINE], 1)
        letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH], 1)
        word_no = np.repeat(np.arange(hi - lo), n)
        length = found.end - found.start
        last, begin = _CLASS[found.data[found.end - 1]], _CLASS[found.data[found.start]]
        per = np.maximum(n, 1)
        share = lambda hit: np.bincount(word_no, hit, hi - lo) / per
        again = np.zeros(len(length), bool)
        again[1:] = (found.hash[1:] == found.hash[:-1]) & (word_no[1:] == word_no[:-1])
        order = np.lexsort((found.hash, word_no))
        first = np.ones(len(length), bool)
        first[1:] = (found.hash[order][1:] != found.hash[order][:-1]) | (word_no[order][1:] != word_no[order][:-1])
        mean = np.bincount(word_no, length, hi - lo) / per
        spread = np.sqrt(np.maximum(np.bincount(word_no, length.astype(float) ** 2, hi - lo) / per - mean**2, 0))
        out[lo:hi] = np.stack(
            [
                np.log1p(n), kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / ink, kinds[:, _HIGH] / ink, kinds[:, _STOP] / ink, kinds[:, _MARK] / ink, kinds[:, _OTHER] / ink,
                kinds[:, _LINE] / per, mean, share(again), np.bincount(word_no[order], first, hi - lo) / per, share((length == 1) & (begin >= _STOP)), share(length <= 3), share(length > 12),
                share(last == _STOP), share(last == _MARK), share((begin == _UPPER) & (last != _LOWER)), spread,
            ], axis=1)
    return out


@dataclass
class Model:
    knots: np.ndarray  # (bends, features)
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float = 0.5

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature with hinges at quantiles of the training rows, so that too much and too little can both cost."""
        return np.concatenate([x, *[np.maximum(x - k, 0) for k in self.knots]], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        s = np.clip((self.expand(x) - self.shift) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def training(docs: DataFrame, labels: DataFrame, rows: Callable[[Column], Column], text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(text, label) of labelled rows whose key passes rows: about SAMPLE at most, half of each label, by a hash of key and label.
    The sampled keys are bounded by that, so they are broadcast to the documents; one row for each comes back."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("_key is not null and label in (0, 1)").where(rows(F.col("_key"))).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    part = F.xxhash64("_key", "label").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE / 2 / max(1, counts.get(1, 0)))).otherwise(min(1.0, SAMPLE / 2 / max(1, counts.get(0, 0))))
    drawn = known.where(part < share)
    found = docs.select(F.col(key).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_doc") == F.col("_key"))
    return found.groupBy("_key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")


def fit(sample: DataFrame) -> Model:
    """Features come from tasks; the fit over the bounded sample runs on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(b["text"])), pa.list_(pa.float64())), b["label"]], ["x", "label"])

    table = sample.mapInArrow(run, "x array<double>, label int").toArrow()
    y = table["label"].to_numpy()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, y))  # the rows' order must not matter
    model = fit_rows(x[order], y[order])
    release()
    return model


def fit_rows(x: np.ndarray, y: np.ndarray) -> Model:
    none = np.zeros(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(none, none, none, none, 0.0)
    model = Model(np.quantile(x, [0.02, 0.1, 0.5, 0.9, 0.98], axis=0), none, none, none, 0.0)
    z = model.expand(x)
    model.shift, model.scale = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = np.clip((z - model.shift) / model.scale, -8, 8)
    draw = np.random.default_rng(0)
    better, worse = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    w = np.zeros(z.shape[1])
    for _ in range(12):  # Newton steps on the mean of log(1 + exp(-w d)) with a ridge; d: feature differences
        hess, grad = np.zeros((len(w), len(w))), np.zeros(len(w))
        for at in range(0, PAIRS, PAIR_STEP):
            d = z[better[at : at + PAIR_STEP]] - z[worse[at : at + PAIR_STEP]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            grad += d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess / PAIRS + RIDGE * np.eye(len(w)), grad / PAIRS - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    scores = z @ w
    # The quantile of the training scores that parts the labels best; in a gap, its middle.
    order = np.argsort(scores, kind="stable")
    s, bad_below = scores[order], np.concatenate([[0], np.cumsum(y[order] == 0)])
    right = bad_below + (len(good) - (np.arange(len(s) + 1) - bad_below))
    right = right[1:-1] * (np.diff(s) > 0) if len(s) > 1 else right[:0]
    if not len(right) or right.max() == 0:
        model.threshold = float(s.mean())
        return model
    top = np.flatnonzero(right == right.max())
    at = int(top[len(top) // 2])
    model.quantile = (at + 1) / len(s)
    model.threshold = float((s[at] + s[at + 1]) / 2)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep with score (0 to 1)."""
    keep = keep or []
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(held.value.score(features(body(b, place))), pa.float64())], [*keep, "score"])
        release()

    rows, place = with_body(docs, keep, text)
    return rows.mapInArrow(run, schema_of(docs, keep, "score double"))
