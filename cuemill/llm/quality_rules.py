"""Quality rules: counts of each text, then a likelihood ratio of hashed n-grams between trusted and raw documents.

Words are maximal runs of characters other than 0x20 and 0x09-0x0D. A document's base counts decide first (base_failed).
All others are judged by two multinomials over BUCKETS hash buckets of single words and word pairs: one counted over the
trusted documents, one over all of them, both smoothed by SMOOTHING. The score is the mean over the document's n-grams of
the log of the ratio, so length cancels. A document is kept if its score reaches the threshold: the quantile TAIL of the
trusted documents' own scores. For that, trusted documents are parted in two halves by a hash of their text, and each half
is scored by the counts of the other, so that no document vouches for itself; the quantile is taken over all trusted
documents, in steps of STEP.

Only DataFrame functions run over data. Counts are summed in each task before they are sent, so BUCKETS rows a task cross
the network, whatever a frequent word weighs; the driver holds BUCKETS ratios, which are a literal of the plan. A text
is read whole in the task that holds it.

Null and empty texts have no words and fail the base rules. Repeated rows get equal verdicts; a null key is trusted by
nobody; a text with one word has no pairs. Without trusted documents there is no ratio: the score is 0 and every document
that passes the base rules is kept. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Share of trusted documents that may score below the threshold, and the steps of scores in which it is sought.
TAIL, STEP = 0.005, 1e-4
#: Scores beyond this count as this when the threshold is sought.
FAR = 4.0
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

_SPACES = "[ \t-\r]+"
_SYMBOLS = "[#*$%&|<>]"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once a row although use names it many times in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def pair_hashes(hashes: Column) -> Column:
    """A 64-bit hash of each word with the next."""
    n = F.size(hashes)
    following = F.slice(hashes, 2, F.greatest(n - 1, F.lit(0)))
    return F.slice(F.zip_with(hashes, following, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - 1, F.lit(0)))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _indices(least: int, hashes: Column) -> Column:
    """0 to the last place at which least words begin; none in shorter texts."""
    n = F.size(hashes)
    return F.when(n >= least, F.sequence(F.lit(0), n - least)).otherwise(F.array().cast("array<int>"))


def _grams(df: DataFrame, *keep: str | Column) -> DataFrame:
    """df's columns in keep and its words' hashes (_hashes) with those of pairs (_pairs). Both are columns of their own, as
    lambdas over an expression would compute it for every element."""
    return df.select(*keep, "_hashes", pair_hashes(F.col("_hashes")).alias("_pairs"))


@dataclass
class Model:
    """Log ratios by bucket; None where no document is trusted."""

    ratios: list[float] | None
    threshold: float


def _literal(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal


def _score(ratios: list[float]) -> Column:
    """Over columns _hashes and _pairs."""
    table, n = _literal(ratios), F.size("_hashes") + F.size("_pairs")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, h: acc + F.get(table, _bucket(h)))
    return F.when(n > 0, (total("_hashes") + total("_pairs")) / n).otherwise(0.0)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> list[float]:
    """Of both smoothed multinomials, rounded to 1e-9."""
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return np.round(share(target) - share(raw), 9).tolist()


def fit(docs: DataFrame, trusted: Column, text: str = "text") -> Model:
    """trusted: whether a row belongs to the target. Counts cover all rows, the threshold all trusted ones."""
    half = F.pmod(F.xxhash64(F.col(text)), F.lit(2)).cast("int") + 1
    side = F.when(F.coalesce(trusted, F.lit(False)), half).otherwise(0)
    sided = _grams(docs.select(side.alias("_side"), word_hashes(F.col(text)).alias("_hashes")), "_side")
    buckets = F.concat(F.transform("_hashes", _bucket), F.transform("_pairs", _bucket))
    found = np.zeros((3, BUCKETS))
    for r in sided.select("_side", F.explode(buckets).alias("_bucket")).groupBy("_bucket").agg(*[F.count_if(F.col("_side") == k).alias(f"n{k}") for k in range(3)]).collect():
        found[:, r["_bucket"]] = r["n0"], r["n1"], r["n2"]
    raw, target = found.sum(axis=0), found[1] + found[2]
    if not target.any():
        return Model(None, 0.0)
    by = {1: log_ratios(found[2], raw), 2: log_ratios(found[1], raw)}
    own = F.when(F.col("_side") == 1, _score(by[1])).otherwise(_score(by[2]))
    at = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), own)) / STEP).cast("int")
    steps = sorted((r["at"], r["count"]) for r in sided.where("_side > 0 and size(_hashes) > 0").select(at.alias("at")).groupBy("at").count().collect())
    below, most = 0, TAIL * sum(n for _, n in steps)
    for at, n in steps:
        below += n
        if below > most:
            break
    return Model(log_ratios(target, raw), at * STEP)


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash comes twice or more. Most texts have none, which a set of the hashes tells; in
    others, windows are sorted with their places."""

    def covered(places: Column) -> Column:
        reach = lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, reach), F.lit(0), lambda acc, x: acc + x)

    def again(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(ordered, other)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = _bound(F.sort_array(_bound(placed, again)), covered)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), slow).otherwise(0).cast("long")


def measure(docs: DataFrame, model: Model | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, with a model, score."""
    keep = keep or []
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    size = lambda c: F.size(c).cast("long")
    split = docs.select(*keep, words(F.col(text)).alias("_words"), lines.alias("_lines"), F.regexp_count(whole, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"))
    counted = split.select(
        *keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols", (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
    )
    windows = F.transform(_indices(WINDOW, F.col("_hashes")), lambda i: F.xxhash64(*[F.get("_pairs", i + j) for j in range(0, WINDOW - 1, 2)], *[F.get("_hashes", i + WINDOW - 1)] * (WINDOW % 2)))
    scored = _score(model.ratios) if model and model.ratios else F.lit(0.0)
    found = _grams(counted, *keep, "word_chars", "n_symbols", "n_dup_lines").select(*keep, size(F.col("_hashes")).alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", windows.alias("_windows"), *([scored.alias("score")] if model else []))
    return found.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated(F.col("_windows")).alias("n_repeat_words"), *(["score"] if model else []))


def judge(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """measure() with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = ~failed if model.ratios is None else ~failed & (F.col("score") >= model.threshold)
    return measure(docs, model, text, keep).withColumn("base_failed", failed).withColumn("kept", verdict)
