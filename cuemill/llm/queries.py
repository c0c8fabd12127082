"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._spark import small, table
from .sql import ORACLE_SQL
from . import ann, fingerprints, html_text, langid, lm_scoring, mixing, ngram_join, packing, periodic, quality, quality_rules, urls, whitening


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def _remainder(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(langid.training(docs, "text", "lang", ~held_out))
    return langid.label(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training(docs, table(spark, sf_dir, "labels"), lambda key: _remainder(key, 3) != 1))
    held_out = F.coalesce(_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


#: Labelled ids that are broadcast at most; beyond, that join is shuffled.
BROADCAST_LABELS = 2_000_000


def _with_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with _good: its id if labels call it good and not toxic, else null."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_good")).distinct()
    return table(spark, sf_dir, "documents").join(small(good, BROADCAST_LABELS), F.col("doc_id") == F.col("_good"), "left")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents that labels call good and not toxic, the background all others."""
    marked = _with_good(spark, sf_dir)
    return lm_scoring.score_members(marked, lm_scoring.side_of(F.col("_good").isNotNull(), F.col("_good").isNull()), keep=["doc_id"])


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that labels call good and not toxic."""
    model = quality_rules.fit(_with_good(spark, sf_dir), F.col("_good").isNotNull())
    return quality_rules.judge(table(spark, sf_dir, "documents"), model, keep=["doc_id"])


def _made_periodic(key: Column, text: Column) -> Column:
    """The text; of keys whose CRC-32 h is a multiple of 10, its words with those from a on repeating the first p of them:
    g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Other keys, null ones and texts without words stay."""
    h = F.crc32(key.cast("string").cast("binary"))

    def of(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " "))

    changed = F.element_at(F.transform(F.array(quality_rules.words(text)), of), 1)
    return F.coalesce(F.when(h % 10 == 0, changed), text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find(docs, keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("_longest.length"), -F.col("_longest.period")
    return digests.select("doc_id", "n_runs", (-F.col("_longest.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


QUERIES = {f.__name__: f for f in (op1_html, op2_urls, op3_lm_scoring, op4_packing, op5_fingerprints, op6_ngram_join, op7_langid, op8_quality, op9_mixing, op10_ann, op11_quality_rules, op12_periodic_runs, op13_whitening)}

__all__ = ["ORACLE_SQL", "QUERIES"]
