"""The stages of the corpus pipeline.

Each takes documents and gives documents with all their columns, whatever their names; the last one gives pieces. Rows of
one key stay rows of their own; a key may be null. Empty tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder, remove, scratch, write
from . import langid, mixing, ngram_join, packing, quality
from ._spark import table

#: Least share of a document's letters in its language. Documents that mix two languages stay; word salad goes.
LEAST_LANGUAGE = 0.35


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that no column clashes with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (so null and empty ones), or without a language that holds LEAST_LANGUAGE of them, go.
    Languages are learned from the documents that have one; where none has, every document goes."""
    model = langid.fit(langid.training(docs, "text", "lang", F.lit(True)))
    found = langid.label(_whole(docs), model, text="_doc.text", keep=["_doc"])
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE)).select("_doc.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality threshold go. Without labels of both kinds every score is 0.5 and all stay; rows of
    equal texts share their fate."""
    model = quality.fit(quality.training(docs, table(spark, sf_dir, "labels"), lambda key: F.lit(True)))
    return quality.score(_whole(docs), model, text="_doc.text", keep=["_doc"]).where("score >= 0.5").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: five words, similarity 0.8. Documents without words stay, each
    of them; ties go to the least key, then the least hash of the text."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources come near their targets (mixing.mix). Null sources are one
    source, texts without words are copied as often as others of their source."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 ids with their sequences; a null text is an end token alone. A repeated row is packed each
    time it comes."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, added_tokens=True)


STAGES = [("language", language), ("quality", good), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written to the shared folder and read again. What a stage has written on
    its way goes when its result is there, and that result when the next one is; the last one's input stays, as its rows
    are still to be read."""
    before = None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            write(made, path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
