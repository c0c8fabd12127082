import os
import random
import time

import pytest

from cuemill.llm import ngram_join
from cuemill.session import cut, shared_dir
from pyspark.sql import functions as F

from test_operators import brute_classes, docs, near_copies, strangers


def files(top, part=""):
    return [f"{d}/{f}" for d, _, names in os.walk(top) for f in names if part in f"{d}/{f}"]


def local_dir(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()


def test_shuffle_files_go_when_a_stage_is_written(spark):
    before = {f for f in files(local_dir(spark), "/shuffle_")}
    made = cut(spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 50_000).alias("k")).count())
    for _ in range(50):  # they go in the background
        if not (left := {f for f in files(local_dir(spark), "/shuffle_")} - before):
            break
        time.sleep(0.1)
    assert not left and made.count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("passes,entries", [(1, 10), (4, 10)])
def test_prefixes_are_dealt_in_parts_and_go(spark, monkeypatch, passes, entries):
    monkeypatch.setattr(ngram_join, "PASSES", passes)
    monkeypatch.setattr(ngram_join, "PASS_ENTRIES", entries)
    monkeypatch.setattr(ngram_join, "PAIR_SETS", 5)
    texts = [*near_copies(40), *strangers(20), None, "", "one", "ONE"]
    top = shared_dir(spark).removeprefix("file://")
    before = set(files(top, "part-"))
    got = ngram_join.classes(docs(spark, texts).repartition(3))
    left = {f.split("/cuemill-")[-1].split("/")[0].rsplit("-", 1)[0] for f in set(files(top, "part-")) - before}
    assert left and not left & {"prefixes", "shared", "gram-counts", "pairs", "cells"}, left
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_classes(enumerate(texts))


def test_ngrams_just_too_rare_for_the_order_join_nothing(spark, monkeypatch):
    """Each n-gram is in three sets, in which it is the only common one; with room for frequent n-grams as for none, they
    made one group of all sets."""
    monkeypatch.setattr(ngram_join, "PAIR_SETS", 2)
    draw = random.Random(3)
    shared = [" ".join(f"g{i}w{j}" for j in range(4)) for i in range(60)]
    texts = [" z{} ".format(i).join(draw.sample(shared, 3)) + " " + " ".join(f"o{i}x{j}" for j in range(12)) for i in range(60)]
    rows, least = ngram_join.prepared(docs(spark, texts), "doc_id", "text", 4, 85, 100)
    assert least >= 4 or least == 0
    joined = ngram_join.candidates(rows, 85, 100).count()
    assert ngram_join.candidates(rows, 85, 100, least=8).count() == 0 < joined
