import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from cuemill.llm import stages
from cuemill.session import cut

from test_operators import brute_classes


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = found.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = cut(stage(spark, found, sf_dir), name)
        assert found.columns == columns
        seen[name] = {r.doc_id: r.text for r in found.collect()}
    classes = brute_classes(seen["quality"].items(), 5, 80)
    assert set(seen["near_duplicates"]) == {d for d, (_, c) in classes.items() if d == c}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [d in seen["quality"] for d in seen["language"] if labels.get(d) == 1]
    assert np.mean(kept) > 0.97
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    packed = corpus_pipeline.STAGES[-1][1](spark, found, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in found.collect())


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


ODD = [None, "", "  \n", "word " * 2000, "One text of a few words, no more than that.", "One text of a few words, no more than that.", "x" * 30_000]
NAMES = ["_doc", "_text", "_kept", "_key", "_own", "_source", "_size", "label", "lang_pred", "score", "length", "start", "key", "set_key", "row", "_copies"]


def test_stages_with_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, repeated rows, equal and very long texts, clashing columns, and no rows at all."""
    good = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(i if i % 3 else None, t, None, None, None) for i, t in enumerate(ODD, 10**6)], good.schema)
    both = good.union(odd).union(odd).union(good.limit(5))
    for name in NAMES:
        both = both.withColumn(name, F.lit("clash"))
    for docs in (both, both.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = cut(stage(spark, docs, sf_dir), name)
            assert found.columns == both.columns, name
            assert (found.count() > 0) == (docs is both), name
            if name in ("language", "quality", "near_duplicates"):
                left = docs.select("doc_id", "text").exceptAll(found.select("doc_id", "text"))
                assert docs.count() == found.count() + left.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        ends = packed.where("start + length = doc_tokens")
        assert ends.count() == docs.count()
    kept = stages.near_duplicates(spark, both, sf_dir)
    assert kept.where("text like 'One text of a few%'").count() == 1 and kept.where("trim(coalesce(text, '')) in ('', '\\n')").count() == 6
