"""Running values over huge keys, parents and sketches of the audit."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import batching as E, metrics as J, segments as D
from cuemill.operators.scan import Scan
from cuemill.queries import joins
from cuemill.sources import views


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture(scope="module")
def huge(spark):
    """Nearly all segments belong to one item; some overlap all that follow."""
    n = F.col("id")
    start = n * 100 + F.pmod(F.xxhash64(n), F.lit(90))
    span = F.when(n % 997 == 0, 60_000).when(n % 7 == 0, 0).otherwise(F.pmod(F.xxhash64(n, F.lit(1)), F.lit(180)))
    return spark.range(60_000).select(F.when(n % 50 == 0, F.concat(F.lit("m"), (n % 6).cast("string"))).otherwise("huge").alias("media_id"), (n % 3).cast("int").alias("chunk_no"), n.alias("seg_no"), start.alias("start_ms"), (start + span).alias("end_ms"), F.concat(F.lit("t"), n).alias("text"), F.lit("en").alias("lang"))


def test_ranges_share_a_huge_item(spark, huge):
    parts = Scan(huge, "media_id", ["start_ms", "seg_no"], True).df.groupBy("_part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1.5 * 60_000 / 4


def test_huge_items_give_what_windows_give(spark, huge):
    for f in (D.combine_chunks, D.absorb_zero_length, lambda d, huge: E.batch_fixed(d.withColumnRenamed("seg_no", "cue_no"), 7, huge)):
        assert rows(f(huge, huge=True)) == rows(f(huge, huge=False))
    outcomes = huge.select(F.col("media_id").alias("backend"), F.col("seg_no").alias("at"), F.when(F.col("seg_no") % 11 != 0, F.xxhash64("seg_no") % 5 == 0).alias("ok"))
    assert rows(J.failure_streak(outcomes, huge=True)) == rows(J.failure_streak(outcomes))


def test_combined_spans_are_those_of_one_pass(spark):
    rng = random.Random(4)
    made = [("ab"[i % 2], rng.randrange(3), i, s := rng.randrange(3000), s + rng.randrange(0, 90), f"t{i}") for i in range(150)]
    df = spark.createDataFrame(made, "media_id string, chunk_no int, seg_no long, start_ms long, end_ms long, text string")
    want = []
    for media in "ab":
        spans = []
        for _, c, n, s, e, t in sorted((r for r in made if r[0] == media), key=lambda r: (r[3], r[1], r[2])):
            if spans and s < spans[-1][1]:
                if e - s > spans[-1][1] - spans[-1][0]:
                    spans[-1][2] = t
                spans[-1][1] = max(spans[-1][1], e)
                spans[-1][3] += 1
            else:
                spans.append([s, e, t, 1])
        want += [(media, i + 1, *x) for i, x in enumerate(spans)]
    for huge in (False, True):
        got = D.combine_chunks(df, huge).select("media_id", "seg_no", "start_ms", "end_ms", "text", "parts").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_streaks_of_null_outcomes(spark):
    df = spark.createDataFrame([("x", i, ok) for i, ok in enumerate([False, None, False, True, None, False])], "backend string, at int, ok boolean")
    for huge in (False, True):
        assert [r.streak for r in J.failure_streak(df, 2, huge).orderBy("at").collect()] == [1, 1, 2, 0, 0, 1]


def test_cues_outside_their_parents(spark):
    rng = random.Random(1)
    parents = [(rng.choice("ab"), s := rng.randrange(1000), s + rng.randrange(200)) for _ in range(20)]
    cues = [(rng.choice("abc"), i, s := rng.randrange(1200), s + rng.randrange(60), "en", "hello") for i in range(200)] + [("a", 900, None, 5, "en", "x"), ("a", 901, 5, None, None, None)]
    left = spark.createDataFrame(cues, "media_id string, cue_no int, start_ms long, end_ms long, lang string, text string")
    right = spark.createDataFrame([*parents, ("a", None, 5), ("a", 5, None)], "media_id string, start_ms long, end_ms long")
    for huge in (False, True):
        got = {r.cue_no: r.inside for r in J.inside_parents(left, right, huge).collect()}
        assert len(got) == len(cues)
        for media, no, s, e, *_ in cues[:200]:
            assert got[no] == any(m == media and a <= s and b >= e for m, a, b in parents)
        assert got[900] is False and got[901] is False
    audit = J.cue_quality_audit(left, right).agg(F.sum("outside")).first()[0]
    assert audit == sum(not x for x in got.values())
    assert J.cue_quality_audit(left, right.limit(0)).agg(F.sum("outside")).first()[0] == len(cues)


def test_sketches_merge_within_their_error(spark):
    n = F.col("id")
    cues = spark.range(40_000).select(F.when(n % 4 == 0, "ja").otherwise("en").alias("lang"), F.lit(0).cast("long").alias("start_ms"), (F.pmod(F.xxhash64(n), F.lit(9000)) + 1).alias("end_ms"), F.repeat(F.lit("x"), (n % 90).cast("int")).alias("text"))
    parts = J.quality_sketches(cues)
    got = {r.lang: r for r in J.quality_quantiles(parts).collect()}
    values = {"ja": [], "en": []}
    for r in cues.select("lang", "end_ms").collect():
        values[r.lang].append(r.end_ms)
    for lang, found in values.items():
        found.sort()
        assert got[lang].cues == len(found)
        for q, value in zip((0.5, 0.95, 0.99), got[lang].ms):
            assert abs(sum(x <= value for x in found) / len(found) - q) < 0.02
    halves = [J.quality_sketches(cues.sample(0.5, seed=s)) for s in (1, 2)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang").agg(F.sum("cues").alias("cues"), *[F.kll_merge_agg_bigint(c).alias(c) for c in ("speed", "chars", "ms")])
    again = {r.lang: r for r in J.quality_quantiles(merged).collect()}
    for lang, found in values.items():
        assert abs(sum(x <= again[lang].ms[0] for x in found) / len(found) - 0.5) < 0.03
    none = J.quality_quantiles(J.quality_sketches(cues.limit(3).withColumn("end_ms", F.lit(0).cast("long")))).collect()
    assert none and all(r.speed is None for r in none)


def test_speeds_of_long_lines(spark):
    """Lines of more characters than an int of thousandths or millionths holds."""
    rows = spark.createDataFrame([("en", 2_148, 1_000), ("ja", 3_000_000, 60_000_000)], "lang string, n int, end_ms long")
    cues = rows.select(F.lit("m").alias("media_id"), "lang", F.lit(0).cast("long").alias("start_ms"), "end_ms", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    got = {r.lang: (r.speed, r.chars) for r in J.quality_quantiles(J.quality_sketches(cues)).collect()}
    assert got == {"en": ([2_148_000] * 3, [2_148] * 3), "ja": ([50_000] * 3, [3_000_000] * 3)}
    assert {r.lang: (r.too_long, r.too_fast, r.longest) for r in J.cue_quality_audit(cues).collect()} == {"en": (1, 1, 2_148), "ja": (1, 1, 3_000_000)}


def test_quantiles_of_given_documents(spark, sf_dir):
    """All columns are computed, near the exact quantiles; a count alone would leave them out."""
    got = {r.lang: r for r in joins.j8_cue_quality_quantiles(spark, sf_dir).collect()}
    found = {}
    for r in views.cues(spark, sf_dir).collect():
        speeds, chars, ms = found.setdefault(r.lang, ([], [], []))
        chars.append(len(r.text))
        ms.append(r.end_ms - r.start_ms)
        if ms[-1] > 0:
            speeds.append(chars[-1] * 1_000_000 // ms[-1])
    assert got.keys() == found.keys() and max(max(chars) for _, chars, _ in found.values()) > 2_147
    for lang, columns in found.items():
        assert got[lang].cues == len(columns[1])
        for name, values in zip(("speed", "chars", "ms"), columns):
            for q, value in zip((0.5, 0.95, 0.99), got[lang][name]):
                below, upto = (sum(f(x) for x in values) / len(values) for f in (lambda x: x < value, lambda x: x <= value))
                assert below - 0.03 <= q <= upto + 0.03


def test_starts_of_a_very_long_line(spark, tmp_path):
    chars = 36_000_000
    spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("x"), F.lit(chars)).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in views.cues(spark, str(tmp_path)).select("start_ms", "end_ms").collect()] == [(0, chars * 60)]
