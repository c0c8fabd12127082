from pyspark.sql import functions as F

from cuemill.operators import metrics as J
from cuemill.plans import work as G


def names(spark, *found):
    return spark.createDataFrame([("d", f) for f in found], "directory string, file_name string")


def plan(spark, *found):
    moves, warnings = G.plan_renames(names(spark, *found), "zh")
    return {(r.source, r.target) for r in moves.collect()}, [(r.stem, r.reason) for r in warnings.collect()]


def test_renames(spark):
    assert plan(spark, "movie.srt", "movie.bilingual.srt", "movie.jpn.srt") == ({("movie.srt", "movie.chs.srt"), ("movie.bilingual.srt", "movie.bilingual.chs.srt"), ("movie.jpn.srt", "movie.srt")}, [])
    assert plan(spark, "movie.srt", "movie.chs.srt", "movie.bilingual.chs.srt") == (set(), [])
    moves, warnings = plan(spark, "movie.srt", "movie.bilingual.srt")
    assert len(moves) == 2 and warnings == [("movie", "no source copy")]
    assert plan(spark, "movie.srt") == (set(), [])
    assert plan(spark, "show.e01.srt", "show.e01.eng.srt")[0] == {("show.e01.srt", "show.e01.chs.srt"), ("show.e01.eng.srt", "show.e01.srt")}


def test_work_modes(spark):
    media = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "media_id string")
    inventory = spark.createDataFrame([("a", "flat", "srt", 99, True), ("b", "nested", "srt", 99, True), ("c", "flat", "srt", 99, False)], "media_id string, dir string, suffix string, length long, valid boolean")
    complete = G.outputs_complete(media, inventory, ["srt"])
    assert {r.media_id: r.complete for r in complete.collect()} == {"a": True, "b": True, "c": False, "d": False}
    unchanged = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "media_id string, unchanged boolean")
    sources = spark.createDataFrame([("b",), ("c",)], "media_id string")
    modes = lambda **o: {r.media_id: r.mode for r in G.plan_work(media, complete, unchanged, sources, **o).collect()}
    assert modes() == {"a": "done", "b": "full", "c": "translate_only", "d": "full"}
    assert modes(compat=True)["b"] == "translate_only"
    assert set(modes(force=True).values()) == {"full"}


def test_progress_keeps_the_highest_report(spark):
    planned = spark.createDataFrame([("m", 0), ("m", 1)], "media_id string, chunk_no int")
    events = spark.createDataFrame([("m", 0, 0.8), ("m", 0, 0.2), ("m", 0, 0.9), ("m", 1, 1.7)], "media_id string, chunk_no int, fraction double")
    assert J.progress_rollup(planned, events).first().progress == 0.95
    assert J.progress_rollup(planned, events.where("chunk_no = 0")).first().progress == 0.45


def test_streaks(spark):
    rows = spark.createDataFrame([("b", i, ok) for i, ok in enumerate([False, False, True, False, False, False, False])], "backend string, at int, ok boolean")
    got = J.failure_streak(rows).orderBy("at").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3, 4] and [r.at for r in got if r.breach] == [5]


def test_vote(spark):
    rows = spark.createDataFrame([("m", 0, "fr"), ("m", 1, "en"), ("n", 0, None)], "media_id string, chunk_no int, language string")
    assert {r.media_id: r.language for r in J.vote_language(rows).collect()} == {"m": "fr", "n": None}
    assert {r.language for r in J.vote_language(rows, "ja").collect()} == {"ja"}


def test_summary(spark):
    rows = spark.createDataFrame([("failed", 0, False), ("failed", 0, False)], "status string, segments long, stopped boolean")
    assert J.run_summary(rows).first().exit_status == 3
    assert J.run_summary(rows.withColumn("stopped", F.lit(True))).first().exit_status == 130
    assert J.run_summary(rows.limit(0)).first().exit_status == 0
