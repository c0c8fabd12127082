import datetime
import random
from contextlib import contextmanager

import duckdb
import pytest

from pyspark.sql import functions as F

from cuemill.operators import batching as E
from cuemill.queries import ORACLE_SQL, QUERIES
from cuemill.streaming import jobs

SIMPLE = "1\n00:00:01,000 --> 00:00:03,000\nHello\n"


def test_ingest_reads_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text(SIMPLE)

    def run():
        q = jobs.stream_srt(spark, str(tmp_path / "in")).select("path", F.size("cues").alias("n")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 1
    (tmp_path / "in/b.srt").write_text(SIMPLE)
    assert run() == 2


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@contextmanager
def fed(spark, tmp_path, schema, make, mode):
    """A running stream of what make gives, and a function that puts rows in and tells all that came out, by micro-batch."""
    (tmp_path / "in").mkdir()
    out = []
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = make(events).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).start()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        return out

    try:
        yield put, query
    finally:
        query.stop()


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute, seconds=second)


def flat(batches):
    return [r for b in batches for r in b]


def test_chunk_progress_rises_and_its_state_ends(spark, tmp_path, rocks):
    schema = "event_time timestamp, media_id string, chunk_no int, fraction double"
    with fed(spark, tmp_path, schema, lambda e: jobs.stream_progress(e, "10 minutes", "30 minutes"), "update") as (put, query):
        put([(at(0), "m", 0, 0.8), (at(0), "m", 1, 1.7)])
        put([(at(1), "m", 0, 0.2), (at(1), "m", 1, None)])  # a lower report and one without a number change nothing
        out = put([(at(2), "m", 0, 0.9)])
        assert sorted(flat(out)) == [("m", 0, 0.8, False), ("m", 0, 0.9, False), ("m", 1, 1.0, False)]
        out = put([(at(24 * 60 * d), f"n{d}", 0, 0.5) for d in (1, 2, 3)])
        put([(at(24 * 60 * 4), "n4", 0, 0.5)])
        out = put([(at(24 * 60 * 5), "n5", 0, 0.5)])
        closed = {r[:3] for r in flat(out) if r[3]}
        assert {("m", 0, 0.9), ("m", 1, 1.0), ("n1", 0, 0.5), ("n2", 0, 0.5), ("n3", 0, 0.5)} <= closed
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert sum(s["numRowsRemoved"] for s in states) > 0
        assert states[-1]["numRowsTotal"] <= max(s["numRowsTotal"] for s in states) - 4  # what is closed is gone


OUTCOMES = "backend string, event_time timestamp, ok boolean"


def test_alarm_once_at_the_third_failure(spark, tmp_path, rocks):
    rows = [("x", at(0, i), False) for i in (4, 1, 2, 3)] + [("y", at(0, i), i % 2 == 0) for i in range(6)]
    with fed(spark, tmp_path, OUTCOMES, lambda e: jobs.stream_failure_streak(e, "1 minute"), "append") as (put, _):
        assert flat(put(rows)) == []  # the watermark has not passed them
        assert flat(put([("z", at(9), True)])) == [("x", at(0, 3), 3)]


def test_late_success_still_breaks_a_streak(spark, tmp_path, rocks):
    with fed(spark, tmp_path, OUTCOMES, lambda e: jobs.stream_failure_streak(e, "5 minutes"), "append") as (put, _):
        put([("x", at(0), False), ("x", at(1), False), ("x", at(3), False)])
        put([("x", at(2), True)])
        assert flat(put([("z", at(20), True)])) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_alarms_do_not_depend_on_arrival(spark, tmp_path, rocks, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), at(i), rng.random() < 0.3) for i in range(60)]
    want, streaks = [], {}
    for backend, when, ok in rows:
        streaks[backend] = 0 if ok else streaks.get(backend, 0) + 1
        if streaks[backend] == 3:
            want.append((backend, when, 3))
    near = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(20)))
    with fed(spark, tmp_path, OUTCOMES, lambda e: jobs.stream_failure_streak(e, "30 minutes"), "append") as (put, _):
        for k in range(0, 60, 20):
            put(near[k : k + 20])
        assert sorted(flat(put([("z", at(600), True)]))) == sorted(want)


def test_alarm_does_not_wait_for_later_outcomes(spark, tmp_path, rocks):
    """x has one outcome that the watermark has not passed; the three before it have been passed, the last just now."""
    with fed(spark, tmp_path, OUTCOMES, lambda e: jobs.stream_failure_streak(e, "1 minute"), "append") as (put, _):
        assert flat(put([("x", at(7), False), ("x", at(7, 30), False), ("x", at(8), False), ("x", at(8, 1), True), ("y", at(8, 1), False)])) == []
        assert flat(put([("z", at(9), True)])) == [("x", at(8), 3)]
        assert len(flat(put([("z", at(30), True)]))) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_of_one_time_count_at_once(spark, tmp_path, rocks, seed):
    """Successes first, then all failures; over many micro-batches, each of which passes some of the buffer."""
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), at(rng.randrange(60)), rng.choice([True, False, False, None])) for _ in range(160)]
    want, state = [], {}
    for backend, when in sorted({r[:2] for r in rows}, key=lambda r: r[1]):
        oks = [ok for b, t, ok in rows if (b, t) == (backend, when)]
        before, given = (0, False) if True in oks else state.get(backend, (0, False))
        now = before + sum(not ok for ok in oks)
        if now >= 3 and not given:
            want.append((backend, when, now, sum(not ok for ok in oks)))
        state[backend] = (now, given or now >= 3)
    near = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(8)))
    with fed(spark, tmp_path, OUTCOMES, lambda e: jobs.stream_failure_alarms(e, "10 minutes"), "append") as (put, _):
        for k in range(0, 160, 20):
            put(near[k : k + 20])
        out = put([("z", at(600), True), (None, None, False)])
        assert sorted(flat(out)) == sorted(want) and sum(bool(b) for b in out) > 2


@pytest.mark.parametrize("minutes", [0, 37])
def test_alarms_of_odd_events_are_those_of_sql(spark, tmp_path, minutes):
    """Ties, nulls everywhere, backends whose last outcome lies in the last hour; no events at all."""
    rng = random.Random(minutes)
    null = lambda x: None if rng.random() < 0.1 else x
    rows = [(i, null(at(rng.randrange(600))), null(rng.randrange(4)), null(rng.choice(["error", "error", "view"]))) for i in range(400)] if minutes else []
    rows += [(1000 + i, at(600 + minutes, i), 9, "error") for i in range(3)] + [(1003, at(660 + minutes, 2), 9, "view")] if minutes else []
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"set timezone = 'UTC'; create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["k3_stream_failure_streak"]).fetchall()
    got = QUERIES["k3_stream_failure_streak"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and (len(want) > 10) == bool(minutes)


def test_transcripts_are_handed_on_whole_and_once(spark, tmp_path, rocks):
    schema = "event_time timestamp, media_id string, cue_no int, text string, total int"
    with fed(spark, tmp_path, schema, jobs.stream_transcripts, "append") as (put, query):
        assert flat(put([(at(0), "m", 3, "c", None), (at(0), "n", 1, "x", 2)])) == []
        assert flat(put([(at(1), "m", 1, "a", None), (at(1), "m", 1, "a", None)])) == []
        out = put([(at(2), "m", 2, None, None), (at(2), "m", None, None, 3), (at(2), "o", None, None, 0)])  # the last cue with the end marker
        assert sorted(flat(out)) == [("m", 1, "a", True), ("m", 2, None, True), ("m", 3, "c", True)]
        assert len([b for b in out if b]) == 1
        out = put([(at(3), "m", 2, "again", 3), (at(3), "n", 2, "y", None)])
        assert sorted(flat(out))[3:] == [("n", 1, "x", True), ("n", 2, "y", True)]


def test_transcripts_without_an_end_are_timed_out(spark, tmp_path, rocks):
    schema = "event_time timestamp, media_id string, cue_no int, text string, total int"
    with fed(spark, tmp_path, schema, lambda e: jobs.stream_transcripts(e, "30 minutes", "5 minutes"), "append") as (put, query):
        put([(at(0), "m", 1, "a", 2)])
        put([(at(20), "m", 1, "b", 2)])
        assert flat(put([(at(50), "n", 1, "x", 2)])) == []
        assert flat(put([(at(70), "n", 1, "x", 2)])) == [("m", 1, "b", False)]
        out = put([(at(75), "m", 2, "c", 2), (at(600), "o", 1, "y", 9)])
        out = put([(at(900), "p", 1, "y", 9)])
        assert ("m", 2, "c", True) not in flat(out) and ("n", 1, "x", False) in flat(out)
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert sum(s["numRowsRemoved"] for s in states) > 0


def test_parts_of_a_transcript_give_the_batches_of_the_whole(spark, tmp_path, rocks):
    schema = "event_time timestamp, media_id string, cue_no int, text string, total int"
    rows = [(at(i), "m", i, f"line {i}", 7) for i in range(1, 8)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = jobs.stream_transcripts(arriving).where("complete").drop("complete")
    asked = tmp_path / "asked"

    class Noted:
        batch_size = 3

        def translate_batch(self, texts, source, target):
            with open(asked, "a") as f:
                f.write("|".join(texts) + "\n")
            return [t.upper() for t in texts]

    jobs.stream_translate(whole, Noted, "en", "fr", str(tmp_path / "out"), str(tmp_path / "state"), workers=1).awaitTermination()
    assert asked.read_text().splitlines() == ["line 1|line 2|line 3", "line 4|line 5|line 6", "line 7"]
    assert sorted(r.translation for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"LINE {i}" for i in range(1, 8)]


def test_translation_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("m", 1, "the end")], "media_id string, cue_no int, text string").write.parquet(str(tmp_path / "in"))
    cues = spark.readStream.schema("media_id string, cue_no int, text string").parquet(str(tmp_path / "in"))
    jobs.stream_translate(cues, lambda: E.provider("glossary", words={"the": "le"}), "en", "fr", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.translation for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["le end"]


def test_new_files_are_listed_by_tasks(spark, tmp_path, rocks):
    """Also those of folders that come later; hidden ones and others are passed over, and Spark's file source, which keeps
    every path in the driver, is not in the plan."""
    (tmp_path / "in/deep/er").mkdir(parents=True)
    for name in ("in/a.srt", "in/deep/b.SRT", "in/deep/er/c d%é.srt", "in/.h.srt", "in/deep/_no.srt", "in/t.txt"):
        (tmp_path / name).write_text(SIMPLE)
    seen = []

    def run():
        q = jobs.stream_srt(spark, f"file://{tmp_path}/in").select("path").writeStream.foreachBatch(lambda b, _: seen.extend(r.path for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert "FileStreamSource" not in q.lastProgress["sources"][0]["description"]

    run()
    assert sorted(seen) == sorted(f"file:{tmp_path}/in/{n}" for n in ("a.srt", "deep/b.SRT", "deep/er/c d%é.srt"))
    (tmp_path / "in/new").mkdir()
    (tmp_path / "in/new/d.srt").write_text(SIMPLE)
    run()
    assert len(seen) == 4 and seen[-1].endswith("/new/d.srt")
