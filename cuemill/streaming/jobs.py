"""Structured Streaming forms: ingest of new files, progress, failure alarms, transcripts that arrive in parts and their
translation.

The stateful ones need the RocksDB state provider. Their state ends: with the last report of a chunk, with the watermark
that passes a buffered outcome, with the transcript that is handed on or timed out.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import batching
from ..session import scratch
from ..sources import listing, srt

FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Rows of a frame that state hands on.
FRAME = 1000


def stream_srt(spark: SparkSession, directory: str, mode: str = "auto") -> DataFrame:
    """Parsed rows of new subtitle files; the checkpoint keeps finished ones from being read again. A mounted folder is
    listed by tasks at each trigger, and the paths that are done are state (of the executors; with the RocksDB provider on
    their disks). On other file systems Spark's own source lists, and its driver holds every file's path and status."""
    mounted = listing.local_path(spark, directory)
    if mounted and os.path.isdir(mounted):
        spark.dataSource.register(listing.NewFiles)
        found = spark.readStream.format("cue_listing").option("path", mounted).option("names", r"(?s).*\.[sS][rR][tT]").load()
        return srt.read_srt(listing.contents(found.select("path").dropDuplicates(["path"])), mode)
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[sS][rR][tT]").load(directory)
    return srt.read_srt(files.select("path", "content"), mode)


PROGRESS = "media_id string, chunk_no int, fraction double, closed boolean"


class ChunkProgress(StatefulProcessor):
    """The highest fraction of a chunk. A timer that each report puts off closes the chunk after its last one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "fraction double, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, last = tuple(self.state.get()) if self.state.exists() else (None, 0)
        top = known
        for r in rows:
            best = r["fraction"].max()
            if not pd.isna(best):
                best = min(1.0, max(0.0, float(best)))
                top = best if top is None else max(top, best)
            last = max(last, int(r["at_ms"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        self.state.update((top, last))
        yield pd.DataFrame([(*key, top, False)] if top != known else [], columns=["media_id", "chunk_no", "fraction", "closed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found = [(*key, self.state.get()[0], True)] if self.state.exists() else []
        self.state.clear()
        yield pd.DataFrame(found, columns=["media_id", "chunk_no", "fraction", "closed"])

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame, lateness: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """events: event_time, media_id, chunk_no, fraction. A row whenever a chunk's highest fraction rises (cut to 0 and 1;
    late lower reports change nothing), and one with closed when the watermark is idle beyond its last report; its state
    ends then, and a still later report would begin a new one. Reports older than the watermark don't count; null
    fractions only put the end off. Output mode: update."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.select("media_id", "chunk_no", F.col("fraction").cast("double").alias("fraction"), "event_time", F.unix_millis("event_time").alias("at_ms"))
    return rows.withWatermark("event_time", lateness).groupBy("media_id", "chunk_no").transformWithStateInPandas(ChunkProgress(idle_ms), PROGRESS, "Update", "EventTime")


ALARM = "backend string, at_us long, failures int, failed long"
COUNTS = ["at_us", "succeeded", "failed"]


def _by_time(rows: list[Any]) -> Any:
    """Times, successes and failures (arrays): sums by distinct time, in order."""
    at, succeeded, failed = (np.concatenate([np.asarray(r[i], np.int64) for r in rows]) for i in range(3))
    times, place = np.unique(at, return_inverse=True)
    sums = (np.zeros(len(times), np.int64), np.zeros(len(times), np.int64))
    np.add.at(sums[0], place, succeeded)
    np.add.at(sums[1], place, failed)
    return np.stack([times, *sums])


class FailureStreak(StatefulProcessor):
    """One alarm when failures in a row, by time, reach limit; a success starts anew. Outcomes wait in a buffer until the
    watermark has passed them, so that their order does not depend on the micro-batch they came with; of those of one time
    successes count first, and the failures all at once. A timer stands at the earliest time in the buffer, so that
    outcomes go as the watermark passes them, whatever later ones wait. The buffer is rewritten only when no more
    than half of it still waits; entries up to done_us are over."""

    def __init__(self, limit: int = 3):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "failures long, given boolean, first_us long, timer_ms long, done_us long, over long")
        self.buffer = handle.getListState("buffer", "at_us array<bigint>, succeeded array<bigint>, failed array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            if len(r):
                new = _by_time([[r[c].to_numpy() for c in COUNTS]])
                self.buffer.appendList(self._pieces(new))
                first = int(new[0][0]) if first is None else min(first, int(new[0][0]))
        yield from self._released(key, timerValues, first)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._released(key, timerValues, None, int(expiredTimerInfo.getExpiryTimeInMs()))

    @staticmethod
    def _pieces(counts: Any) -> list[tuple]:
        return [tuple(c.tolist() for c in counts[:, k : k + FRAME]) for k in range(0, counts.shape[1], FRAME)]

    def _released(self, key: Any, timerValues: Any, new_us: int | None, fired_ms: int | None = None) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        failures, given, first, timer, done, over = tuple(self.streak.get()) if self.streak.exists() else (0, False, None, None, None, 0)
        if new_us is not None:
            first = new_us if first is None else min(first, new_us)
        alarms = []
        if first is not None and first <= passed:
            held = _by_time(list(self.buffer.get()))
            held = held if done is None else held[:, held[0] > done]
            due, waiting = held[:, held[0] <= passed], held[:, held[0] > passed]
            for at, succeeded, failed in due.T.tolist():
                if succeeded:
                    failures, given = 0, False
                failures += failed
                if failures >= self.limit and not given:
                    alarms.append((key[0], at, failures, failed))
                    given = True
            first, done, over = int(waiting[0][0]) if waiting.size else None, passed, over + due.shape[1]
            if not waiting.size:
                self.buffer.clear()
                over = 0
            elif over >= waiting.shape[1]:
                self.buffer.put(self._pieces(waiting))
                over = 0
        timer = self._timer_at(None if first is None else -(-first // 1000), timer, fired_ms)
        self.streak.update((failures, given, first, timer, done, over))
        if alarms:
            yield pd.DataFrame(alarms, columns=["backend", "at_us", "failures", "failed"])

    def _timer_at(self, wanted_ms: int | None, timer_ms: int | None, fired_ms: int | None) -> int | None:
        """Moves the one timer; one that has fired goes by itself."""
        if wanted_ms != timer_ms:
            if timer_ms is not None and timer_ms != fired_ms:
                self.handle.deleteTimer(timer_ms)
            if wanted_ms is not None:
                self.handle.registerTimer(wanted_ms)
        return wanted_ms

    def close(self) -> None:
        pass


def stream_failure_alarms(outcomes: DataFrame, lateness: str = "1 hour", limit: int = 3, unknown_fails: bool = True) -> DataFrame:
    """stream_failure_streak with failed: how many failures came at the very time of the alarm. Without unknown_fails a null
    outcome only moves the watermark."""
    unknown = F.lit(int(unknown_fails))
    rows = outcomes.where("event_time is not null").select("backend", F.coalesce(F.col("ok").cast("int"), F.lit(0)).cast("long").alias("succeeded"), F.coalesce(1 - F.col("ok").cast("int"), unknown).cast("long").alias("failed"), "event_time", F.unix_micros("event_time").alias("at_us"))
    alarms = rows.withWatermark("event_time", lateness).groupBy("backend").transformWithStateInPandas(FailureStreak(limit), ALARM, "Append", "EventTime")
    return alarms.select("backend", F.timestamp_micros("at_us").alias("event_time"), "failures", "failed")


def stream_failure_streak(outcomes: DataFrame, lateness: str = "1 hour", limit: int = 3) -> DataFrame:
    """outcomes: backend, event_time, ok (null: a failure). Alarms come once the watermark has passed the failure that is
    the limit-th in a row, with the failures up to and at its time; outcomes without a time or older than the watermark
    (at first 1970) don't count. A backend's buffer holds the distinct times within lateness, and at most as many that are
    over; a streak is a few numbers a backend. Output mode: append."""
    return stream_failure_alarms(outcomes, lateness, limit).select("backend", "event_time", "failures")


TRANSCRIPT = "media_id string, cue_no int, text string, complete boolean"


class Assembly(StatefulProcessor):
    """Holds the cues of a media item until all have come, or until none has come for a time; then hands them on, once.
    That it has is remembered for the same time."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cues = handle.getMapState("cues", "cue_no int", "text string")
        self.seen = handle.getValueState("seen", "held int, total int, last_ms long")
        self.over = handle.getValueState("over", "given boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            for _ in rows:
                pass
            yield self._frame([])
            return
        held, total, last = tuple(self.seen.get()) if self.seen.exists() else (0, -1, 0)
        for r in rows:
            last = max(last, int(r["at_ms"].max()))
            for cue_no, text, all_cues in r[["cue_no", "text", "total"]].itertuples(index=False):
                if not pd.isna(all_cues):
                    total = int(all_cues)
                if pd.isna(cue_no):
                    continue  # an end marker alone
                place = (int(cue_no),)
                held += not self.cues.containsKey(place)
                self.cues.updateValue(place, (None if text is None or pd.isna(text) else text,))
        self._end_at(last + self.timeout_ms)
        if 0 <= total <= held:
            yield from self._handed_on(key, True)
        else:
            self.seen.update((held, total, last))
            yield self._frame([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            self.over.clear()
            yield self._frame([])
        else:
            self._end_at(timerValues.getCurrentWatermarkInMs() + self.timeout_ms)
            yield from self._handed_on(key, False)

    def _end_at(self, when_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(when_ms)

    def _handed_on(self, key: Any, complete: bool) -> Iterator[pd.DataFrame]:
        rows = []
        for (cue_no,), (text,) in self.cues.iterator():
            rows.append((key[0], cue_no, text, complete))
            if len(rows) == FRAME:
                yield self._frame(rows)
                rows = []
        self.cues.clear()
        self.seen.clear()
        self.over.update((True,))
        yield self._frame(rows)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["media_id", "cue_no", "text", "complete"])

    def close(self) -> None:
        pass


def stream_transcripts(cues: DataFrame, timeout: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """cues: event_time (of arrival), media_id, cue_no, text and total, the number of the item's cues, which at least one
    of its rows names (a row without cue_no may be an end marker alone). An item is handed on whole, in one micro-batch,
    when as many cues have come; when the watermark is timeout beyond its newest cue as it is, with complete false. Order
    does not matter; a cue that comes again replaces itself, and what comes within timeout of an item that was handed on is
    ignored. Output mode: append."""
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    rows = cues.select("media_id", F.col("cue_no").cast("int").alias("cue_no"), "text", F.col("total").cast("int").alias("total"), "event_time", F.unix_millis("event_time").alias("at_ms"))
    return rows.withWatermark("event_time", lateness).groupBy("media_id").transformWithStateInPandas(Assembly(timeout_ms), TRANSCRIPT, "Append", "EventTime")


def stream_translate(cues: DataFrame, make: Callable, source: str, target: str, directory: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Translates each micro-batch of whole transcripts (of stream_transcripts, or a stream that has each item in one
    micro-batch) into a folder of its own under directory, so that a batch which runs again replaces its own output. A
    media item that fails is left out of its batch's cues; others go on. Folders of a batch's work go when it is written.
    options go to translate(); with a ledger a batch that runs again pays for no call twice."""

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            translated, _ = batching.translate(batch, make, source, target, **options)
            translated.write.mode("overwrite").parquet(f"{directory}/batch={number}")

    return cues.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
