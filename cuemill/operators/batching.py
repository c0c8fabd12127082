"""Batches of cues for model calls, their replies, and the calls themselves.

Model calls cost money, so translate() and transcribe() make them when they are called, once, and write what came back to
the folder that executors share; what they return reads from there.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X
from ..session import cut, new_folder, qualified, scratch, write
from .ledger import Ledger, Rows, bucket
from .scan import Scan

MAX_PACKED = 20
#: In so many parts replies are joined with their cues, so that no more than one is on the way at once.
PARTS = 4
# Fixed value: a line of a numbered reply.
NUMBERED = r"^\s*(\d+)\s*[.、．)）]\s*(.*)$"
TEMPLATE = "Translate the following numbered lines. Keep the numbers, one line each.\n\n"


def plan_chunks(media: DataFrame, seconds: Column | None = None, workers: int = 4) -> DataFrame:
    """media: media_id, duration_ms, others. chunk_no, offset_ms, length_ms and the others; seconds: fixed length, else even over workers with
    30 s at least. No split if the media is no longer than a chunk."""
    size = (seconds if seconds is not None else F.greatest(F.lit(30), F.floor(F.col("duration_ms") / 1000 / workers))).cast("long") * 1000
    planned = media.withColumn("_size", F.when(F.col("duration_ms") <= size, F.greatest(F.col("duration_ms"), F.lit(1))).otherwise(size))
    last = F.greatest(F.ceil(F.col("duration_ms") / F.col("_size")).cast("int") - 1, F.lit(0))
    chunks = planned.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).withColumn("offset_ms", F.col("chunk_no") * F.col("_size"))
    kept = [c for c in media.columns if c not in ("media_id", "duration_ms", "chunk_no", "offset_ms", "length_ms")]
    return chunks.withColumn("length_ms", F.least(F.col("_size"), F.col("duration_ms") - F.col("offset_ms"))).select("media_id", "chunk_no", "offset_ms", "length_ms", *kept)


def batch_fixed(cues: DataFrame, n: int = 50, huge: bool = False) -> DataFrame:
    """Adds batch_no and pos by position. huge: media items may have more cues than a task holds."""
    at = Scan(cues, "media_id", ["cue_no"], huge).add(_at=("sum", F.lit(1))).done().withColumn("_at", F.col("_at") - 1)
    return at.withColumn("batch_no", F.floor(F.col("_at") / n).cast("int")).withColumn("pos", (F.col("_at") % n).cast("int")).drop("_at")


def batch_nonempty(cues: DataFrame, n: int = MAX_PACKED) -> DataFrame:
    return batch_fixed(cues.where(X.strip(F.col("text")) != ""), n)


def cost(text: Column) -> Column:
    """Estimated tokens of a line with its overhead."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int")) + 10


def batch_by_budget(cues: DataFrame, budget: int = 400, cost_of: Callable[[Column], Column] = cost) -> DataFrame:
    """Greedy groups: a new one opens when the cost would pass the budget and the group isn't empty. One pass over each
    media item's costs."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def groups(costs: pd.Series) -> pd.Series:
        def numbers(own) -> list[int]:
            batch, used, out = 0, 0, []
            for c in own.tolist():
                if used and used + c > budget:
                    batch, used = batch + 1, 0
                used += c
                out.append(batch)
            return out

        return costs.map(numbers)

    rows = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", cost_of(F.col("text")).alias("cost")))).alias("_rows"))
    numbered = rows.select("media_id", F.arrays_zip(F.col("_rows.cue_no").alias("cue_no"), groups(F.col("_rows.cost")).alias("batch_no")).alias("_rows"))
    return numbered.select("media_id", F.explode("_rows").alias("_o")).select("media_id", "_o.cue_no", "_o.batch_no")


def _lines(batches: DataFrame, line: Column, keys: list[str]) -> DataFrame:
    return batches.withColumn("_line", line).groupBy(*keys).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda s: s["_line"]), "\n").alias("request_text"))


def pack_numbered(batches: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One request per batch: "1. text" lines under an instruction; a batch of one line is sent plain."""
    keys = ["media_id", "batch_no"]
    size = F.count("*").over(Window.partitionBy(*keys))
    flat = X.flatten_request(F.col("text"))
    packed = _lines(batches.withColumn("_size", size), F.when(F.col("_size") > 1, F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), flat)).otherwise(flat), keys)
    return packed.withColumn("request_text", F.when(F.col("lines") > 1, F.concat(F.lit(template), F.col("request_text"))).otherwise(F.col("request_text")))


def pack_newline(batches: DataFrame) -> DataFrame:
    return _lines(batches, X.flatten_request(F.col("text")), ["media_id", "batch_no"])


def parse_numbered(replies: DataFrame) -> DataFrame:
    """replies: keys media_id, batch_no with expected (lines) and reply. One row per number of complete replies:
    media_id, batch_no, pos, translation. The first of equal numbers counts; prose, blanks and other numbers don't; a
    reply that lacks a number gives nothing."""
    lines = replies.select("media_id", "batch_no", "expected", F.posexplode(F.split("reply", r"\r\n|\r|\n")).alias("_at", "_raw")).withColumn("_line", X.strip(F.col("_raw")))
    numbered = lines.withColumn("n", F.regexp_extract("_line", NUMBERED, 1).try_cast("int")).withColumn("t", X.strip(F.regexp_extract("_line", NUMBERED, 2)))
    fine = numbered.where("n between 1 and expected and t <> ''")
    first = fine.groupBy("media_id", "batch_no", "expected", "n").agg(F.min_by("t", "_at").alias("translation"))
    whole = first.withColumn("_have", F.count("*").over(Window.partitionBy("media_id", "batch_no"))).where("_have = expected")
    return whole.select("media_id", "batch_no", (F.col("n") - 1).alias("pos"), "translation")


def alignment_guard(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies with expected and texts (array): those whose count is right, and the rejected ones with both counts."""
    got = F.coalesce(F.size("texts"), F.lit(0))
    fine = got == F.col("expected")
    return replies.where(fine), replies.where(~fine).select("media_id", "batch_no", "expected", got.alias("received"))


def halve_failed_groups(rejected: DataFrame) -> DataFrame:
    """rejected: rows of failed groups (media_id, batch_no as group id, pos). Each group of more than one row becomes
    two, the first with n div 2 rows; single rows stay out."""
    n = F.count("*").over(Window.partitionBy("media_id", "batch_no"))
    at = F.row_number().over(Window.partitionBy("media_id", "batch_no").orderBy("pos")) - 1
    halved = rejected.withColumn("_n", n).withColumn("_at", at).where("_n > 1").withColumn("_half", F.floor(F.col("_n") / 2)).withColumn("_second", F.col("_at") >= F.col("_half"))
    number = (F.col("batch_no") * 2 + F.col("_second").cast("int")).cast("long")
    return halved.withColumn("batch_no", number).withColumn("pos", F.when(F.col("_second"), F.col("_at") - F.col("_half")).otherwise(F.col("_at")).cast("int")).drop("_n", "_at", "_half", "_second")


def merge_translations(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """cues with translation; the text itself where none came. translations: media_id, cue_no, translation."""
    return cues.drop("translation").join(translations, ["media_id", "cue_no"], "left").withColumn("translation", F.coalesce("translation", "text"))


class Provider(Protocol):
    batch_size: int

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]: ...


class Identity:
    batch_size = 50

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        return list(texts)


class Glossary:
    """Replaces whole words by a table; for tests and dry runs."""

    batch_size = 50

    def __init__(self, words: dict[str, str]):
        self.words = words

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        return [" ".join(self.words.get(w, w) for w in t.split(" ")) for t in texts]


_PROVIDERS: dict[str, Callable[..., Provider]] = {"identity": Identity, "glossary": Glossary}


def register_provider(name: str, make: Callable[..., Provider]) -> None:
    _PROVIDERS[name] = make


def provider(name: str, **options) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown translation provider: {name}")
    return _PROVIDERS[name](**options)


ATTEMPTS = "media_id string, batch_no int, attempt int, status string, error string, texts array<string>"


class TransientError(Exception):
    """A failure that the provider has already tried to get over."""


def _asked(backend, texts: list[str], source: str, target: str, halve: bool, log: Callable[[str], None]) -> list[str]:
    """A reply of one line for each text. With halve, a reply of another length, or a transient failure (once), makes two
    requests of half the texts each, down to single ones."""
    once = halve
    try:
        if hasattr(backend, "translate_batch"):
            out = [str(x) for x in backend.translate_batch(texts, source, target)]
        else:
            out = [str(backend.translate(t, source, target)) for t in texts]
        if len(out) == len(texts):
            return out
        reason = f"{len(out)} lines for {len(texts)}"
        if not halve or len(texts) == 1:
            raise ValueError(reason)
    except TransientError as e:
        if not halve or len(texts) == 1:
            raise
        reason, once = str(e), False
    log(reason)
    middle = len(texts) // 2
    return [*_asked(backend, texts[:middle], source, target, once, log), *_asked(backend, texts[middle:], source, target, once, log)]


def run_batches(
    batches: DataFrame, make: Callable[[], Provider], source: str, target: str, retries: int = 2, delay_s: float = 2.0, halve: bool = False, request_delay_s: float = 0.0, ledger: Ledger | None = None
) -> DataFrame:
    """One row per attempt, and one with status "split" for each request that was halved. batches: media_id, batch_no,
    texts (array). A failed batch is tried again up to retries times, after delay_s times the attempt, unless the failure
    is transient. No batch of a media item is sent after one was lost: in the same task, and with a ledger in any. What
    the ledger holds is not sent again. A task waits request_delay_s between requests. Providers live as long as their
    task."""
    how = _how(source, target)

    def attempts(backend, texts: list[str]) -> tuple[Rows, bool]:
        rows: Rows = []
        for attempt in range(retries + 1):
            log = lambda reason: rows.append((attempt, "split", reason, None))  # noqa: B023, E731
            try:
                rows.append((attempt, "ok", None, _asked(backend, texts, source, target, halve, log)))
                return rows, True
            except TransientError as e:
                rows.append((attempt, "transient", str(e), None))
                return rows, False
            except Exception as e:
                rows.append((attempt, "failed", str(e), None))
                if attempt < retries:
                    time.sleep(delay_s * (attempt + 1))
        return rows, False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, lost, sent = make(), set(), False
        for frame in frames:
            for media_id, batch_no, texts in zip(frame["media_id"], frame["batch_no"], frame["texts"]):
                texts = list(texts)
                request = (media_id, int(batch_no), texts, how)
                rows = ledger and (ledger.read(*request) or ledger.lost(*request))
                if rows is None:
                    if media_id in lost or (ledger and ledger.stopped(media_id)):
                        continue
                    if sent:
                        time.sleep(request_delay_s)
                    rows, fine = attempts(backend, texts)
                    sent = True
                    if not fine:
                        lost.add(media_id)
                    if ledger:
                        (ledger.write if fine else ledger.stop)(*request, rows)
                yield pd.DataFrame([(media_id, batch_no, *r) for r in rows], columns=["media_id", "batch_no", "attempt", "status", "error", "texts"])
        if ledger:
            ledger.flush()

    return batches.select("media_id", F.col("batch_no").cast("int").alias("batch_no"), "texts").mapInPandas(run, ATTEMPTS)


def _how(source: str, target: str) -> str:
    """What a reply depends on besides its texts."""
    return f"{source}>{target}"


class _Heard:
    """Tells progress the share of requests that have a reply, while tasks run: the ledger is counted again and again, with
    pauses that are long beside the counting. Shares only rise."""

    def __init__(self, ledger: Ledger, how: str, total: int, progress: Callable[[float], None], pause_s: float = 0.1):
        self.ledger, self.how, self.total, self.progress, self.pause_s = ledger, how, max(1, total), progress, pause_s
        self.last, self.over = 0.0, threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        pause = self.pause_s
        while not self.over.wait(pause):
            began = time.monotonic()
            self._tell()
            pause = max(self.pause_s, 20 * (time.monotonic() - began))

    def _tell(self) -> None:
        share = min(1.0, self.ledger.count(self.how) / self.total)
        if share > self.last:
            self.last = share
            self.progress(share)

    def __enter__(self) -> _Heard:
        self.thread.start()
        return self

    def __exit__(self, *exc) -> None:
        self.over.set()
        self.thread.join()
        self._tell()


def translate(
    cues: DataFrame, make: Callable[[], Provider], source: str, target: str, batch_size: int | None = None, retries: int = 2, delay_s: float = 2.0, halve: bool = False, workers: int = 2, request_delay_s: float = 0.0,
    progress: Callable[[float], None] | None = None, ledger: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cues with translation, attempts). Each media item's first batch goes alone; only where it comes back do the others
    follow, in lanes: up to workers of them are under way at a time, in tasks of their own, and none is sent after one was
    lost. A media item with a lost batch gives no cues at all; others go on. Calls are made here, once. cues: media_id,
    cue_no, text; of each media item all its cues.

    Replies are kept one by one in a ledger (a folder of this call, or the one that is named), so a task that runs again
    sends only what is missing; with a named folder, so does another call after this program has ended. progress hears the
    share of batches that have a reply, as they come."""
    spark = cues.sparkSession
    batches = batch_fixed(cues, batch_size or make().batch_size)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", X.flatten_request(F.col("text")).alias("t")))), lambda s: s["t"])
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    paths = [new_folder(spark, name) for name in ("replies", "replies", "whole")]

    def sent(some: DataFrame, tasks: int, path: str, *by: Column) -> DataFrame:
        """Dealt to a number of tasks, which stays as it is: requests are small, but take long."""
        tasks = max(1, min(tasks, most))
        dealt = some.repartitionById(tasks, (sum(by) % tasks).cast("int")).sortWithinPartitions(bucket(F.col("media_id")), "media_id", "batch_no")
        made = run_batches(dealt, make, source, target, retries, delay_s, halve, request_delay_s, kept)
        write(made, path)
        return spark.read.schema(made.schema).parquet(path)

    with scratch(spark):  # requests, and a ledger of this call alone, go when all replies are written
        kept = Ledger(qualified(spark, ledger or new_folder(spark, "ledger")), uuid.uuid4().hex)
        grouped = cut(batches.groupBy("media_id", "batch_no").agg(texts.alias("texts")), "requests")
        first, rest = canary(grouped)
        lane, place = F.col("batch_no") % workers, bucket(F.col("media_id"))
        counts = grouped.agg(F.count("*").alias("all"), F.count_if(F.col("batch_no") == 0).alias("first"), F.count_distinct(F.when(F.col("batch_no") > 0, F.struct("media_id", lane.alias("_lane")))).alias("lanes")).first()
        with _Heard(kept, _how(source, target), counts["all"], progress) if progress else nullcontext():
            tried = sent(first, counts["first"], paths[0], place)
            fine = tried.where("status = 'ok'").select("media_id")
            others = sent(rest.join(fine, "media_id", "left_semi"), counts["lanes"], paths[1], place, lane)
        attempts = tried.unionByName(others)
        replies = attempts.where("status = 'ok'").select("media_id", "batch_no", "texts")
        write(grouped.groupBy("media_id").count().join(replies.groupBy("media_id").agg(F.count("*").alias("_ok")), "media_id").where("count = _ok").select("media_id"), paths[2])
    whole = spark.read.schema(grouped.select("media_id").schema).parquet(paths[2])

    def of(part: int) -> DataFrame:
        """A part of the media items with translations. Both sides are dealt by media item, so that lines move once."""
        some = F.pmod(F.xxhash64("media_id"), F.lit(PARTS)) == part
        lines = replies.where(some).join(whole.where(some), "media_id", "left_semi").repartition("media_id").select("media_id", "batch_no", F.posexplode("texts").alias("pos", "translation"))
        return batches.where(some).drop("translation").join(lines, ["media_id", "batch_no", "pos"])

    translated = reduce(DataFrame.union, [cut(of(p), "translated") for p in range(PARTS)])
    return translated.withColumn("translation", F.coalesce(F.when(F.col("translation") != "", F.col("translation")), F.col("text"))), attempts


def canary(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each media item's first batch, and the rest, which should run only after the first has come back."""
    return batches.where("batch_no = 0"), batches.where("batch_no > 0")


RESULTS = "media_id string, chunk_no int, language string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,avg_logprob:double>>, error string"


def transcribe(chunks: DataFrame, make: Callable[[], Callable], options: dict | None = None, reference: str = "media_id") -> DataFrame:
    """One row per chunk: segments and language, or the reason. make() gives a function (reference, offset_ms,
    length_ms, options) -> (segments, language), once a task; reference is what the column of that name holds. Calls are
    made here, once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for media_id, chunk_no, audio, offset, length in zip(frame["media_id"], frame["chunk_no"], frame["_reference"], frame["offset_ms"], frame["length_ms"]):
                try:
                    segments, language = model(audio, int(offset), int(length), options or {})
                    rows.append((media_id, chunk_no, language, [dict(zip(("start_ms", "end_ms", "text", "avg_logprob"), s)) for s in segments], None))
                except Exception as e:
                    rows.append((media_id, chunk_no, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["media_id", "chunk_no", "language", "segments", "error"])

    rows = chunks.select("media_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col(reference).alias("_reference"), "offset_ms", "length_ms")
    return cut(rows.mapInPandas(run, RESULTS), "transcripts")


def missing_results(planned: DataFrame, results: DataFrame) -> DataFrame:
    """results with an error row for every planned chunk that has none."""
    gone = planned.select("media_id", "chunk_no").join(results.select("media_id", "chunk_no"), ["media_id", "chunk_no"], "left_anti")
    return results.select("media_id", "chunk_no", "error").unionByName(gone.withColumn("error", F.lit("no result returned")))


def chunk_failures(results: DataFrame) -> DataFrame:
    """Media items with failed chunks: how many of how many, and the first reason."""
    bad = F.col("error").isNotNull()
    summed = results.groupBy("media_id").agg(F.count_if(bad).alias("failed"), F.count("*").alias("chunks"), F.min_by("error", F.when(bad, F.col("chunk_no"))).alias("reason"))
    return summed.where("failed > 0").select("media_id", F.format_string("%d/%d chunk(s) failed transcription: %s", "failed", "chunks", "reason").alias("message"))
