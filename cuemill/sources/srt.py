"""Subtitle files in and documents out.

A file is one row (path, content). Parsing is array functions on that row, with no shuffle and no window, so the same
code serves batch and streaming readers. Lines end at \\r\\n, \\r, \\n, vertical tabs, form feeds, file, group and record
separators, next lines, and line and paragraph separators; a block ends at a blank line, which is one of white space of
any script.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import text as X
from ..session import shuffles_go
from . import export, listing

TIME = r"^(\d{2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{1,3})"
INDEX = r"^[+-]?\d+$"
BLANK_LINES = r"(?U)\n(?:[^\S\n]*\n)+"
LEAST_BYTES = 50


def scan_media(spark: SparkSession, directory: str | list[str], extensions: list[str], recursive: bool = True) -> DataFrame:
    """path, name, media_id, length, modified of files with the extensions (any case), by name. Contents are not read.
    Mounted folders are listed by tasks."""
    paths = [directory] if isinstance(directory, str) else list(directory)
    mounted, files = [listing.local_path(spark, p) for p in paths], None
    if recursive and paths and all(mounted):
        files = listing.files(spark, mounted)
    if files is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.withColumn("name", name).where(X.extension(F.col("name")).isin([e.lower().lstrip(".") for e in extensions]))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return found.dropDuplicates(["path"]).select("path", "name", stem.alias("media_id"), "length", F.col("modificationTime").alias("modified")).orderBy("name", "path")


def collect_srt(spark: SparkSession, inputs: list[str]) -> DataFrame:
    return scan_media(spark, inputs, ["srt"])


def read_files(spark: SparkSession, directory: str | list[str]) -> DataFrame:
    """path, content of all subtitle files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[sS][rR][tT]").load(directory)
    return files.select("path", "content")


def _parsed(files: DataFrame) -> DataFrame:
    """One row per file: path, utf8 (bytes are valid), blocks: array of (strict, idx, start_ts, end_ts, text, anchored).
    Each value that is used twice is bound once, so the work is one pass over a file's lines."""
    content = F.make_valid_utf8(F.col("content").cast("string"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), X.LINE_ENDS, "\n")

    def block(lines: Column) -> Column:
        return X.let(F.array_position(F.transform(lines, lambda x: x.rlike(TIME)), F.lit(True)).cast("int"), lambda at: anchored(lines, at))

    def anchored(lines: Column, at: Column) -> Column:
        """at: which line is the first time line; 0 if none is. What follows it is text, time lines too."""
        index = F.when((at == 2) & F.get(lines, F.lit(0)).rlike(INDEX) & (F.size(lines) > 2), F.get(lines, F.lit(0)).try_cast("long"))
        anchor = F.when(at > 0, F.get(lines, at - 1))
        text = F.when(at > 0, F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))
        return F.struct(index.isNotNull().alias("strict"), index.alias("idx"), (at > 0).alias("anchored"), F.regexp_extract(anchor, TIME, 1).alias("start_ts"), F.regexp_extract(anchor, TIME, 2).alias("end_ts"), F.coalesce(text, F.lit("")).alias("text"))

    lines = F.transform(F.split(body, BLANK_LINES), lambda b: F.filter(F.transform(F.split(b, "\n"), X.strip), lambda x: x != ""))
    blocks = F.transform(F.filter(lines, lambda x: F.size(x) > 0), block)
    return files.select("path", F.coalesce(valid, F.lit(False)).alias("utf8"), F.coalesce(blocks, F.filter(F.array(block(F.array(F.lit("")))), lambda x: F.lit(False))).alias("blocks"))


def read_srt(files: DataFrame, mode: str = "auto") -> DataFrame:
    """One row per file: path, how (strict, lenient, error), message, skipped, cues (array of cue_no, idx, start_ts,
    end_ts, start_ms, end_ms, text).

    strict: every block is an index (of up to 18 digits), a time line and text, in valid UTF-8. lenient: a block's first time line and what
    follows; blocks without text are skipped and counted, those without a time line ignored, cues numbered anew. auto:
    strict, else lenient; a file without a usable cue is an error row and stops nothing else.
    """
    rows = _parsed(files)
    strict_ok = F.col("utf8") & (F.size("blocks") > 0) & F.forall("blocks", lambda b: b["strict"])
    usable = F.filter("blocks", lambda b: b["anchored"] & (b["text"] != ""))
    skipped = F.size(F.filter("blocks", lambda b: b["anchored"] & (b["text"] == "")))
    how = {"strict": F.when(strict_ok, "strict").otherwise("error"), "lenient": F.when(F.size(usable) > 0, "lenient").otherwise("error")}
    how["auto"] = F.when(strict_ok, "strict").otherwise(how["lenient"])

    def cues(blocks: Column, own_index: bool) -> Column:
        def cue(b: Column, i: Column) -> Column:
            times = X.srt_ts_to_ms(b["start_ts"]).alias("start_ms"), X.srt_ts_to_ms(b["end_ts"]).alias("end_ms")
            index = b["idx"] if own_index else (i + 1).cast("long")
            return F.struct((i + 1).cast("int").alias("cue_no"), index.alias("idx"), b["start_ts"].alias("start_ts"), b["end_ts"].alias("end_ts"), *times, b["text"].alias("text"))

        return F.transform(blocks, cue)

    marked = rows.withColumn("how", how[mode])
    message = F.when(F.col("how") == "error", F.when(~F.col("utf8") & F.lit(mode == "strict"), "not valid UTF-8").when(F.size("blocks") == 0, "no cue").when(F.lit(mode == "strict"), "bad block").otherwise("no usable cue"))
    found = F.when(F.col("how") == "strict", cues(F.col("blocks"), True)).when(F.col("how") == "lenient", cues(usable, False)).otherwise(F.slice(cues(F.col("blocks"), False), 1, 0))
    return marked.select("path", "how", message.alias("message"), F.when(F.col("how") == "lenient", skipped).otherwise(0).alias("skipped"), found.alias("cues"))


def cues_of(read: DataFrame) -> DataFrame:
    """One row per cue. The outer explode keeps the optimizer from parsing once more for a filter of files with cues."""
    return read.select("path", "how", F.explode_outer("cues").alias("_c")).where("_c is not null").select("path", "how", "_c.*")


def errors_of(read: DataFrame) -> DataFrame:
    return read.where("how = 'error'").select("path", "message")


def srt_valid(length: Column, content: Column, least: int = LEAST_BYTES) -> Column:
    """Longer than least bytes, valid UTF-8, with a full time line."""
    text = content.cast("string")
    return (length > least) & F.is_valid_utf8(text) & text.rlike(r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}")


def _joined(cues: DataFrame, line: Column, alias: str = "content", sep: str = "\n") -> DataFrame:
    """One row per media item, its lines in order."""
    return cues.select("media_id", "cue_no", line.alias("_line")).groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "_line"))), lambda s: s["_line"]), sep).alias(alias))


def to_srt(cues: DataFrame, text: str = "text", keep_index: bool = False) -> DataFrame:
    """media_id, content. Blocks numbered from 1 (or by idx), one newline at the end."""
    number = F.col("idx" if keep_index else "cue_no").cast("string")
    return _joined(cues, F.concat(number, F.lit("\n"), X.format_ms_srt(F.col("start_ms")), F.lit(" --> "), X.format_ms_srt(F.col("end_ms")), F.lit("\n"), F.col(text), F.lit("\n")))


def to_plaintext(cues: DataFrame) -> DataFrame:
    """Texts joined; a space between them if the first five read as English, else nothing. The language is that of the
    first cue. One exchange: a media item's cues are gathered once, in order."""
    held = cues.select("media_id", "cue_no", "lang", "text").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", "lang", "text"))).alias("_cues"))
    first = F.array_join(F.transform(F.slice("_cues", 1, 5), lambda c: c["text"]), " ")
    texts = F.transform("_cues", lambda c: X.strip(c["text"]))
    spaced = X.is_english(F.get("_cues", F.lit(0))["lang"], first)
    return held.select("media_id", F.concat(F.when(spaced, F.array_join(texts, " ")).otherwise(F.array_join(texts, "")), F.lit("\n")).alias("content"))


def to_markdown(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(X.format_ts_md(F.floor(F.col("start_ms") / 1000)), F.lit(" "), X.strip(F.col("text")), F.lit("\n")), sep="")


def _translated() -> Column:
    return F.coalesce(F.when(F.col("translation") != "", F.col("translation")), F.col("text"))


def to_translated_srt(cues: DataFrame) -> DataFrame:
    return to_srt(cues.withColumn("_out", _translated()), "_out", keep_index=True)


def to_bilingual_srt(cues: DataFrame) -> DataFrame:
    return to_srt(cues.withColumn("_out", F.concat(F.col("text"), F.lit("\n"), _translated())), "_out", keep_index=True)


def documents(split_cues: DataFrame, segments: DataFrame, formats: list[str]) -> DataFrame:
    """media_id, format, file_name, content. SRT takes the split cues, the others the raw segments; unknown formats are
    left out."""
    makers = {"srt": (to_srt, split_cues), "txt": (to_plaintext, segments), "md": (to_markdown, segments)}
    parts = [makers[f][0](makers[f][1]).select("media_id", F.lit(f).alias("format"), F.concat("media_id", F.lit(f".{f}")).alias("file_name"), "content") for f in formats if f in makers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_documents(docs: DataFrame, directory: str, as_files: bool = False, turns: int = 1) -> None:
    """Parquet partitioned by format, or one file per document: on a mounted folder by tasks themselves, elsewhere
    through Spark's file systems. turns: files are written in so many parts, by their names, each whole before the next,
    so that no more than a part of docs is on the way; if one fails, the files of those before it stay."""
    if as_files and turns > 1:
        for k in range(turns):
            write_documents(docs.where(F.pmod(F.xxhash64("file_name"), F.lit(turns)) == k), directory, True)
        return
    if as_files and "://" in directory and not directory.startswith("file://"):
        export.write_files(docs, directory)
    elif as_files:
        docs.sparkSession.dataSource.register(TextFiles)
        with shuffles_go(docs.sparkSession):
            docs.select("file_name", "content").write.format("cue_files").mode("append").option("path", directory).save()
    else:
        docs.write.mode("overwrite").partitionBy("format").parquet(directory)


class TextFiles(DataSource):
    """One file per row (file_name, content), folders in names kept, in a folder that all executors share, mounted as a
    local path; other file systems are export's. Tasks write beside the target, and the commit moves the files of those
    that ended well to their names; two rows of one name fail the job before any file is moved."""

    @classmethod
    def name(cls) -> str:
        return "cue_files"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    """A file of a task, with a line (its place beside the target, its name) for each file that it has written."""

    names: str


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        if "://" in path and not path.startswith("file://"):
            raise ValueError(f"files can be exported to a mounted folder only, not to {path}")
        self.path = "/" + path.removeprefix("file://").lstrip("/") if path.startswith("file:") else os.path.abspath(path)
        self.parts = f"{self.path}/.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.parts, exist_ok=True)
        names = f"{self.parts}/{uuid.uuid4().hex}.names"
        written = None
        try:
            for row in rows:
                name = os.path.normpath(row.file_name)
                if name.startswith(("/", "..")):
                    raise ValueError(f"a file name must stay in the folder: {row.file_name}")
                written = written or open(names, "w", encoding="utf-8")  # a task without rows leaves nothing, also beside a failed one
                part = uuid.uuid4().hex
                with open(f"{self.parts}/{part}", "w", encoding="utf-8", newline="") as f:
                    f.write(row.content)
                written.write(json.dumps([part, name]) + "\n")
        finally:
            if written:
                written.close()
        return _Written(names if written else "")

    @staticmethod
    def _moves(messages: list) -> Iterator[tuple[str, str]]:
        for message in messages:
            if message and message.names:
                with open(message.names, encoding="utf-8") as lines:
                    yield from map(json.loads, lines)

    def _again(self, messages: list) -> list[str]:
        """Names that come twice. Eight bytes a file are held to find them."""
        key = lambda name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)
        hashes = np.fromiter((key(name) for _, name in self._moves(messages)), np.int64)
        hashes.sort()
        doubled = set(hashes[1:][hashes[1:] == hashes[:-1]].tolist())
        if not doubled:
            return []
        counts = Counter(name for _, name in self._moves(messages) if key(name) in doubled)
        return [n for n, c in counts.items() if c > 1]

    def commit(self, messages: list) -> None:
        if again := self._again(messages):
            self.abort(messages)
            raise ValueError(f"{len(again)} file names come twice, as {again[0]}")
        made: set[str] = set()
        for part, name in self._moves(messages):
            folder = os.path.dirname(f"{self.path}/{name}")
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made = made | {folder} if len(made) < 1000 else {folder}
            os.replace(f"{self.parts}/{part}", f"{self.path}/{name}")
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


PROGRESS = "media_id string, status string, language string, fp struct<size:bigint,mtime:bigint,head_tail_hash:string,duration:double>"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot rows; broken lines are left out, missing fields are null."""
    return spark.read.schema(PROGRESS + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken is null and media_id is not null").drop("_broken")


def upsert_progress(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new put in their places; fields that new leaves null keep their stored value."""
    fields = [c for c in stored.columns if c != "media_id"]
    fresh = new.select("media_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return stored.join(fresh, "media_id", "full").select("media_id", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])
