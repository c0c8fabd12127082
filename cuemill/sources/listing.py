"""Files of mounted folders, listed by tasks, so that the driver's memory does not grow with their number.

As Spark's readers do, names that begin with a dot or an underscore are passed over (an underscore with "=" in the name
is not), links are followed, and a pattern (*, ?, [..]) may stand in a path. Other file systems are left to Spark's readers,
whose driver holds every file's status.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import cut

_GLOB = re.compile(r"[*?\[]")
_ROWS = "base string, folder boolean, depth int, path string, length long, modified long"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The mounted folder of a path; null if it is on another file system, or its pattern has braces or backslashes."""
    if re.search(r"[{}\\]", path):
        return None
    if "://" not in path and not path.startswith("file:"):
        if spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme() != "file":
            return None
        return os.path.abspath(path)
    return os.path.abspath("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else None


def _seen(name: str) -> bool:
    hidden = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def _matcher(pattern: str) -> re.Pattern:
    """A path segment's pattern as Hadoop reads it."""
    found = re.sub(r"\[(\^|!)?(.*?)\]|\*|\?|[^*?\[]+|\[", lambda m: {"*": ".*", "?": ".", "[": r"\["}.get(m[0]) or (f"[{'^' if m[1] else ''}{m[2]}]" if m[0][0] == "[" else re.escape(m[0])), pattern)
    return re.compile(f"(?s:{found})")


def _listed(folder: str, depth: int, parts: list[str], levels: int | None) -> Iterator[tuple]:
    """(folder, depth, path, length, modified in µs) below folder, which is depth segments below its base; parts: the
    pattern's segments. Folders are gone into, or given after so many levels."""
    with os.scandir(folder) as found:
        for e in found:
            if not (_matcher(parts[depth]).fullmatch(e.name) if depth < len(parts) else _seen(e.name)):
                continue
            if e.is_dir():
                if levels == 1:
                    yield True, depth + 1, e.path, None, None
                else:
                    yield from _listed(e.path, depth + 1, parts, levels and levels - 1)
            elif depth + 1 >= len(parts):
                status = e.stat()
                yield False, depth + 1, e.path, status.st_size, status.st_mtime_ns // 1_000_000 * 1000


def _split(path: str) -> tuple[str, list[str]]:
    """The folder before the first pattern, and the segments from there on."""
    parts = path.split("/")
    at = next((i for i, p in enumerate(parts) if _GLOB.search(p)), len(parts))
    return "/".join(parts[:at]) or "/", parts[at:]


def files(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """path, length, modificationTime of the files below mounted folders, at any depth, a path of several folders more than
    once; null if one of the paths is not found there. Tasks list: the first two levels in turn, then each folder below."""
    if not all(os.path.isdir(_split(p)[0]) for p in paths):
        return None

    def run(levels: int | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for base, depth, path in zip(*(batch[c].to_pylist() for c in ("base", "depth", "path"))):
                    rows: list[tuple] = []
                    for row in _listed(path, depth, _split(base)[1], levels):
                        rows.append((base, *row))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

        return each

    todo = spark.createDataFrame([(p, 0, _split(p)[0]) for p in dict.fromkeys(paths)], "base string, depth int, path string")
    found, n = [], len(paths)
    for levels in (1, 1, None):
        listed = cut(todo.repartition(max(1, min(n, 10 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(run(levels), _ROWS), "listing")
        found.append(listed.where("not folder"))
        todo = listed.where("folder").select("base", "depth", "path")
        n = todo.count()
        if not n:
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    if any(_split(p)[1] for p in paths) and out.select("base").distinct().count() < len(set(paths)):
        return None
    return out.select(F.concat(F.lit("file:"), "path").alias("path"), "length", F.timestamp_micros("modified").alias("modificationTime"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["base", "folder", "depth", "path", "length", "modified"])


class NewFiles(DataSource):
    """A stream of (path, modificationTime, length) of what a mounted folder holds at each trigger, old files too:
    whoever reads drops the paths that it has met. One task for each folder in it, one for its own files."""

    @classmethod
    def name(cls) -> str:
        return "cue_listing"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Lister(self.options["path"], self.options["names"])


class _Lister(DataSourceStreamReader):
    def __init__(self, path: str, names: str):
        self.path, self.names = path, names

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        with os.scandir(self.path) as found:
            return [InputPartition((self.path, False)), *(InputPartition((e.path, True)) for e in found if e.is_dir() and _seen(e.name))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, below = partition.value
        for is_folder, _, path, length, modified in _listed(folder, 0, [], None if below else 1):
            if not is_folder and re.fullmatch(self.names, os.path.basename(path)):
                yield f"file:{path}", datetime.fromtimestamp(modified / 1e6, timezone.utc), length


def contents(found: DataFrame) -> DataFrame:
    """path, content of files that are listed as above, read by tasks a few at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in batch["path"].to_pylist():
                with open(path.removeprefix("file:"), "rb") as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size > 8_000_000 or len(rows) == 1000:
                    yield _pairs(rows)
                    rows, size = [], 0
            yield _pairs(rows)

    return found.select("path").mapInArrow(read, "path string, content binary")


def _pairs(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])
