"""The progress store: snapshots of which one is current, and commits that two writers can make at a time.

A snapshot is a folder of JSON lines (v-...); a commit is one small file in _versions, named by its number, that names its
folder. The number is taken by one atomic step that fails if it is taken already (a hard link on local file systems, a
rename elsewhere, as Hadoop's HDFS has it), so a reader sees the snapshot before or after it and nothing between. A writer
that comes second reads what the first has committed and merges again. What a writer leaves that dies before its commit is
a folder that no version names; vacuum() removes it. Object stores without an atomic rename are not for this store.

Broken lines are left out, missing fields are null, an empty store has no rows.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import srt


class Conflict(Exception):
    """The version has been committed by another writer."""


class ProgressStore:
    def __init__(self, spark: SparkSession, path: str, attempts: int = 20):
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the current snapshot, 0 if there is none."""
        folder = self._paths(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folder(self, version: int) -> str:
        source = self._fs.open(self._paths(f"{self.path}/_versions/{version:012d}"))
        try:
            return json.loads(bytes(source.readAllBytes()))["folder"]
        finally:
            source.close()

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], srt.PROGRESS)
        return srt.read_progress(self.spark, f"{self.path}/{self._folder(version)}")

    def upsert(self, new: DataFrame) -> int:
        """Commits the current rows with those of new in their places (null fields keep what is stored). The version that
        holds them. Columns that new lacks are null. new is computed again when another writer comes between; of rows with one media_id the greatest counts."""
        fields = [f for f in T.StructType.fromDDL(srt.PROGRESS) if f.name != "media_id"]
        once = new.groupBy("media_id").agg(*[(F.max(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        for _ in range(self.attempts):
            seen = self.version()
            folder = f"v-{uuid.uuid4().hex}"
            srt.upsert_progress(self.read(seen), once).write.option("ignoreNullFields", "true").json(f"{self.path}/{folder}")
            try:
                self._commit(seen + 1, folder)
                return seen + 1
            except Conflict:
                self._fs.delete(self._paths(f"{self.path}/{folder}"), True)
        raise Conflict(f"{self.path}: {self.attempts} other writers came first")

    def _commit(self, version: int, folder: str) -> None:
        name, half = f"{self.path}/_versions/{version:012d}", self._paths(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(half, False)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                try:
                    os.link(half.toUri().getPath(), self._paths(name).toUri().getPath())
                except FileExistsError:
                    raise Conflict(name) from None
            elif not self._fs.rename(half, self._paths(name)):
                raise Conflict(name)
        finally:
            self._fs.delete(half, False)

    def vacuum(self, keep: int = 2) -> int:
        """Removes the folders that none of the newest keep versions names, and those versions' files. Not while a writer
        is at work. How many folders went."""
        now = self.version()
        named = {self._folder(v) for v in range(max(1, now - keep + 1), now + 1)}
        gone = [s.getPath() for s in self._fs.listStatus(self._paths(self.path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in named] if self._fs.exists(self._paths(self.path)) else []
        for folder in gone:
            self._fs.delete(folder, True)
        for old in range(1, now - keep + 1):
            self._fs.delete(self._paths(f"{self.path}/_versions/{old:012d}"), False)
        return len(gone)
