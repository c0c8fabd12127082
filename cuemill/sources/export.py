"""One file per row on any file system that Spark can write to.

Tasks write with Spark's own text writer, whose committer drops what failed or doubled attempts leave, one folder a file.
Then the driver gives each file its name: renames only, no content passes through it. Nothing is moved before all tasks
have ended well, so a failed job leaves the target as it was. The text writer ends every file with a newline; as content
may end otherwise only if it is empty, other content is refused before anything is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Renames that are under way at a time.
RENAMES = 16


def write_files(docs: DataFrame, directory: str) -> None:
    """docs: file_name (folders in it are kept; none may lead out of directory), content (null: an empty file). Existing
    files of these names are replaced. Two rows of one name are an error."""
    spark, directory = docs.sparkSession, directory.rstrip("/")
    rows = cut(docs.select("file_name", F.coalesce("content", F.lit("")).alias("content")), "files")
    name = F.col("file_name")
    outside = name.isNull() | (name == "") | name.startswith("/") | name.endswith("/") | name.rlike(r"(^|/)\.\.?(/|$)|//")
    for wrong, what in ((rows.where(outside), "a file name must stay in the folder"), (rows.groupBy("file_name").count().where("count > 1"), "a file name comes twice"), (rows.where((F.col("content") != "") & ~F.endswith("content", F.lit("\n"))), "content must end with a newline")):
        if found := wrong.first():
            raise ValueError(f"{what}: {found['file_name']}")
    paths = spark._jvm.org.apache.hadoop.fs.Path
    parts = f"{directory}/.parts-{uuid.uuid4().hex}"
    fs = paths(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        full = rows.where("content <> ''").select(name.alias("_file"), F.expr("left(content, length(content) - 1)").alias("content"))
        full.write.partitionBy("_file").text(parts)

        def put(folder) -> None:
            source = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
            target = paths(f"{directory}/{unquote(folder.getName().removeprefix('_file='))}")
            fs.mkdirs(target.getParent())
            if fs.exists(target):
                fs.delete(target, False)
            if not fs.rename(source, target):
                raise OSError(f"{source} could not be renamed to {target}")

        with ThreadPoolExecutor(RENAMES) as pool:
            for _ in pool.map(put, _folders(fs, paths(parts))):
                pass
            for row in rows.where("content = ''").select("file_name").toLocalIterator():
                fs.create(paths(f"{directory}/{row.file_name}"), True).close()
    finally:
        fs.delete(paths(parts), True)


def _folders(fs, parts) -> Iterator:
    if fs.exists(parts):
        for status in fs.listStatus(parts):
            if status.getPath().getName().startswith("_file="):
                yield status.getPath()
