"""Session defaults for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_own = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, as in tests, a local one in local
    mode; on a cluster that would lose files, so it is an error."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master: {master})")
        found = _local = _local or "file://" + tempfile.mkdtemp(prefix="cuemill-")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's name in the shared one; its files go when the driver's JVM ends, as results that are still to be
    computed may read them until then, or with the scratch() around it."""
    path = f"{shared_dir(spark)}/cuemill-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if getattr(_own, "scratch", None):
        _own.scratch[-1].append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as other libraries read it."""
    if "://" in path:
        return path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return full if "://" in full else full.replace(":", "://", 1)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside by this thread go at the end, for work whose result has been written elsewhere."""
    _own.scratch = [*getattr(_own, "scratch", []), []]
    try:
        yield
    finally:
        *_own.scratch, made = _own.scratch
        for path in made:
            remove(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str) -> None:
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read again: later uses don't compute it anew, and a lost executor costs
    nothing but its running tasks. The lineage ends here."""
    path = new_folder(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cuemill")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
