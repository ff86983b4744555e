"""Tables between steps, in the folder that the cluster shares; each has an owner that removes it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: What every intermediate folder's name begins with.
PREFIX = "tempolith-"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix=PREFIX)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where the session names none, a temporary one, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_folder()
    return named.rstrip("/")


#: Folders that this process wrote and nobody removed yet.
_written: dict[str, SparkSession] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so what is used several times is worked out once and survives lost executors.

    The table stays until ``discard``, the end of the ``scratch`` that it was made in, or the end of the process.
    """
    path = f"{shared_folder(df.sparkSession)}/{PREFIX}{name}-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system; one that is not there is fine."""
    files, status = _status(spark, path)
    if status is not None:
        files.delete(status.getPath(), True)
    _written.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``settle`` that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)
        for path in [p for p in _written if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
            _written.pop(path)


@contextmanager
def scratch() -> Iterator[None]:
    """What is settled inside is deleted at its end, also after an error; rows that depend on it must be read by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            delete(_written[path], path)


@contextmanager
def noted() -> Iterator[set[str]]:
    """The folders of what is settled inside, told at its end, for an owner that deletes them later."""
    before, found = set(_written), set()
    yield found
    found |= set(_written) - before


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S112 the session's JVM may be gone; ``sweep`` finds what is left
            continue


def sweep(spark: SparkSession, older_than: float = 7 * 86_400) -> list[str]:
    """Delete intermediate tables in the shared folder that nobody has written to for some seconds, such as those of killed runs."""
    files, status = _status(spark, shared_folder(spark))
    found = [] if status is None else [s for s in files.listStatus(status.getPath()) if s.getPath().getName().startswith(PREFIX)]
    old = [s.getPath().toString() for s in found if s.getModificationTime() <= 1000 * (time.time() - older_than)]
    for path in old:
        delete(spark, path)
    return old


def _status(spark: SparkSession, path: str):
    """The file system of a path and what it says of it, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.getFileStatus(where) if files.exists(where) else None


def present(df: DataFrame) -> bool:
    """Whether the files that a settled table was read from are still there."""
    return all(_status(df.sparkSession, path)[1] is not None for path in df.inputFiles())


def stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Sizes and times of the files at some paths: another value means other contents."""
    found = []
    for path in paths:
        files, status = _status(spark, path)
        inside = [] if status is None else files.listStatus(status.getPath())
        found.append((path, tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in inside)))
    return tuple(found)
