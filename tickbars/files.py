"""Folders that every executor can reach.

Listing and deleting go through the driver's JVM, which Spark Connect sessions do not have.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_Item, _Result = TypeVar("_Item"), TypeVar("_Result")
_AT_A_TIME = 16
# Stand-ins for local mode, per application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one in local mode if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="tickbars-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[context.applicationId] = folder
    return _local[context.applicationId]


def job_dir(spark: SparkSession) -> str:
    """The folder below the shared one for what this application writes by the way."""
    return f"{shared_dir(spark)}/tickbars/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, what: str) -> str:
    """Name of a new folder below this application's."""
    return f"{job_dir(spark)}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written by the way. Frames that read it, results of the text operators among
    them, can't be read any more: call it once all results are written elsewhere."""
    delete(spark, job_dir(spark))


def each(do: Callable[[_Item], _Result], items: Iterable[_Item]) -> list[_Result]:
    """Results of a function that waits for the file system, for several items at a time."""
    with ThreadPoolExecutor(_AT_A_TIME) as pool:
        return list(pool.map(do, items))


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()


def children(spark: SparkSession, path: str, older_than: float | None = None) -> list[str]:
    """Names in a folder, of all or of those last changed before a time; none if it does not exist."""
    fs, jpath = _fs(spark, path)
    found = fs.listStatus(jpath) if fs.exists(jpath) else []
    return [s.getPath().getName() for s in found if older_than is None or s.getModificationTime() / 1000 < older_than]


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this content; False if there is one of that name."""
    fs, jpath = _fs(spark, path)
    try:
        stream = fs.create(jpath, False)
    except Py4JJavaError as e:
        if fs.exists(jpath) and "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def move(spark: SparkSession, path: str, to: str, touch: bool = False) -> None:
    """Renames, into a folder that is made if need be; `touch` makes the time of the last change that of the move."""
    fs, jpath = _fs(spark, path)
    target = _fs(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(jpath, target):
        raise OSError(f"{path} could not be moved to {to}")
    if touch:
        fs.setTimes(target, int(time.time() * 1000), -1)
