"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import tickbars
from tickbars import files


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Each Arrow batch of the frame through a function of one batch; empty batches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return df.mapInArrow(run, schema)


_shipped: set[str] = set()
# Bytes of rows that go to Python and back at once, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Gives the executors this package, for sessions that were started without it (`--py-files`), and keeps batches small.

    Rows are long texts here: with Spark's default, every task holds several batches of 64 MB outside of the heap.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context, root = spark.sparkContext, Path(tickbars.__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="tickbars-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "tickbars-code.zip", "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(folder / "tickbars-code.zip"))
    _shipped.add(context.applicationId)


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# What is to be deleted at the end of the `scratch` blocks that are open.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block at the end of which all that `stored` has written in it is deleted, but for what it was told to keep."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            files.delete(spark, path)


def stored(df: DataFrame, what: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the plan and survives lost executors.

    The shuffle files of the write go with its end; nothing reads them later. What is written goes with the `scratch`
    block that it is written in, unless `keep`; else with `discard` or `files.clear`.
    """
    spark = df.sparkSession
    path = files.new_dir(spark, what)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    if _scratch and not keep:
        _scratch[-1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what `stored` has written, once all that is made of it is written too."""
    files.delete(df.sparkSession, _places.pop(df))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the frame has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
