"""Candle table on Parquet files: a folder per merge and day, and a commit per day.

A merge reads the days that it touches, merges, writes these days below a folder of its own and commits each of them by
creating the day's next number, a small file that names the folder. That succeeds for one writer only; another one
that has touched the same day reads it again and merges once more. Readers take the newest number of each day, so a
day changes as a whole. A merge looks at its own days only, however many the table has.

Creating a number has to be exclusive, which HDFS and local file systems are; on object stores use a table format.
What a job leaves behind in `data` when it is cut short is named by no commit and harms nobody.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickbars import files
from tickbars.operators.upsert import check_policy, upsert
from tickbars.schemas import CANDLE, CANDLE_KEYS

# How long what has been replaced stays for those who read it.
KEEP_HOURS = 24.0
_TRIES = 50
_NONE = "-"


def _newest(spark: SparkSession, path: str, day: str, seconds: float = 5.0) -> tuple[int, str]:
    """Number and folder of a day's newest commit; 0 and none if there is none."""
    commits = f"{path}/commits/{day}"
    numbers = sorted((int(n) for n in files.children(spark, commits)), reverse=True)
    until = time.monotonic() + seconds
    for n in numbers:
        # A number without a name: its writer is about to say it, or has died.
        while not (name := files.read_text(spark, f"{commits}/{n:012d}").strip()) and time.monotonic() < until:
            time.sleep(0.05)
        if name:
            return numbers[0], name
    return (numbers[0] if numbers else 0), _NONE


def _newest_of(spark: SparkSession, path: str, days: Sequence[str]) -> dict[str, tuple[int, str]]:
    return dict(zip(days, files.each(lambda day: _newest(spark, path, day), days)))


def _commit(spark: SparkSession, path: str, day: str, after: int, name: str, keep_hours: float) -> bool:
    """Makes the next commit of a day; False if another writer has made it. Clears away what has been replaced long ago."""
    commits = f"{path}/commits/{day}"
    if not files.create_text(spark, f"{commits}/{after + 1:012d}", name):
        return False
    # A folder is out of use since the next number was made.
    old = {int(n) for n in files.children(spark, commits, older_than=time.time() - keep_hours * 3600)}
    for n in sorted(int(n) for n in files.children(spark, commits)):
        if n + 1 not in old or n > after:
            break
        gone = files.read_text(spark, f"{commits}/{n:012d}").strip()
        if gone not in ("", _NONE):
            files.delete(spark, _place(path, gone, day))
        files.delete(spark, f"{commits}/{n:012d}")
    return True


def _place(path: str, name: str, day: str) -> str:
    return f"{path}/data/{name}/trade_date={day}"


def _read(spark: SparkSession, path: str, newest: dict[str, tuple[int, str]], schema: T.StructType) -> DataFrame | None:
    folders = [_place(path, name, day) for day, (_, name) in newest.items() if name != _NONE]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def read_candles(
    spark: SparkSession, path: str, days: Iterable[dt.date] | None = None, schema: T.StructType = CANDLE
) -> DataFrame:
    """The candles of the given days, of all days by default, with `trade_date`. `schema` is that of the table's columns."""
    wanted = files.children(spark, f"{path}/commits") if days is None else [str(d) for d in days]
    stored = _read(spark, path, _newest_of(spark, path, wanted), schema)
    found = spark.createDataFrame([], schema) if stored is None else stored
    return found.withColumn("trade_date", F.to_date("datetime"))


def _days(df: DataFrame) -> list[str]:
    """Days that candles fall into: a small list however many candles there are."""
    return sorted(str(d) for (d,) in df.select(F.to_date("datetime")).distinct().collect())


def _write(df: DataFrame, path: str, days: int, files_per_day: int) -> str:
    """Name of a new folder with these candles. Dealt out by day and salt: adaptive execution is off in stateful batches."""
    name = uuid.uuid4().hex
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("ticker"), F.lit(files_per_day))
    out = df.withColumn("trade_date", F.to_date("datetime"))
    out = out.repartition(max(1, min(most, days * files_per_day)), "trade_date", salt)
    out.write.partitionBy("trade_date").parquet(f"{path}/data/{name}")
    return name


def merge_candles(
    incoming: DataFrame,
    path: str,
    policy: str = "replace",
    version: Sequence[str] = (),
    files_per_day: int = 1,
    keep_hours: float = KEEP_HOURS,
) -> None:
    """Upserts candles, unique by (datetime, ticker), into the table at `path`; for the policies see `operators.upsert`.

    The columns are those of `incoming`, for all merges into a table. Only the days that `incoming` touches are read and
    written. Any number of writers may merge at the same time.
    """
    check_policy(policy, version)
    spark = incoming.sparkSession
    # Read for its days and for the merge. Blocks that are lost are computed again.
    fresh = incoming.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        left = _days(fresh)
        for attempt in range(_TRIES):
            if not left:
                return
            newest = _newest_of(spark, path, left)
            mine = fresh if not attempt else fresh.where(F.to_date("datetime").cast("string").isin(left))
            stored = _read(spark, path, newest, incoming.schema)
            merged = mine if stored is None else upsert(stored, mine, CANDLE_KEYS, policy, version)
            name = _write(merged, path, len(left), files_per_day)
            made = files.each(lambda d: _commit(spark, path, d, newest[d][0], name, keep_hours), left)
            left = [d for d, done in zip(left, made) if not done]
        if left:
            raise RuntimeError(f"{path} has changed {_TRIES} times while it was merged into")
    finally:
        fresh.unpersist()


def overwrite_days(
    candles: DataFrame, path: str, days: Iterable[dt.date], files_per_day: int = 1, keep_hours: float = KEEP_HOURS
) -> None:
    """Makes the table hold, of the given days, these candles and no others. Of several writers the last one wins."""
    spark, wanted = candles.sparkSession, sorted({str(d) for d in days})
    fresh = candles.where(F.to_date("datetime").cast("string").isin(wanted)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = set(_days(fresh))
        name = _write(fresh, path, len(held), files_per_day) if held else _NONE

        def commit(day: str) -> None:
            while not _commit(spark, path, day, _newest(spark, path, day)[0], name if day in held else _NONE, keep_hours):
                pass

        files.each(commit, wanted)
    finally:
        fresh.unpersist()


def candle_table(path: str, policy: str = "replace", version: Sequence[str] = (), **how: float) -> Callable[[DataFrame, int], None]:
    """Sink for `start_candles`: merges each batch. All policies bear a batch that runs again."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        merge_candles(batch, path, policy, version, **how)

    return sink
