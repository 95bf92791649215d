"""Rows that every batch of a stream leaves behind in a folder of its own.

A batch that runs again replaces its folder, so adding up over the folders counts it once. Batches are read up to a
number, which makes what a batch finds independent of how often it or a later one has run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickbars import files


def write_batch(rows: DataFrame, path: str, batch_id: int, by: Iterable[str] = ()) -> None:
    """The rows of one batch, in folders by the columns `by` within it."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one, with `batch_id`; none if nothing has been written."""
    names = [n for n in files.children(spark, path) if n.startswith("batch_id=")]
    kept = [n for n in names if before is None or int(n.removeprefix("batch_id=")) < before]
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not kept:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*[f"{path}/{n}" for n in kept])


def of_days(rows: DataFrame, days: Iterable[dt.date], column: str = "day") -> DataFrame:
    """Rows of some days; on a folder column a filter of folders."""
    return rows.where(F.col(column).isin(*days))
