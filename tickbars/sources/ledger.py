"""Reading back the progress ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.operators.progress import latest_offsets
from tickbars.schemas import LEDGER


def read_ledger(spark: SparkSession, path: str, app: str, topics: Sequence[str]) -> DataFrame:
    """Newest position of one application per partition of the given topics."""
    rows = spark.read.schema(LEDGER).parquet(path)
    return latest_offsets(rows.where((F.col("app_name") == app) & F.col("topic").isin(*topics)))
