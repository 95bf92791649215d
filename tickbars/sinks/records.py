"""Progress ledger and batch metrics: one small append per batch."""

from __future__ import annotations

import datetime as dt
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars import files
from tickbars.functions import status_label
from tickbars.operators.progress import offset_ranges
from tickbars.schemas import METRIC

_log = logging.getLogger(__name__)


def ledger_rows(messages: DataFrame, app: str, batch_id: int) -> DataFrame:
    """Ledger rows for the messages of one batch."""
    return offset_ranges(messages).select(
        F.lit(app).alias("app_name"),
        "topic",
        F.col("partition").alias("part"),
        F.col("until_offset").alias("last_offset"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.current_timestamp().alias("ts"),
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds a few rows as one file below the folder of their day, so that whole days can be compacted or removed."""
    dated = rows.withColumn("day", F.to_date("ts")).coalesce(1)
    dated.write.mode("append").partitionBy("day").parquet(path)


def append_ledger(messages: DataFrame, path: str, app: str, batch_id: int) -> None:
    """Adds the positions of one batch. A batch that runs again adds equal positions; readers take
    the newest (`sources.read_ledger`)."""
    append_rows(ledger_rows(messages, app, batch_id), path)


def compact_records(spark: SparkSession, path: str, day: dt.date) -> None:
    """Makes one file of the many that the batches of a past day have left in a ledger or metric table."""
    folder = f"{path}/day={day}"
    small = files.children(spark, folder)
    if len([n for n in small if n.endswith(".parquet")]) < 2:
        return
    rows = spark.read.parquet(folder)
    old = [f"{folder}/{n}" for n in small]
    fresh = f"{path}/_compacted-{day}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(fresh)
    for name in files.children(spark, fresh):
        if name.endswith(".parquet"):
            files.move(spark, f"{fresh}/{name}", f"{folder}/{name}")
    for name in [*old, fresh]:
        files.delete(spark, name)


def metric_row(
    spark: SparkSession,
    service: str,
    success: bool,
    millis: int,
    size: int,
    batch_id: int | None = None,
    late: int | None = None,
    invalid: int | None = None,
) -> DataFrame:
    now = dt.datetime.now(dt.timezone.utc)
    raw = spark.createDataFrame(
        [(success, service, millis, size, batch_id, now, late, invalid)],
        "success boolean, service_name string, request_time bigint, batch_size bigint, batch_id bigint, ts timestamp, "
        "late_rows bigint, invalid_rows bigint",
    )
    return raw.select(status_label("success").alias("status"), *METRIC.names[1:])


def append_metric(
    spark: SparkSession,
    path: str | None,
    service: str,
    success: bool,
    millis: int,
    size: int,
    batch_id: int | None = None,
    late: int | None = None,
    invalid: int | None = None,
) -> None:
    """Adds one metric row. Skipped without a path; a failure is logged and does not stop the job."""
    if path is None:
        _log.warning("metrics are not configured")
        return
    try:
        append_rows(metric_row(spark, service, success, millis, size, batch_id, late, invalid), path)
    except Exception:
        _log.exception("metric was not written")
