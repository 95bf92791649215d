"""What a per-batch stream remembers between batches: how late it is, and which trades it has seen.

Each batch leaves its own rows in folders (`sinks.batches`) and reads those of earlier ones, so a batch that runs again finds
what it found before.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickbars.operators.late import bucket_end
from tickbars.operators.numbers import NUMBERS, merge_bitmaps, number_bitmaps, unseen_trades
from tickbars.schemas import TRADE
from tickbars.sinks.batches import of_days, read_batches, write_batch

# Late trades as they are kept.
LATE = T.StructType([*TRADE.fields, T.StructField("dt", T.TimestampNTZType())])
_NEWEST = T.StructType([T.StructField("newest", T.TimestampNTZType())])


def in_time(trades: DataFrame, path: str, batch_id: int, minutes: int, lateness: str) -> DataFrame:
    """The trades of a batch that are not late (see `operators.late`); those that are go to a folder below `path`."""
    spark = trades.sparkSession
    before = read_batches(spark, f"{path}/newest", _NEWEST, batch_id).agg((F.max("newest") - F.expr(f"interval {lateness}")).alias("w"))
    mark: dt.datetime | None = before.first().w
    write_batch(trades.agg(F.max("dt").alias("newest")), f"{path}/newest", batch_id)
    late = F.lit(False) if mark is None else bucket_end("dt", minutes) <= F.expr(f"timestamp_ntz'{mark}'")
    write_batch(trades.where(late).select(*LATE.names), f"{path}/trades", batch_id)
    return trades.where(~late)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The late trades of all batches, with `batch_id`: what a repair, or `operators.combine_candles`, has to add."""
    return read_batches(spark, f"{path}/trades", LATE)


def first_time(trades: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The trades of a batch whose number no earlier batch has had on that day; remembers their numbers below `path`.

    Numbers within the batch have to be unique. Only the bitmaps of the batch's own days are read.
    """
    days = [d for (d,) in trades.select(F.to_date("dt")).distinct().collect()]
    seen = of_days(read_batches(trades.sparkSession, path, NUMBERS, batch_id), days)
    fresh = unseen_trades(trades, merge_bitmaps(seen))
    write_batch(number_bitmaps(fresh), path, batch_id, ["day"])
    return fresh
