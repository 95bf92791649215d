"""Trades that come after their candle was closed.

The watermark of a batch is the newest event time of all earlier batches less the lateness. A trade is late if its candle
ends at or before the watermark of the batch that brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.functions import bucket_start


def bucket_end(when: Column | str, minutes: int) -> Column:
    """End of the candle that an event time falls into."""
    return bucket_start(when, minutes) + F.expr(f"interval {int(minutes)} minutes")


def watermarks(trades: DataFrame, batch: str, lateness: str = "10 minutes") -> DataFrame:
    """`watermark` of every batch, NULL for the first one. One row per batch goes through the window."""
    newest = trades.groupBy(batch).agg(F.max("dt").alias("newest"))
    earlier = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return newest.select(batch, (F.max("newest").over(earlier) - F.expr(f"interval {lateness}")).alias("watermark"))


def with_watermark(trades: DataFrame, batch: str, lateness: str = "10 minutes") -> DataFrame:
    """Trades with the `watermark` of their batch. Trades without a batch have none."""
    return trades.join(watermarks(trades, batch, lateness), batch, "left")


def late_trades(trades: DataFrame, batch: str, minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Trades that come too late for a candle of that width, with `watermark`."""
    return with_watermark(trades, batch, lateness).where(bucket_end("dt", minutes) <= F.col("watermark"))


def trades_in_time(trades: DataFrame, batch: str, minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """The others."""
    marked = with_watermark(trades, batch, lateness)
    late = F.coalesce(bucket_end("dt", minutes) <= F.col("watermark"), F.lit(False))
    return marked.where(~late).drop("watermark")
