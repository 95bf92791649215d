"""Aggregates of closed candles, in the same stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import from_instant
from tickbars.operators.candles import AGGREGATES, grouped
from tickbars.streaming.candles import with_instant


def stream_day_totals(
    trades: DataFrame, minutes: int = 5, lateness: str = "10 minutes", order: str = "wide", tie: str = "tradeNo"
) -> DataFrame:
    """Day and ticker with the number of candles and their first open, high, low, last close and turnover.

    Two aggregates with state, one after the other, for output mode append: a candle goes into its day when the
    watermark has passed the candle, and a day comes out when it has passed the day.
    """
    closed = grouped(with_instant(trades, lateness), minutes, order, tie, (), AGGREGATES)
    # The end of a candle, less a microsecond, is the time by which the second window takes it.
    timed = closed.select(F.window_time("window").alias("at"), "datetime", "ticker", "open", "high", "low", "close", "value")
    days = timed.groupBy(F.window("at", "1 day"), "ticker").agg(
        F.count("*").alias("candles"),
        F.min_by("open", "datetime").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"),
        F.sum("value").alias("value"),
    )
    day = F.to_date(from_instant(F.col("window.start"))).alias("day")
    return days.select(day, "ticker", "candles", "open", "high", "low", "close", "value")
