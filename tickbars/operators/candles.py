"""Candles and what is made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import bucket_start, from_instant, trade_order, whole_value
from tickbars.functions.time import check_minutes
from tickbars.schemas import CANDLE, CANDLE_KEYS

_OHLC = ["open", "high", "low", "close"]


# Fixed-size buffers only: a candle costs the same memory for one trade as for a billion, and a hot
# candle reaches the shuffle as one row per map task.
AGGREGATES = (
    "min_by(price, trade_order) as open",
    "max(price) as high",
    "min(price) as low",
    "max_by(price, trade_order) as close",
    "sum(whole_value) as value",
)


def candles(
    trades: DataFrame,
    minutes: int = 5,
    order: str = "wide",
    tie: str = "tradeNo",
    by: Sequence[str] = (),
) -> DataFrame:
    """Candles of trades that have `dt` (see `valid_trades`): open, high, low, close and turnover.

    One shuffle, on (datetime, ticker), after partial aggregation. `by` adds grouping columns. For
    `order` and `tie` see `functions.trade_order`. On a stream, set the watermark on `instant` first
    (see `streaming.stream_candles`).
    """
    return grouped(trades, minutes, order, tie, by, AGGREGATES).select(*by, *CANDLE.names)


def grouped(
    trades: DataFrame, minutes: int, order: str, tie: str, by: Sequence[str], aggregates: Sequence[str]
) -> DataFrame:
    """Aggregates, SQL text over price, whole_value, trade_order, dt and tradeNo, per candle.

    Columns: `by`, `datetime`, `ticker`, the aggregates, and for streams `window`, on which the state ends.
    """
    check_minutes(minutes)
    inputs = [
        *by,
        F.col("secId").alias("ticker"),
        "price",
        "dt",
        "tradeNo",
        whole_value("value").alias("whole_value"),
        trade_order("dt", "tradeNo", minutes, order, tie).alias("trade_order"),
    ]
    if not trades.isStreaming:
        start = bucket_start("dt", minutes).alias("datetime")
        return trades.select(start, *inputs).groupBy(*by, "datetime", "ticker").agg(*map(F.expr, aggregates))
    # The window has to be a grouping column for the watermark to end its state.
    windows = trades.select("instant", *inputs).groupBy(*by, F.window("instant", f"{minutes} minutes"), "ticker")
    return windows.agg(*map(F.expr, aggregates)).withColumn("datetime", from_instant(F.col("window.start")))


def microbatch_candles(
    trades: DataFrame, batch: str, minutes: int = 5, order: str = "wide", tie: str = "tradeNo"
) -> DataFrame:
    """Candles as per-batch processing with a keep-first table leaves them.

    Every batch builds candles from its own trades only, and of several candles for one key the one
    of the earliest batch stays. `batch` names a column of an integral type.
    """
    parts = candles(trades, minutes, order, tie, by=[batch])
    # One min_by per column, not one on a struct: the buffers stay fixed-size (hash aggregate).
    return parts.groupBy(*CANDLE_KEYS).agg(
        *[F.min_by(c, batch).alias(c) for c in [*_OHLC, "value"]]
    )


# Holds every candle: prices and turnover stay below 2^63.
WIDE = "decimal(21,2)"


def cast_serving(df: DataFrame, kind: str = "decimal(10,2)") -> DataFrame:
    """Candles in the types of the serving table: all five numbers as decimals. A number that does not fit stops the query."""
    return df.select(*CANDLE_KEYS, *[F.col(c).cast(kind).alias(c) for c in [*_OHLC, "value"]])


def serving_split(df: DataFrame, kind: str = "decimal(10,2)") -> tuple[DataFrame, DataFrame]:
    """Candles that fit the decimals of a serving table, cast, and those that do not, as they are."""
    numbers = [*_OHLC, "value"]
    fits = " and ".join(f"(`{c}` is null or try_cast(`{c}` as {kind}) is not null)" for c in numbers)
    return cast_serving(df.where(fits), kind), df.where(f"not ({fits})")


def day_series(df: DataFrame) -> DataFrame:
    """The candles of a day and ticker as one array in time order.

    `df` is unique by (datetime, ticker), so an array has at most 24 hours of candles: 288 of five
    minutes, 1,440 of one.
    """
    element = F.struct(*[c for c in CANDLE.names if c != "ticker"])
    return df.groupBy(F.to_date("datetime").alias("day"), "ticker").agg(
        F.array_sort(F.collect_list(element)).alias("series")
    )


def explode_series(series: DataFrame) -> DataFrame:
    """Candles of day series again, with `pos`, their place in the day from 0."""
    return series.select("day", "ticker", F.posexplode("series").alias("pos", "c")).select(
        "day", "pos", "c.datetime", "ticker", *[f"c.{c}" for c in CANDLE.names[2:]]
    )


def ordered_candles(df: DataFrame) -> DataFrame:
    """Candles in global order of day, ticker and time (range partitioning).

    Not needed before a keyed table is written, which keeps no order.
    """
    return df.orderBy(F.to_date("datetime"), "ticker", "datetime")
