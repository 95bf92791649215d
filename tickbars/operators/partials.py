"""Candles that can be combined: of parts of a candle's trades, or of the candles of shorter buckets.

`candle_partials` is the step per trade and `combine_candles` the one between results; both have fixed-size buffers and
are associative and commutative, so parts can be made at any place and time and put together in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import bucket_start, total_order
from tickbars.operators.candles import grouped
from tickbars.schemas import CANDLE, CANDLE_KEYS, PARTIAL

_OF_TRADES = (
    "min_by(price, trade_order) as open",
    "max(price) as high",
    "min(price) as low",
    "max_by(price, trade_order) as close",
    "sum(whole_value) as value",
    "min_by(dt, trade_order) as open_time",
    "min_by(tradeNo, trade_order) as open_no",
    "max_by(dt, trade_order) as close_time",
    "max_by(tradeNo, trade_order) as close_no",
    "count(*) as trades",
)
_OF_PARTS = (
    "min_by(open, first) as open",
    "max(high) as high",
    "min(low) as low",
    "max_by(close, last) as close",
    "sum(value) as value",
    "min_by(open_time, first) as open_time",
    "min_by(open_no, first) as open_no",
    "max_by(close_time, last) as close_time",
    "max_by(close_no, last) as close_no",
    "sum(trades) as trades",
)


def candle_partials(
    trades: DataFrame, minutes: int = 5, order: str = "wide", tie: str = "tradeNo", by: Sequence[str] = ()
) -> DataFrame:
    """Candles as in `candles`, each with its first and last trade and the number of its trades.

    Works on streams too, where each change of a candle carries a greater version (`schemas.CANDLE_VERSION`).
    """
    return grouped(trades, minutes, order, tie, by, _OF_TRADES).select(*by, *PARTIAL.names)


def combine_candles(
    partials: DataFrame, minutes: int | None = None, tie: str = "tradeNo", by: Sequence[str] = ()
) -> DataFrame:
    """One candle of all that share time and ticker; with `minutes`, of all within buckets of that width.

    The buckets of the parts have to divide the new ones (5 into 15 or 60, not into 12), and no trade may be in two parts.
    Of trades equal in time and number, which is one trade in two parts, either is taken.
    """
    keys = {"first": total_order("open_time", "open_no", tie), "last": total_order("close_time", "close_no", tie)}
    if minutes is not None:
        keys["datetime"] = bucket_start("datetime", minutes)
    parts = partials.select(*by, *PARTIAL.names).withColumns(keys)
    return parts.groupBy(*by, *CANDLE_KEYS).agg(*map(F.expr, _OF_PARTS)).select(*by, *PARTIAL.names)


def plain_candles(partials: DataFrame) -> DataFrame:
    """The columns of a candle only."""
    return partials.select(*CANDLE.names)
