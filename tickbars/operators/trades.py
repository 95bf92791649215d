"""Trades: from table rows, event time, time key, day filter, validity, duplicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.functions import day_spellings, event_time, hour_text, tick_number, trade_day
from tickbars.operators.columns import with_once
from tickbars.schemas import TRADE


def deals_to_trades(deals: DataFrame) -> DataFrame:
    """Rows of the trades table as trade records; decimals become doubles and TYPE is dropped."""
    return deals.select(
        *[F.col(f.name.upper()).cast(f.dataType).alias(f.name) for f in TRADE.fields]
    )


def with_event_time(trades: DataFrame) -> DataFrame:
    """Adds `dt`, the event time."""
    return with_once(trades, "dt", event_time("tradeDate", "tradeTime"))


def time_key(trades: DataFrame, minutes: int = 5) -> DataFrame:
    """Adds the grouping key of a candle: `day`, `hour` (text) and `tick`, next to secId."""
    return trades.withColumns(
        {
            "day": trade_day("tradeDate"),
            "hour": hour_text("tradeTime"),
            "tick": tick_number("tradeTime", minutes),
        }
    )


def filter_day(df: DataFrame, day: dt.date, column: str = "TRADEDATE") -> DataFrame:
    """Trades of one day, however its parts are padded.

    Compares the stored text with all spellings, which JDBC, Parquet and ORC sources can evaluate themselves.
    """
    return filter_days(df, [day], column)


def filter_days(df: DataFrame, days: Iterable[dt.date], column: str = "TRADEDATE") -> DataFrame:
    """Trades of several days, as in `filter_day`."""
    return df.where(F.col(column).isin(*[text for day in days for text in day_spellings(day)]))


# A bigint turnover holds less than 2^63. NaN is not below it: Spark orders it above every number.
_LIMIT = "9223372036854775808D"
# A plain conjunction, so that each part can be moved towards the source on its own. A trade without a value
# counts with a turnover of 0: its price still belongs to the candle.
_USABLE = (
    f"tradeNo is not null and secId is not null and abs(price) < {_LIMIT} "
    f"and (value is null or abs(value) < {_LIMIT}) and dt is not null"
)
_PROBLEM = f"""case
    when tradeNo is null then 'tradeNo'
    when secId is null then 'secId'
    when price is null or abs(price) >= {_LIMIT} then 'price'
    when abs(value) >= {_LIMIT} then 'value'
    when dt is null then 'time'
end"""


def _timed(trades: DataFrame) -> DataFrame:
    return trades if "dt" in trades.columns else with_event_time(trades)


def _usable(trades: DataFrame) -> str:
    return f"problem is null and {_USABLE}" if "problem" in trades.columns else _USABLE


def _problem(trades: DataFrame) -> Column:
    return F.expr(f"coalesce(problem, {_PROBLEM})" if "problem" in trades.columns else _PROBLEM)


def with_problem(trades: DataFrame) -> DataFrame:
    """Adds `dt` if missing, and `problem`: the first field that makes a trade unusable, or NULL.

    A `problem` that decoding has already found (malformed payload) is kept.
    """
    timed = _timed(trades)
    return timed.withColumn("problem", _problem(timed))


def valid_trades(trades: DataFrame) -> DataFrame:
    """Trades that can go into a candle, with `dt`."""
    timed = _timed(trades)
    return timed.where(_usable(timed)).drop("problem")


def invalid_trades(trades: DataFrame) -> DataFrame:
    """Quarantine: what `valid_trades` leaves out, with the reason in `problem`."""
    timed = _timed(trades)
    return timed.where(f"not coalesce({_usable(timed)}, false)").withColumn("problem", _problem(timed))


def dup_trades(trades: DataFrame) -> DataFrame:
    """Trade numbers that occur more than once: violations of the key of the trades table."""
    return trades.groupBy("tradeNo").agg(F.count("*").alias("n")).where("n > 1")


# What a candle is made of.
CANDLE_INPUTS = ["tradeNo", "secId", "price", "value", "dt"]


def dedup_trades(trades: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per trade number.

    Batch: of rows that differ, the least by its other columns; copies are folded on the map side, so
    a trade that was sent very often costs one row per task in the shuffle. `columns` (CANDLE_INPUTS for
    candles) leaves the others unread. Stream: the first to arrive within the watermark. In a per-batch job
    each batch is a frame of its own, so a number that comes again in a later batch is not noticed.
    """
    if columns is not None:
        trades = trades.select(*columns)
    if trades.isStreaming:
        return trades.dropDuplicatesWithinWatermark(["tradeNo"])
    rest = [c for c in trades.columns if c != "tradeNo"]
    kept = trades.groupBy("tradeNo").agg(F.min(F.struct(*rest)).alias("row"))
    return kept.select(*[F.col(c) if c == "tradeNo" else F.col("row")[c].alias(c) for c in trades.columns])


def first_trades(trades: DataFrame, n: int = 10) -> DataFrame:
    """The n lowest trade numbers, as the replay job takes them."""
    return trades.orderBy("tradeNo").limit(n)
