"""Trade values and the order of trades within a candle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickbars.functions.time import check_minutes, to_instant


def whole_value(value: Column | str) -> Column:
    """Turnover of one trade without its fraction, toward zero; 0 where it is missing.

    A value beyond bigint stops the query under ANSI mode; `valid_trades` sets it aside before.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def _check_tie(tie: str) -> None:
    if tie not in ("tradeNo", "reverse"):
        raise ValueError(f"tie must be 'tradeNo' or 'reverse', got {tie!r}")


def _wide(second: Column, no: Column, tie: str) -> Column:
    step = F.lit("100000000000000000000").cast("decimal(21,0)")
    low = no.cast("decimal(20,0)")
    return second * step + (low if tie == "tradeNo" else -low)


def total_order(when: Column | str, trade_no: Column | str, tie: str = "tradeNo") -> Column:
    """Sort key of trades over all times, a decimal: second, then trade number (`tie` as in `trade_order`)."""
    _check_tie(tie)
    no = F.col(trade_no) if isinstance(trade_no, str) else trade_no
    return _wide(F.unix_seconds(to_instant(when)).cast("decimal(12,0)"), no, tie)


def trade_order(
    when: Column | str,
    trade_no: Column | str,
    minutes: int = 5,
    order: str = "wide",
    tie: str = "tradeNo",
) -> Column:
    """Sort key of the trades of one candle: event time, then trade number.

    `wide`, a decimal, takes any bigint trade number. `packed` puts the second within the candle and the
    trade number into one bigint, which is faster; it holds numbers from 0 to 2^51 - 1 at any width (2^54 - 1
    at 5 minutes) and stops the query on others rather than order them wrongly. Both keep min_by/max_by
    in a hash aggregate, where a struct would fall back to sorting. `tie="reverse"` puts the highest
    trade number of a second first.
    """
    _check_tie(tie)
    when = F.col(when) if isinstance(when, str) else when
    no = F.col(trade_no) if isinstance(trade_no, str) else trade_no
    check_minutes(minutes)
    second = (F.minute(when) % minutes * 60 + F.second(when)).cast("bigint")
    if order == "wide":
        return _wide(second.cast("decimal(4,0)"), no, tie)
    if order == "packed":
        bits = 63 - (minutes * 60 - 1).bit_length()
        top = (1 << bits) - 1
        low = no if tie == "tradeNo" else F.lit(top) - no
        message = f"tradeNo outside 0..{top}: use order='wide'"
        return F.when(no.between(0, top), F.shiftleft(second, bits) + low).otherwise(
            F.raise_error(F.lit(message)).cast("bigint")
        )
    raise ValueError(f"order must be 'wide' or 'packed', got {order!r}")
