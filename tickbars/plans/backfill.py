"""Repair of stored candles from the raw trades table."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from tickbars.operators import CANDLE_INPUTS, candles, deals_to_trades, dedup_trades, filter_day, valid_trades
from tickbars.plans.batch import Sink, run_batch


# Where the exchange's days begin and end.
ZONE = "Europe/Moscow"


def _yesterday(zone: str) -> dt.date:
    return dt.datetime.now(ZoneInfo(zone)).date() - dt.timedelta(days=1)


def backfill(deals: DataFrame, minutes: int = 5, dedup: bool = False, **how: str) -> DataFrame:
    """Candles of all rows of a trades table."""
    trades = valid_trades(deals_to_trades(deals))
    return candles(dedup_trades(trades, CANDLE_INPUTS) if dedup else trades, minutes, **how)


def backfill_day(
    deals: DataFrame, day: dt.date | None = None, minutes: int = 5, zone: str = ZONE, **how: str
) -> DataFrame:
    """Candles of one day, if not given yesterday in `zone`. The day reaches the source as a filter."""
    return backfill(filter_day(deals, day or _yesterday(zone)), minutes, **how)


def run_job(
    deals: DataFrame,
    sink: Sink,
    day: dt.date | None = None,
    minutes: int = 5,
    metrics: str | None = None,
    service: str = "backfill",
    batch_id: int = 0,
    zone: str = ZONE,
    **how: str,
) -> int:
    """Runs a day's backfill into `sink`, if not given yesterday's in `zone`; returns the number of trades read."""
    rows = filter_day(deals, day or _yesterday(zone))

    def write(read: DataFrame, number: int) -> None:
        sink(backfill(read, minutes, **how), number)

    return run_batch(rows, write, service, metrics, batch_id)
