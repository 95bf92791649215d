"""Which days of a candle table differ from the trades, and making them good."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.operators.trades import filter_days
from tickbars.plans.backfill import backfill
from tickbars.schemas import CANDLE
from tickbars.sinks.tables import overwrite_days, read_candles

_KEYS = ["day", "ticker"]
_SUMS = ["n", "value", "mark"]


def checksums(candles: DataFrame) -> DataFrame:
    """Per day and ticker the number of candles, their turnover, and the exclusive or of their hashes; no order matters."""
    mark = F.bit_xor(F.xxhash64(*CANDLE.names)).alias("mark")
    return candles.groupBy(F.to_date("datetime").alias("day"), "ticker").agg(
        F.count("*").alias("n"), F.sum("value").alias("value"), mark
    )


def repair_plan(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Days and tickers whose stored candles are not those made of the trades, with the number of either.

    Candles are compared by their checksums, so one row per day and ticker meets another, not every candle.
    """
    left, right = checksums(stored).alias("s"), checksums(made).alias("m")
    same = " and ".join(f"s.{c} <=> m.{c}" for c in _SUMS)
    return left.join(right, _KEYS, "full_outer").where(f"not ({same})").select(
        *_KEYS, F.coalesce("s.n", F.lit(0)).alias("n_stored"), F.coalesce("m.n", F.lit(0)).alias("n_made")
    )


def damaged_days(plan: DataFrame) -> list[dt.date]:
    """The days that a repair plan names."""
    return sorted(d for (d,) in plan.select("day").distinct().collect())


def repair(deals: DataFrame, path: str, minutes: int = 5, **how: str) -> list[dt.date]:
    """Makes the candle table at `path` agree with the trades table; returns the days that were written anew.

    Candles without trades go too. Days that agree are neither read again nor written.
    """
    spark = deals.sparkSession
    days = damaged_days(repair_plan(read_candles(spark, path), backfill(deals, minutes, **how)))
    if days:
        overwrite_days(backfill(filter_days(deals, days), minutes, **how), path, days)
    return days
