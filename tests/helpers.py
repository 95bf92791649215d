"""Small trades and messages made by hand."""

from __future__ import annotations

import datetime as dt
import json

from tickbars.schemas import MESSAGE, TRADE


def trade(no, time, price=10.0, value=100.0, sec="SBER", date="01.09.2021", quantity=1):
    return (no, date, time, sec, "TQBR", price, quantity, value, "B", "MAIN")


def trades(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, TRADE)
    return df.repartition(partitions) if partitions else df


def payload(row):
    return json.dumps(dict(zip(TRADE.names, row)))


def message(value, offset, headers=(("eventType", "MARKET_RECORD"),), partition=0, topic="trades"):
    packed = None if headers is None else [(k, None if v is None else bytearray(v.encode())) for k, v in headers]
    data = None if value is None else bytearray(value.encode())
    return (None, data, topic, partition, offset, dt.datetime(2021, 9, 1), packed)


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def at(hour, minute, second=0, day=1):
    return dt.datetime(2021, 9, day, hour, minute, second)


def by_key(candle_df):
    return {
        (r.datetime, r.ticker): (r.open, r.high, r.low, r.close, r.value)
        for r in candle_df.collect()
    }
