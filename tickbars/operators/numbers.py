"""Exact sets of trade numbers, as bitmaps, beside a table of candles.

A bitmap row holds 32,768 consecutive numbers of one day in 4 KB. A trade that comes again is noticed however much later
that is, where a watermark has forgotten it; a number may come on another day as another trade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("bitmap", T.BinaryType()), T.StructField("day", T.DateType())]
)
_KEYS = ["day", "bucket"]


def number_bitmaps(trades: DataFrame) -> DataFrame:
    """The numbers of valid trades, a row per day and bucket of numbers."""
    keyed = trades.select(
        F.to_date("dt").alias("day"),
        F.bitmap_bucket_number("tradeNo").alias("bucket"),
        F.bitmap_bit_position("tradeNo").alias("bit"),
    )
    return keyed.groupBy(*_KEYS).agg(F.bitmap_construct_agg("bit").alias("bitmap")).select(*NUMBERS.names)


def merge_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One row per day and bucket of bitmaps that were made at different times."""
    return bitmaps.groupBy(*_KEYS).agg(F.bitmap_or_agg("bitmap").alias("bitmap")).select(*NUMBERS.names)


def count_numbers(bitmaps: DataFrame) -> DataFrame:
    """How many numbers each day has."""
    return merge_bitmaps(bitmaps).groupBy("day").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def unseen_trades(trades: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Valid trades whose number is not among those of its day. `bitmaps` has one row per day and bucket (`merge_bitmaps`)."""
    keyed = trades.withColumns(
        {
            "_day": F.to_date("dt"),
            "_bucket": F.bitmap_bucket_number("tradeNo"),
            "_bit": F.bitmap_bit_position("tradeNo"),
        }
    )
    seen = bitmaps.select(F.col("day").alias("_day"), F.col("bucket").alias("_bucket"), "bitmap")
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    known = F.getbit(byte, F.expr("cast(_bit % 8 as int)")) == 1
    joined = keyed.join(seen, ["_day", "_bucket"], "left")
    return joined.where(~F.coalesce(known, F.lit(False))).select(*trades.columns)
