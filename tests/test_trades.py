from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from helpers import at, trade, trades
from tickbars import functions as TF
from tickbars import operators as op
from tickbars.schemas import DEAL


@pytest.mark.parametrize(
    ("date", "time", "want"),
    [
        ("01.09.2021", "10:00:00", at(10, 0)),
        ("01.09.2021", "9:01:00", at(9, 1)),
        ("01.09.2021", "9:1:5", at(9, 1, 5)),
        ("1.9.2021", "10:00:00", at(10, 0)),
        ("29.02.2020", "23:59:59", dt.datetime(2020, 2, 29, 23, 59, 59)),
        ("31.02.2021", "10:00:00", None),
        ("01.13.2021", "10:00:00", None),
        ("01.09.2021", "24:00:00", None),
        ("01.09.2021", "10:60:00", None),
        ("01.09.2021", "10:00", None),
        ("01.09.2021", "10:00:0Z", None),
        ("01.09.2021", "10:00:+1", None),
        ("01.09.2021", "", None),
        ("01.09.2021", "10:00:00.5", None),
        ("01.09.2021", "10:00:5.", None),
        ("01.09.2021", "10:00:5 ", None),
        ("01.09.2021", "10:00:00Z", None),
        ("01.09.2021", "10:00:00 GMT+1", None),
        ("01.09.2021", "10:00:00+01:00", None),
        ("01.09.2021", " 10:00:00", None),
        ("01.09.2021", "10", None),
        ("01.09.2021", "T10:00:00", None),
        ("01.09.2021", "10:00:60", None),
        ("1.9.2021", "9:5:7", at(9, 5, 7)),
        ("1.9.2021", "10:00:00Z", None),
        ("1.9.2021.1", "10:00:00", None),
        ("01.09.20211", "10:00:00", None),
        ("01.9..2021", "10:00:00", None),
        ("01.09.+202", "10:00:00", None),
        ("01/09/2021", "10:00:00", None),
        ("01.09.21", "10:00:00", None),
        ("2021-09-01", "10:00:00", None),
        ("", "10:00:00", None),
        (None, "10:00:00", None),
        ("01.09.2021", None, None),
    ],
)
def test_event_time(spark, date, time, want):
    df = spark.createDataFrame([(date, time)], "d string, t string")
    row = df.select(TF.event_time("d", "t").alias("dt"), TF.trade_day("d").alias("day")).first()
    assert row.dt == want
    if want:
        assert row.day == want.date()


def test_instant_and_back(spark):
    df = spark.sql("select explode(sequence(timestamp_ntz'2021-03-14 00:00:00', timestamp_ntz'2021-03-15 00:00:00', interval 7 minute)) dt")
    df = df.withColumn("i", TF.to_instant("dt"))
    bad = df.where((TF.from_instant("i") != F.col("dt")) | (F.date_format("i", "yyyy-MM-dd HH:mm:ss") != F.substring(F.col("dt").cast("string"), 1, 19)))
    assert df.count() == 206 and bad.count() == 0


def test_time_key(spark):
    df = op.time_key(trades(spark, [trade(1, "09:59:59"), trade(2, "10:04:00")]), 5)
    assert [(r.day, r.hour, r.tick) for r in df.orderBy("tradeNo").collect()] == [
        (dt.date(2021, 9, 1), "09", 11),
        (dt.date(2021, 9, 1), "10", 0),
    ]


def test_problems(spark):
    rows = [
        trade(None, "10:00:00"),
        trade(2, "10:00:00", sec=None),
        trade(3, "10:00:00", price=None),
        trade(4, "10:00:00", price=math.nan),
        trade(5, "10:00:00", value=math.inf),
        trade(6, "10:00:00", value=1e19),
        trade(7, "10:00:99"),
        trade(8, "10:00:00"),
        trade(9, "10:00:00", value=None),
    ]
    df = trades(spark, rows)
    bad = {r.tradeNo: r.problem for r in op.invalid_trades(df).collect()}
    assert bad == {None: "tradeNo", 2: "secId", 3: "price", 4: "price", 5: "value", 6: "value", 7: "time"}
    assert [r.tradeNo for r in op.valid_trades(df).collect()] == [8, 9]
    assert [r.value for r in op.candles(op.valid_trades(df)).collect()] == [100]


def test_dedup_is_whole_and_does_not_depend_on_order(spark):
    rows = [trade(1, "10:00:00")] * 500 + [trade(2, "10:00:00", 5.0), trade(2, "10:00:00", 4.0), trade(3, "10:01:00")]
    for df in (trades(spark, rows, 6), trades(spark, rows[::-1], 3)):
        assert sorted((r.tradeNo, r.price) for r in op.dedup_trades(df).collect()) == [(1, 10.0), (2, 4.0), (3, 10.0)]
        assert sorted((r.tradeNo, r.n) for r in op.dup_trades(df).collect()) == [(1, 500), (2, 2)]
        assert op.dedup_trades(df).columns == df.columns


def test_first_trades(spark):
    df = trades(spark, [trade(i, "10:00:00") for i in (5, 3, 9, 1)], 4)
    assert [r.tradeNo for r in op.first_trades(df, 2).collect()] == [1, 3]


def deals(spark):
    rows = [(i, f"0{1 + i % 2}.09.2021", "10:00:00", "SBER", "TQBR", i + 0.5, i, 10.25, "REGULAR", "B", "MAIN") for i in range(4)]
    names = ["TRADENO", "TRADEDATE", "TRADETIME", "SECID", "BOARDID", "PRICE", "QUANTITY", "VALUE", "TYPE", "BUYSELL", "TRADINGSESSION"]
    df = spark.createDataFrame(rows, names)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in DEAL.fields])


def test_day_filter_reaches_the_scan(spark, tmp_path):
    deals(spark).write.parquet(str(tmp_path / "deals"))
    stored = spark.read.parquet(str(tmp_path / "deals"))
    day = op.deals_to_trades(op.filter_day(stored, dt.date(2021, 9, 2)))
    assert sorted(r.tradeNo for r in day.collect()) == [1, 3]
    bare = stored.withColumn("TRADEDATE", F.regexp_replace("TRADEDATE", "(^|[.])0", "$1"))
    both = op.filter_day(stored.union(bare), dt.date(2021, 9, 2))
    assert sorted(r.TRADENO for r in both.collect()) == [1, 1, 3, 3]
    plan = op.candles(op.valid_trades(day))._jdf.queryExecution().executedPlan().toString()
    assert "In(TRADEDATE, [02.09.2021,02.9.2021,2.09.2021,2.9.2021])" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "BOARDID" not in schema and "QUANTITY" not in schema


def test_shift_and_text_of_days(spark):
    row = spark.range(1).select(TF.iso_day(TF.shift_day(F.lit(dt.date(2021, 3, 1)), -1)).alias("d")).first()
    assert row.d == "2021-02-28"
    assert TF.day_spellings(dt.date(2021, 9, 1)) == ["01.09.2021", "01.9.2021", "1.09.2021", "1.9.2021"]
    assert TF.day_spellings(dt.date(2021, 12, 31)) == ["31.12.2021"]
