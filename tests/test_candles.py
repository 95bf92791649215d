from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at, by_key, trade, trades
from tickbars import operators as op


def make(spark, rows, **how):
    return by_key(op.candles(op.valid_trades(trades(spark, rows)), **how))


def test_bucket_edge(spark):
    got = make(spark, [trade(1, "10:04:59", 1.0), trade(2, "10:05:00", 2.0)])
    assert got == {
        (at(10, 0), "SBER"): (1.0, 1.0, 1.0, 1.0, 100),
        (at(10, 5), "SBER"): (2.0, 2.0, 2.0, 2.0, 100),
    }


def test_open_high_low_close(spark):
    rows = [trade(4, "10:03:00", 7.0), trade(1, "10:00:00", 5.0), trade(3, "10:02:00", 3.0), trade(2, "10:01:00", 9.0)]
    assert make(spark, rows) == {(at(10, 0), "SBER"): (5.0, 9.0, 3.0, 7.0, 400)}


@pytest.mark.parametrize("order", ["packed", "wide"])
def test_same_second_is_ordered_by_number(spark, order):
    rows = [trade(2, "10:00:01", 12.0), trade(1, "10:00:01", 10.0)]
    assert make(spark, rows, order=order)[at(10, 0), "SBER"][::3] == (10.0, 12.0)
    assert make(spark, rows, order=order, tie="reverse")[at(10, 0), "SBER"][::3] == (12.0, 10.0)


def test_time_goes_before_number(spark):
    rows = [trade(9, "10:00:01", 1.0), trade(1, "10:00:02", 2.0)]
    for order in ("packed", "wide"):
        for tie in ("tradeNo", "reverse"):
            assert make(spark, rows, order=order, tie=tie)[at(10, 0), "SBER"][::3] == (1.0, 2.0)


def test_value_is_truncated_per_trade(spark):
    assert make(spark, [trade(1, "10:00:00", value=1.9), trade(2, "10:00:01", value=1.9)])[at(10, 0), "SBER"][4] == 2
    assert make(spark, [trade(1, "10:00:00", value=-1.9)])[at(10, 0), "SBER"][4] == -1


def test_large_turnover(spark):
    rows = [trade(i, "10:00:00", value=2_000_000_000.0) for i in (1, 2)]
    assert make(spark, rows)[at(10, 0), "SBER"][4] == 4_000_000_000


def test_hour_with_and_without_zero(spark):
    got = make(spark, [trade(1, "9:01:00", 1.0), trade(2, "09:02:00", 2.0)])
    assert got == {(at(9, 0), "SBER"): (1.0, 2.0, 1.0, 2.0, 200)}


def test_tickers_and_days_are_apart(spark):
    rows = [trade(1, "10:00:00"), trade(2, "10:00:00", sec="GAZP"), trade(3, "10:00:00", date="02.09.2021")]
    assert set(make(spark, rows)) == {(at(10, 0), "SBER"), (at(10, 0), "GAZP"), (at(10, 0, day=2), "SBER")}


@pytest.mark.parametrize("minutes", [7, 0, -5, 120, 2.5])
def test_width_has_to_divide_the_hour(spark, minutes):
    with pytest.raises(ValueError):
        make(spark, [trade(1, "10:00:00")], minutes=minutes)


def test_unknown_order_and_tie(spark):
    for how in ({"order": "x"}, {"tie": "x"}):
        with pytest.raises(ValueError):
            make(spark, [trade(1, "10:00:00")], **how)


def test_packed_order_refuses_numbers_it_cannot_hold(spark):
    big = (1 << 54) - 1
    assert make(spark, [trade(big, "10:04:59", 3.0), trade(0, "10:04:59", 2.0)], order="packed")[at(10, 0), "SBER"][::3] == (2.0, 3.0)
    for no in (big + 1, -1):
        with pytest.raises(Exception, match="use order='wide'"):
            make(spark, [trade(no, "10:00:00")], order="packed")
        assert len(make(spark, [trade(no, "10:00:00")])) == 1


def test_wide_order_holds_any_number(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [trade(high, "10:00:01", 1.0), trade(low, "10:00:01", 2.0), trade(5, "10:00:02", 3.0), trade(7, "10:00:00", 4.0)]
    assert make(spark, rows[:2], order="wide")[at(10, 0), "SBER"][::3] == (2.0, 1.0)
    assert make(spark, rows[:2], order="wide", tie="reverse")[at(10, 0), "SBER"][::3] == (1.0, 2.0)
    assert make(spark, rows, order="wide")[at(10, 0), "SBER"][::3] == (4.0, 3.0)


def brute(rows, minutes):
    """Candles by sorting lists in Python."""
    groups = {}
    for r in rows:
        h, m, s = map(int, r[2].split(":"))
        groups.setdefault((at(h, m // minutes * minutes, day=int(r[1][:2])), r[3]), []).append(((h, m, s, r[0]), r[5], int(r[7])))
    out = {}
    for key, items in groups.items():
        items.sort()
        prices = [p for _, p, _ in items]
        out[key] = (prices[0], max(prices), min(prices), prices[-1], sum(v for *_, v in items))
    return out


@pytest.mark.parametrize("minutes", [1, 5, 60])
def test_against_brute_force_with_a_hot_ticker(spark, minutes):
    rnd = random.Random(minutes)
    rows = [
        trade(
            i,
            f"{rnd.randint(9, 11):02d}:{rnd.randint(0, 59):02d}:{rnd.randint(0, 59):02d}",
            round(rnd.uniform(1, 100), 2),
            round(rnd.uniform(-10, 1000), 2),
            "HOT" if rnd.random() < 0.4 else f"T{rnd.randint(0, 9)}",
            f"0{rnd.randint(1, 3)}.09.2021",
        )
        for i in range(3000)
    ]
    want = brute(rows, minutes)
    rnd.shuffle(rows)
    for partitions in (1, 7):
        df = op.valid_trades(trades(spark, rows, partitions))
        assert by_key(op.candles(df, minutes)) == want
        assert by_key(op.candles(df, minutes, order="packed")) == want
    for o, h, low, c, _ in want.values():
        assert low <= min(o, c) and max(o, c) <= h
    assert sum(v[4] for v in want.values()) == sum(int(r[7]) for r in rows)


@pytest.mark.parametrize("order", ["wide", "packed"])
def test_hot_candle_reaches_the_shuffle_as_one_row_per_task(spark, order):
    df = op.candles(op.valid_trades(trades(spark, [trade(1, "10:00:00")])), order=order)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert plan.index("Exchange") < plan.index("partial_min_by")  # below the exchange


def test_microbatch_keeps_the_first_part(spark):
    rows = [(trade(1, "10:00:10", 1.0), 0), (trade(2, "10:03:00", 2.0), 1), (trade(3, "10:04:50", 3.0), 1)]
    df = op.valid_trades(trades(spark, [r for r, _ in rows])).join(
        spark.createDataFrame([(r[0], b) for r, b in rows], "tradeNo bigint, batch bigint"), "tradeNo"
    )
    assert by_key(op.microbatch_candles(df, "batch")) == {(at(10, 0), "SBER"): (1.0, 1.0, 1.0, 1.0, 100)}
    assert by_key(op.candles(df)) == {(at(10, 0), "SBER"): (1.0, 3.0, 1.0, 3.0, 300)}


def test_series_and_back(spark):
    rows = [trade(i, f"10:{m:02d}:00", float(i), sec=s) for i, (m, s) in enumerate([(50, "A"), (5, "A"), (20, "B"), (10, "A")])]
    flat = op.candles(op.valid_trades(trades(spark, rows)))
    series = op.day_series(flat)
    got = {r.ticker: [c.datetime.minute for c in r.series] for r in series.collect()}
    assert got == {"A": [5, 10, 50], "B": [20]}
    back = op.explode_series(series)
    assert by_key(back) == by_key(flat)
    assert sorted((r.ticker, r.pos) for r in back.collect()) == [("A", 0), ("A", 1), ("A", 2), ("B", 0)]


def test_global_order(spark):
    rows = [trade(i, f"{9 + i % 5:02d}:00:00", sec=f"T{i % 7}", date=f"0{1 + i % 3}.09.2021") for i in range(60)]
    got = [(r.datetime.date(), r.ticker, r.datetime) for r in op.ordered_candles(op.candles(op.valid_trades(trades(spark, rows, 4)))).collect()]
    assert got == sorted(got)


def test_serving_types(spark):
    df = op.cast_serving(op.candles(op.valid_trades(trades(spark, [trade(1, "10:00:00", 10.126)]))))
    assert {f.dataType.simpleString() for f in df.schema.fields[2:]} == {"decimal(10,2)"}
    assert str(df.first().open) == "10.13"


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo", "Pacific/Apia"])
def test_session_zone_does_not_matter(spark, zone):
    # 02:30 on this day does not exist in New York.
    rows = [trade(1, "02:31:00", 1.0, date="14.03.2021"), trade(2, "02:34:00", 2.0, date="14.03.2021")]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = op.candles(op.valid_trades(trades(spark, rows))).withColumn("text", F.col("datetime").cast("string"))
        assert [(r.text, r.open, r.close) for r in df.collect()] == [("2021-03-14 02:30:00", 1.0, 2.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
