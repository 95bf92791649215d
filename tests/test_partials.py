from __future__ import annotations

import datetime as dt
import itertools
import random

from helpers import at, trade, trades
from tickbars import operators as op
from tickbars.schemas import PARTIAL


def some_trades(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        time = f"10:{rng.randrange(60):02d}:{rng.choice([0, 0, 30]):02d}"
        rows.append(trade(rng.choice([i, -i, (1 << 62) + i]), time, rng.randrange(100) / 4, rng.randrange(1000) - 300.5, rng.choice("AB")))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select(*PARTIAL.names).collect()))


def test_any_grouping_of_parts_gives_the_same(spark):
    rows = some_trades()
    whole = op.valid_trades(trades(spark, rows))
    for tie in ("tradeNo", "reverse"):
        want = rows_of(op.candle_partials(whole, 15, tie=tie))
        assert [r[:7] for r in want] == sorted(map(tuple, op.candles(whole, 15, tie=tie).collect()))
        parts = [op.candle_partials(op.valid_trades(trades(spark, rows[i::3])), 5, tie=tie) for i in range(3)]
        for order in itertools.permutations(range(3), 3):
            a, b, c = (parts[i] for i in order)
            once = op.combine_candles(a.unionByName(b).unionByName(c), 15, tie)
            twice = op.combine_candles(op.combine_candles(a.unionByName(b), tie=tie).unionByName(c), 15, tie)
            assert rows_of(once) == rows_of(twice) == want


def test_first_and_last_trade(spark):
    rows = [trade(5, "10:00:01", 1.0), trade(4, "10:00:01", 2.0), trade(9, "10:04:00", 3.0, None), trade(8, "10:03:59", 4.0)]
    (got,) = op.candle_partials(op.valid_trades(trades(spark, rows))).collect()
    assert (got.open, got.open_no, got.close, got.close_no, got.trades, got.value) == (2.0, 4, 3.0, 9, 4, 300)
    assert (got.open_time, got.close_time) == (dt.datetime(2021, 9, 1, 10, 0, 1), at(10, 4))


def test_grouped_by_a_batch(spark):
    rows = [trade(i, "10:00:00", float(i)) for i in range(6)]
    batched = op.valid_trades(trades(spark, rows)).selectExpr("*", "tradeNo % 2 as batch")
    got = {(r.batch, r.open, r.close, r.trades) for r in op.candle_partials(batched, by=["batch"]).collect()}
    assert got == {(0, 0.0, 4.0, 3), (1, 1.0, 5.0, 3)}


def test_nothing_to_combine(spark):
    assert op.combine_candles(spark.createDataFrame([], PARTIAL), 60).count() == 0


def test_hash_aggregate_and_one_shuffle(spark):
    plan = op.combine_candles(spark.createDataFrame([], PARTIAL).repartition(3), 60)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
