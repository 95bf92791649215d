from __future__ import annotations

import json

import pytest

from helpers import at, message, messages
from tickbars import operators as op
from tickbars.sources import cut_points, range_predicates

HELD = "topic string, partition int, from_offset bigint, until_offset bigint"
SAVED = "app_name string, topic string, part int, last_offset bigint"


def positions(df):
    return {(r.topic, r.partition): (r.position, r.rule) for r in df.collect()}


def test_start_positions(spark):
    held = spark.createDataFrame([("a", 0, 10, 20), ("a", 1, 10, 20), ("a", 2, 10, 20), ("a", 3, 10, 20), ("a", 4, 10, 20), ("b", 0, 0, 0)], HELD)
    saved = [("x", "a", 0, 10), ("x", "a", 1, 20), ("x", "a", 2, 9), ("x", "a", 3, 21), ("x", "b", 0, 0), ("x", "c", 0, 7)]
    got = op.start_positions(spark.createDataFrame(saved, SAVED), held)
    want = {
        ("a", 0): (10, "saved"), ("a", 1): (20, "saved"), ("a", 2): (20, "outside"), ("a", 3): (20, "outside"),
        ("a", 4): (10, "unsaved"), ("b", 0): (0, "saved"), ("c", 0): (7, "not held"),
    }
    assert positions(got) == want
    left = op.start_positions(spark.createDataFrame(saved, SAVED), held, unsaved="leave")
    assert positions(left) == {k: v for k, v in want.items() if k != ("a", 4)}
    assert json.loads(op.starting_offsets(got))["a"] == {"0": 10, "1": 20, "2": 20, "3": 20, "4": 10}
    none = spark.createDataFrame([], SAVED)
    assert set(positions(op.start_positions(none, held)).values()) == {(20, "ends"), (0, "ends")}
    with pytest.raises(ValueError, match="no position"):
        op.start_positions(none, held.where("false"))
    with pytest.raises(ValueError):
        op.start_positions(none, held, unsaved="other")


def test_planned_batches(spark):
    ranges = spark.createDataFrame([("a", 0, 5, 12), ("a", 1, 0, 3), ("b", 0, 4, 4)], HELD)
    got = sorted(map(tuple, op.planned_batches(ranges, 3).collect()))
    assert got == [(0, "a", 0, 5, 8), (0, "a", 1, 0, 3), (1, "a", 0, 8, 11), (2, "a", 0, 11, 12)]
    options = op.batch_options(op.planned_batches(ranges, 3), 0)
    assert {k: json.loads(v) for k, v in options.items()} == {"startingOffsets": {"a": {"0": 5, "1": 0}}, "endingOffsets": {"a": {"0": 8, "1": 3}}}
    long = spark.createDataFrame([("a", 0, 0, 250_001)], HELD)
    many = op.planned_batches(long, 1)
    assert many.count() == 250_001 and many.agg({"until_offset": "max"}).first()[0] == 250_001
    with pytest.raises(ValueError):
        op.planned_batches(ranges, 0)
    sent = messages(spark, [message("x", o, partition=p, topic="a") for p, o in [(0, 4), (0, 5), (0, 8), (0, 11), (0, 12), (1, 2), (7, 1)]])
    got = {(r.partition, r.offset, r.batch_id) for r in op.with_planned_batch(sent, ranges, 3).collect()}
    assert got == {(0, 5, 0), (0, 8, 1), (0, 11, 2), (1, 2, 0)}


def test_ranges_of_equal_size(spark):
    jumping = spark.range(10_000).selectExpr("if(id % 100 = 0, null, (id div 1000) * 1000000000 + id % 1000) as x")
    predicates = range_predicates(jumping, "x", 8)
    sizes = [jumping.where(p).count() for p in predicates]
    assert sum(sizes) == 10_000 and len(sizes) == 8 and max(sizes) < 1.2 * 10_000 / 8
    # A value of a third of the rows has a range of its own.
    skewed = spark.range(9_000).selectExpr("if(id % 3 = 0, 7, id) as x")
    parts = [skewed.where(p).count() for p in range_predicates(skewed, "x", 6)]
    assert sum(parts) == 9_000 and sorted(parts)[-2] < 2 * 9_000 / 6
    none = spark.createDataFrame([], "x bigint")
    assert range_predicates(none, "x", 4) == ["1 = 1"] and cut_points(none, "x", 1) == []


def test_watermark_is_that_of_earlier_batches(spark):
    rows = [(0, at(10, 0)), (0, at(10, 30)), (1, at(10, 12)), (1, at(10, 14)), (1, at(10, 21)), (2, at(11, 0)), (3, at(10, 47)), (None, at(8, 0))]
    df = spark.createDataFrame(rows, "batch int, dt timestamp_ntz")
    marks = {r.batch: r.watermark for r in op.watermarks(df, "batch", "10 minutes").collect()}
    # Batch 1 brings nothing newer, so batch 2 has its watermark; a row without a batch comes before all others.
    assert marks[1] == marks[2] == at(10, 20) and marks[3] == at(10, 50)
    late = {(r.batch, r.dt) for r in op.late_trades(df, "batch").collect()}
    # The candle of 10:14 ends at 10:15; the one of 10:47 at the watermark itself.
    assert late == {(1, at(10, 12)), (1, at(10, 14)), (3, at(10, 47))}
    assert op.trades_in_time(df, "batch").count() == len(rows) - 3
    assert op.late_trades(df, "batch", minutes=60).count() == 0


def test_numbers_seen(spark):
    rows = [(n, at(10, 0, day=d)) for d in (1, 2) for n in (0, 1, -1, 32_768, 32_769, -40_000, (1 << 62) + 3)]
    df = spark.createDataFrame(rows, "tradeNo bigint, dt timestamp_ntz")
    seen = op.number_bitmaps(df.where("to_date(dt) = date'2021-09-01' and tradeNo not in (1, -40000)"))
    fresh = {(r.dt.day, r.tradeNo) for r in op.unseen_trades(df, op.merge_bitmaps(seen.unionByName(seen))).collect()}
    assert fresh == {(1, 1), (1, -40_000)} | {(2, n) for n, t in rows if t.day == 2}
    assert {(r.day.day, r.n) for r in op.count_numbers(op.number_bitmaps(df.unionByName(df))).collect()} == {(1, 7), (2, 7)}
    assert op.unseen_trades(df, seen.where("false")).count() == len(rows)


def test_sketches_are_exact_for_few_values(spark):
    df = spark.range(1000).selectExpr("if(id = 5, null, id) as size", "id % 2 as half", "id % 4 as part")
    parts = op.value_sketches(df, "size", ["half", "part"])
    whole = op.merge_sketches(parts, ["half"]).select("half", "n", op.quantile_of(0.5).alias("q"), op.quantile_of(1.0).alias("top"))
    got = {r.half: (r.n, r.q, r.top) for r in whole.collect()}
    assert got == {0: (500, 498, 998), 1: (499, 501, 999)}
