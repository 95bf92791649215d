from __future__ import annotations

import datetime as dt
import sqlite3
import time

import pytest
from pyspark.sql import types as T

from helpers import at, by_key, trade, trades
from tickbars import files
from tickbars import operators as op
from tickbars.schemas import CANDLE, CANDLE_KEYS, CANDLE_VERSION, PARTIAL
from tickbars.sinks import (
    UpsertDataSource,
    candle_database,
    candle_table,
    merge_candles,
    overwrite_days,
    read_candles,
    save_candles,
    tables,
)
from tickbars.sinks.upsert_source import UpsertWriter, upsert_statement


def candle(ticker, close, when=None, value=1):
    return (when or at(10, 0), ticker, 1.0, 9.0, 1.0, close, value)


def frame(spark, rows):
    return spark.createDataFrame(rows, CANDLE)


def closes(df):
    return {r.ticker: r.close for r in df.collect()}


def test_policies(spark):
    old = frame(spark, [candle("A", 1.0), candle("B", 1.0)])
    new = frame(spark, [candle("B", 2.0), candle("C", 2.0)]).select(*reversed(CANDLE.names))
    kept = op.upsert(old, new, CANDLE_KEYS, "keep_first")
    assert kept.columns == CANDLE.names
    assert closes(kept) == {"A": 1.0, "B": 1.0, "C": 2.0}
    assert closes(op.upsert(old, new, CANDLE_KEYS, "replace")) == {"A": 1.0, "B": 2.0, "C": 2.0}
    with pytest.raises(ValueError):
        op.upsert(old, new, CANDLE_KEYS, "other")
    with pytest.raises(ValueError):
        op.upsert(old, new.drop("close"), CANDLE_KEYS)
    with pytest.raises(ValueError):
        op.upsert(old, new, CANDLE_KEYS, "newest")
    with pytest.raises(ValueError):
        op.upsert(old, new, CANDLE_KEYS, "replace", ["value"])


def state(ticker, close, count, last=None, no=1):
    return (at(10, 0), ticker, 1.0, 9.0, 1.0, close, 1, at(10, 0), 1, last or at(10, 1), no, count)


def test_newest_by_trades_then_time_then_number(spark):
    older = [state("A", 1.0, 2), state("B", 1.0, 3), state("C", 1.0, 2), state("D", 1.0, 2, no=5), state("E", 1.0, 1)]
    newer = [state("A", 2.0, 3), state("B", 2.0, 2, at(10, 4)), state("C", 2.0, 2, at(10, 2)), state("D", 2.0, 2, no=7), state("F", 2.0, 1)]
    old, new = spark.createDataFrame(older, PARTIAL), spark.createDataFrame(newer, PARTIAL)
    want = {"A": 2.0, "B": 1.0, "C": 2.0, "D": 2.0, "E": 1.0, "F": 2.0}
    for sides in ((old, new), (new, old)):
        assert closes(op.upsert(*sides, CANDLE_KEYS, "newest", CANDLE_VERSION)) == want
    # Null is the least; of equal versions the incoming one stays.
    none = spark.createDataFrame([(*state("A", 3.0, 2)[:9], None, None, 2)], PARTIAL)
    assert closes(op.upsert(old, none, CANDLE_KEYS, "newest", CANDLE_VERSION))["A"] == 1.0
    assert closes(op.upsert(none, old, CANDLE_KEYS, "newest", CANDLE_VERSION))["A"] == 1.0
    again = spark.createDataFrame([state("A", 4.0, 2)], PARTIAL)
    assert closes(op.upsert(old, again, CANDLE_KEYS, "newest", CANDLE_VERSION))["A"] == 4.0


def test_null_of_the_winner_stays(spark):
    old, new = frame(spark, [candle("A", 1.0)]), frame(spark, [candle("A", None)])
    assert closes(op.upsert(old, new, CANDLE_KEYS, "replace")) == {"A": None}
    assert closes(op.upsert(new, old, CANDLE_KEYS, "keep_first")) == {"A": None}


def test_twice_is_once(spark):
    old = frame(spark, [candle("A", 1.0)])
    new = frame(spark, [candle("A", 2.0), candle("B", 2.0)])
    for policy in ("keep_first", "replace"):
        once = op.upsert(old, new, CANDLE_KEYS, policy)
        assert sorted(op.upsert(once, new, CANDLE_KEYS, policy).collect()) == sorted(once.collect())


def days_of(df):
    return {(r.trade_date.day, r.ticker): r.close for r in df.collect()}


def folders(spark, path, day):
    return [m for m in files.children(spark, f"{path}/data") if files.is_dir(spark, f"{path}/data/{m}/trade_date={day}")]


def test_merge_touches_its_days_only(spark, tmp_path):
    path = str(tmp_path / "candles")
    assert days_of(read_candles(spark, path)) == {}
    merge_candles(frame(spark, [candle("A", 1.0), candle("A", 1.0, at(10, 0, day=2))]), path)
    begun = read_candles(spark, path)
    merge_candles(frame(spark, [candle("A", 2.0, at(10, 0, day=2)), candle("B", 2.0, at(10, 0, day=3))]), path)
    want = {(1, "A"): 1.0, (2, "A"): 2.0, (3, "B"): 2.0}
    assert days_of(read_candles(spark, path)) == want
    assert days_of(begun) == {(1, "A"): 1.0, (2, "A"): 1.0}
    assert len(folders(spark, path, "2021-09-01")) == 1 and len(folders(spark, path, "2021-09-02")) == 2
    assert len(files.children(spark, f"{path}/commits/2021-09-01")) == 1
    merge_candles(frame(spark, [candle("B", 5.0, at(10, 0, day=3))]), path, "keep_first")
    merge_candles(frame(spark, []), path)
    assert days_of(read_candles(spark, path)) == want
    assert days_of(read_candles(spark, path, [dt.date(2021, 9, 2), dt.date(2021, 9, 9)])) == {(2, "A"): 2.0}


def test_replaced_folders_go_by_age(spark, tmp_path):
    path, short = str(tmp_path / "candles"), str(tmp_path / "short")
    for i in range(4):
        rows = frame(spark, [candle("A", float(i)), candle(f"T{i}", 1.0)])
        merge_candles(rows, path)
        time.sleep(0.01)
        merge_candles(rows, short, keep_hours=0.0)
    want = {"A": 3.0, "T0": 1.0, "T1": 1.0, "T2": 1.0, "T3": 1.0}
    assert closes(read_candles(spark, path)) == closes(read_candles(spark, short)) == want
    assert len(folders(spark, path, "2021-09-01")) == 4
    # The one that holds the candles, and the one that the last merge has replaced.
    assert len(folders(spark, short, "2021-09-01")) <= 2


def test_a_slow_reader_still_reads(spark, tmp_path):
    path = str(tmp_path / "candles")
    merge_candles(frame(spark, [candle("A", 0.0)]), path)
    begun = read_candles(spark, path)
    for i in range(3):
        merge_candles(frame(spark, [candle("A", 1.0 + i)]), path)
    assert closes(begun) == {"A": 0.0}


@pytest.mark.parametrize("day", [1, 2])
def test_two_writers_both_survive(spark, tmp_path, monkeypatch, day):
    path = str(tmp_path / "candles")
    merge_candles(frame(spark, [candle("OLD", 1.0)]), path)
    real, times = tables._write, []

    def between(*args):
        times.append(1)
        out = real(*args)
        if len(times) == 1:  # the other writer's whole merge lies between this one's files and its commits
            merge_candles(frame(spark, [candle("OTHER", 2.0, at(10, 0, day=day))]), path)
        return out

    monkeypatch.setattr(tables, "_write", between)
    merge_candles(frame(spark, [candle("MINE", 3.0), candle("MORE", 3.0, at(10, 0, day=3))]), path)
    assert closes(read_candles(spark, path)) == {"OLD": 1.0, "OTHER": 2.0, "MINE": 3.0, "MORE": 3.0}
    # Written anew only if the other one had touched the same day, and only that day.
    assert len(times) == (3 if day == 1 else 2)
    assert len(files.children(spark, f"{path}/commits/2021-09-03")) == 1


def test_a_writer_that_died_between_number_and_name(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "candles")
    merge_candles(frame(spark, [candle("A", 1.0)]), path)
    assert files.create_text(spark, f"{path}/commits/2021-09-01/000000000002", "")
    monkeypatch.setattr(tables._newest, "__defaults__", (0.1,))
    assert closes(read_candles(spark, path)) == {"A": 1.0}
    merge_candles(frame(spark, [candle("B", 1.0)]), path)
    assert closes(read_candles(spark, path)) == {"A": 1.0, "B": 1.0}


def test_days_overwritten(spark, tmp_path):
    path = str(tmp_path / "candles")
    merge_candles(frame(spark, [candle(t, 1.0, at(10, 0, day=d)) for t in "AB" for d in (1, 2, 3)]), path)
    fresh = frame(spark, [candle("A", 2.0), candle("C", 2.0, at(10, 0, day=3))])
    overwrite_days(fresh, path, [dt.date(2021, 9, 1), dt.date(2021, 9, 2), dt.date(2021, 9, 4)])
    assert days_of(read_candles(spark, path)) == {(1, "A"): 2.0, (3, "A"): 1.0, (3, "B"): 1.0}
    merge_candles(frame(spark, [candle("D", 4.0, at(10, 0, day=2))]), path)
    assert days_of(read_candles(spark, path))[2, "D"] == 4.0


def test_files_of_a_day(spark, tmp_path):
    path = str(tmp_path / "candles")
    merge_candles(frame(spark, [candle(f"T{i}", 1.0, at(h, 0)) for h in range(8, 20) for i in range(20)]), path, files_per_day=3)
    (merge,) = files.children(spark, f"{path}/data")
    parts = [p for p in files.children(spark, f"{path}/data/{merge}/trade_date=2021-09-01") if p.endswith(".parquet")]
    assert 2 <= len(parts) <= 3 and read_candles(spark, path).count() == 240


@pytest.mark.parametrize("policy", ["keep_first", "replace"])
def test_sink_repeats_a_batch(spark, tmp_path, policy):
    path = str(tmp_path / "candles")
    sink = candle_table(path, policy)
    for _ in range(2):
        sink(frame(spark, [candle("A", 1.0)]), 0)
    for _ in range(2):
        sink(frame(spark, [candle("A", 2.0), candle("B", 2.0)]), 1)
    assert closes(read_candles(spark, path)) == {"A": 1.0 if policy == "keep_first" else 2.0, "B": 2.0}


# ---------------------------------------------------------------- database


def database(tmp_path):
    path = str(tmp_path / "serving.db")
    with sqlite3.connect(path) as db:
        db.execute(
            "create table CANDLES (DATETIME text, TICKER text, OPEN numeric, HIGH numeric, LOW numeric,"
            " CLOSE numeric, VALUE numeric, primary key (DATETIME, TICKER))"
        )
    return path


OPTIONS = {"module": "sqlite3", "connectArgs": '{"timeout": 60}', "textFor": "Decimal, datetime"}


def stored(path):
    with sqlite3.connect(path) as db:
        return {(r[0], r[1]): tuple(r[2:]) for r in db.execute("select * from CANDLES")}


def test_save_candles(spark, tmp_path):
    path = database(tmp_path)
    rows = [trade(i, f"10:{i % 60:02d}:00", float(i), sec=f"T{i % 3}") for i in range(120)]
    made = op.candles(op.valid_trades(trades(spark, rows, 4)))
    save_candles(made, url=path, connections=4, **OPTIONS)
    want = {(str(k[0]), k[1]): v for k, v in by_key(made).items()}
    assert stored(path) == want
    again = made.withColumn("close", made.close + 1)
    save_candles(again, "keep_first", url=path, **OPTIONS)
    assert stored(path) == want
    save_candles(again, "replace", url=path, **OPTIONS)
    assert stored(path) == {k: (*v[:3], v[3] + 1, v[4]) for k, v in want.items()}


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = database(tmp_path)
    with sqlite3.connect(path) as db:
        db.execute("create trigger no_bad before insert on CANDLES when new.TICKER = 'BAD' begin select raise(abort, 'bad ticker'); end")
    rows = [candle(f"T{i}", 1.0) for i in range(10)] + [candle("BAD", 1.0)]
    with pytest.raises(Exception, match="bad ticker"):
        save_candles(frame(spark, rows), connections=1, url=path, batchSize="3", **OPTIONS)
    assert stored(path) == {}


def test_nulls_are_written_as_null(spark, tmp_path):
    path = database(tmp_path)
    save_candles(frame(spark, [candle("A", None)]), url=path, **OPTIONS)
    assert stored(path)[str(at(10, 0)), "A"][3] is None


def test_large_turnover_is_saved(spark, tmp_path):
    path = database(tmp_path)
    rows = [trade(1, "10:00:00", 5.0, 3e9, sec="BIG"), trade(2, "10:00:00", 5.0, 2.0, sec="SMALL")]
    made = op.candles(op.valid_trades(trades(spark, rows)))
    assert save_candles(made, url=path, **OPTIONS) == 0
    assert stored(path)[str(at(10, 0)), "BIG"][4] == 3_000_000_000
    candle_database(url=path, **OPTIONS)(made, 1)
    narrow = {"kind": "decimal(10,2)", "url": path, **OPTIONS}
    with pytest.raises(Exception):
        save_candles(made, "replace", **narrow)
    aside = str(tmp_path / "aside")
    assert save_candles(made, "replace", misfits=aside, **narrow) == 1
    assert [r.ticker for r in spark.read.parquet(aside).collect()] == ["BIG"]


def test_stream_into_database(spark, tmp_path):
    path = database(tmp_path)
    frame(spark, [candle("A", 1.0), candle("B", 1.0)]).write.parquet(str(tmp_path / "in"))
    spark.dataSource.register(UpsertDataSource)
    stream = op.cast_serving(spark.readStream.schema(CANDLE).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.format("upsert").outputMode("append").trigger(availableNow=True)
    settings = {"url": path, "tableName": "CANDLES", "keys": "DATETIME,TICKER", "policy": "replace", **OPTIONS}
    writer.options(**settings).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert len(stored(path)) == 2


def test_only_append(spark, tmp_path):
    spark.dataSource.register(UpsertDataSource)
    writer = frame(spark, [candle("A", 1.0)]).write.format("upsert").mode("overwrite")
    with pytest.raises(Exception, match="append"):
        writer.options(url="x", tableName="CANDLES", keys="DATETIME", **OPTIONS).save()


@pytest.mark.parametrize("missing", ["url", "tableName", "keys"])
def test_required_options(missing):
    options = {"url": "x", "tableName": "CANDLES", "keys": "DATETIME"}
    del options[missing]
    with pytest.raises(ValueError, match=f"needs {missing}"):
        UpsertWriter(CANDLE, options)


@pytest.mark.parametrize("kind", [T.BinaryType(), T.NullType(), T.ArrayType(T.LongType()), T.DayTimeIntervalType()])
def test_unsupported_types(kind):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", kind)])
    with pytest.raises(ValueError, match="cannot hold x"):
        UpsertWriter(schema, {"url": "x", "tableName": "t", "keys": "k"})


def test_statement():
    assert upsert_statement("T", ["a", "b", "c"], ["A", "B"], "keep_first", "?") == (
        "INSERT INTO T (a, b, c) VALUES (?, ?, ?) ON CONFLICT (A, B) DO UPDATE SET A = EXCLUDED.A, B = EXCLUDED.B"
    )
    assert upsert_statement("s.T", ["a", "b"], ["a"], "replace", "%s") == (
        "INSERT INTO s.T (a, b) VALUES (%s, %s) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b"
    )
    for table, columns, keys in [("T; drop", ["a"], ["a"]), ("T", ["a b"], ["a b"]), ("T", ["a"], ["z"]), ("T", ["a"], [])]:
        with pytest.raises(ValueError):
            upsert_statement(table, columns, keys, "replace", "?")
