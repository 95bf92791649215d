from __future__ import annotations

import datetime as dt
import json
import time

import pytest

from helpers import at, by_key, message, messages, payload, trade
from tickbars import files
from tickbars import operators as op
from tickbars.schemas import CANDLE_VERSION, PARTIAL
from tickbars.sinks import (
    append_metric,
    candle_database,
    candle_table,
    compact_records,
    metric_row,
    read_batches,
    read_candles,
    write_batch,
)
from tickbars.sources import read_ledger, read_messages, stream_messages
from tickbars.sinks import write_messages
from tickbars.operators import decode_trades, filter_events
from tickbars.streaming import progress_metrics, progress_offsets, read_late, recorded, start_candles, start_quarantine, start_stream

NOW = {"availableNow": True}


class Topic:
    """Messages on files: each `send` is one file and, read one file at a time, one batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.next = spark, folder, 0

    def send(self, *rows):
        sent = []
        for row in rows:
            value = row if isinstance(row, (str, type(None))) else payload(row)
            sent.append(message(value, self.next))
            self.next += 1
        self.raw(*sent)

    def raw(self, *sent):
        write_messages(messages(self.spark, sent).coalesce(1), "parquet", self.folder)
        time.sleep(0.02)  # the file source orders by modification time

    def stream(self):
        return stream_messages(self.spark, "parquet", self.folder, maxFilesPerTrigger="1")


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, str(tmp_path / "topic"))


def run(topic, tmp_path, mode, policy, **how):
    table = str(tmp_path / f"candles-{mode}")
    checkpoint = str(tmp_path / f"checkpoint-{mode}")
    query = start_candles(topic.stream(), candle_table(table, policy), checkpoint, mode, trigger=NOW, **how)
    query.awaitTermination()
    return by_key(read_candles(topic.spark, table)), query


def test_candle_over_two_batches(topic, tmp_path):
    topic.send(trade(1, "10:00:10", 1.0))
    topic.send(trade(2, "10:03:00", 5.0), trade(3, "10:04:50", 3.0))
    whole, _ = run(topic, tmp_path, "stateful", "replace")
    assert whole == {(at(10, 0), "SBER"): (1.0, 5.0, 1.0, 3.0, 300)}
    first, _ = run(topic, tmp_path, "per_batch", "keep_first")
    assert first == {(at(10, 0), "SBER"): (1.0, 1.0, 1.0, 1.0, 100)}


def test_state_goes_on_after_a_restart(topic, tmp_path):
    topic.send(trade(1, "10:00:10", 1.0))
    run(topic, tmp_path, "stateful", "replace")
    topic.send(trade(2, "10:03:00", 5.0))
    got, _ = run(topic, tmp_path, "stateful", "replace")
    assert got == {(at(10, 0), "SBER"): (1.0, 5.0, 1.0, 5.0, 200)}


def test_late_trade_is_dropped(topic, tmp_path):
    topic.send(trade(1, "10:00:00", 1.0))
    topic.send(trade(2, "11:00:00", 2.0))
    topic.send(trade(3, "11:00:01", 3.0))
    topic.send(trade(4, "10:01:00", 9.0), trade(5, "10:52:00", 4.0))
    got, _ = run(topic, tmp_path, "stateful", "replace", lateness="10 minutes")
    assert got == {
        (at(10, 0), "SBER"): (1.0, 1.0, 1.0, 1.0, 100),
        (at(11, 0), "SBER"): (2.0, 3.0, 2.0, 3.0, 200),
        (at(10, 50), "SBER"): (4.0, 4.0, 4.0, 4.0, 100),
    }


@pytest.mark.parametrize(("dedup", "value"), [(True, 200), (False, 300)])
def test_trade_sent_twice(topic, tmp_path, dedup, value):
    topic.send(trade(1, "10:00:00", 1.0))
    topic.send(trade(1, "10:00:00", 1.0), trade(2, "10:00:01", 2.0))
    got, _ = run(topic, tmp_path, "stateful", "replace", dedup=dedup)
    assert got[at(10, 0), "SBER"] == (1.0, 2.0, 1.0, 2.0, value)


def test_unusable_messages_do_not_stop_the_stream(topic, tmp_path):
    topic.send(trade(1, "10:00:00"), "{bad", "null", None, trade(2, "10:99:00"))
    topic.raw(message(payload(trade(9, "10:01:00")), 77, headers=[("eventType", "OTHER")]))
    for mode, policy in (("stateful", "replace"), ("per_batch", "keep_first")):
        got, _ = run(topic, tmp_path, mode, policy)
        assert got == {(at(10, 0), "SBER"): (10.0, 10.0, 10.0, 10.0, 100)}
    path = str(tmp_path / "bad")
    start_quarantine(topic.stream(), path, str(tmp_path / "ck-bad"), trigger=NOW).awaitTermination()
    bad = {r.offset: r.problem for r in topic.spark.read.parquet(path).collect()}
    assert bad == {1: "malformed", 3: "malformed", 4: "time"}


def test_ledger_and_metrics(topic, tmp_path, spark):
    ledger, metrics = str(tmp_path / "ledger"), str(tmp_path / "metrics")
    topic.send(trade(1, "10:00:00"), "{bad")
    topic.raw(message(payload(trade(2, "10:01:00")), 5, headers=[], partition=1))
    topic.send(trade(3, "10:06:00"), trade(4, "10:07:00"))
    how = {"ledger": ledger, "metrics": metrics, "app": "loader"}
    run(topic, tmp_path, "per_batch", "keep_first", **how)
    got = {(r.topic, r.part): r.last_offset for r in read_ledger(spark, ledger, "loader", ["trades"]).collect()}
    assert got == {("trades", 0): 4, ("trades", 1): 6}
    assert read_ledger(spark, ledger, "loader", ["other"]).isEmpty()
    assert read_ledger(spark, ledger, "another", ["trades"]).isEmpty()
    rows = spark.read.parquet(metrics).orderBy("batch_id").collect()
    assert [(r.status, r.service_name, r.batch_size) for r in rows] == [("OK", "loader", 1), ("OK", "loader", 0), ("OK", "loader", 2)]
    assert all(r.request_time > 0 for r in rows)


def test_metrics_of_a_stateful_stream(topic, tmp_path, spark):
    metrics = str(tmp_path / "metrics")
    topic.send(trade(1, "10:00:00"), "{bad")
    topic.send(trade(2, "11:00:00"))
    topic.send(trade(3, "11:01:00"))
    topic.send(trade(4, "10:01:00"), trade(5, "11:02:00"))
    _, query = run(topic, tmp_path, "stateful", "replace", metrics=metrics, app="recorded", lateness="10 minutes")
    assert recorded(query)
    rows = spark.read.parquet(metrics).orderBy("batch_id").collect()
    got = [(r.status, r.batch_id, r.batch_size, r.invalid_rows, r.late_rows) for r in rows]
    assert got == [("OK", 0, 1, 1, 0), ("OK", 1, 1, 0, 0), ("OK", 2, 1, 0, 0), ("OK", 3, 2, 0, 1)]
    compact_records(spark, metrics, rows[0].day)
    assert spark.read.parquet(metrics).count() == 4
    assert len([f for f in files.children(spark, f"{metrics}/day={rows[0].day}") if f.endswith(".parquet")]) == 1


def test_failure_of_a_stateful_stream_is_recorded(topic, tmp_path, spark):
    metrics = str(tmp_path / "metrics")
    topic.send(trade(1, "10:00:00"))

    def sink(batch, batch_id):
        raise RuntimeError("no connection")

    query = start_candles(topic.stream(), sink, str(tmp_path / "ck"), trigger=NOW, metrics=metrics, app="fails")
    with pytest.raises(Exception, match="no connection"):
        query.awaitTermination()
    assert recorded(query)
    assert [(r.status, r.batch_id) for r in spark.read.parquet(metrics).collect()] == [("FAIL", 0)]


def test_quarantine_from_the_same_parse(topic, tmp_path, spark):
    bad, metrics = str(tmp_path / "bad"), str(tmp_path / "metrics")
    topic.send(trade(1, "10:00:00"), "{bad", trade(2, "10:99:00"))
    topic.send(trade(3, "10:06:00"))
    run(topic, tmp_path, "per_batch", "keep_first", quarantine=bad, metrics=metrics)
    assert {(r.batch_id, r.offset, r.problem) for r in spark.read.parquet(bad).collect()} == {(0, 1, "malformed"), (0, 2, "time")}
    rows = spark.read.parquet(metrics).orderBy("batch_id").collect()
    assert [(r.batch_size, r.invalid_rows) for r in rows] == [(1, 2), (1, 0)]


def test_failed_batch_runs_again(topic, tmp_path, spark):
    ledger, metrics, table = (str(tmp_path / n) for n in ("ledger", "metrics", "table"))
    topic.send(trade(1, "10:00:00", 1.0))
    topic.send(trade(2, "10:06:00", 2.0))
    good, state = candle_table(table, "keep_first"), {"fail": True}

    def sink(batch, batch_id):
        if batch_id == 1 and state["fail"]:
            raise RuntimeError("no connection")
        good(batch, batch_id)

    def start():
        return start_candles(topic.stream(), sink, str(tmp_path / "ck"), "per_batch", trigger=NOW, ledger=ledger, metrics=metrics)

    with pytest.raises(Exception, match="no connection"):
        start().awaitTermination()
    assert set(by_key(read_candles(spark, table))) == {(at(10, 0), "SBER")}
    state["fail"] = False
    start().awaitTermination()
    assert set(by_key(read_candles(spark, table))) == {(at(10, 0), "SBER"), (at(10, 5), "SBER")}
    assert sorted(r.status for r in spark.read.parquet(metrics).collect()) == ["FAIL", "OK", "OK"]
    assert read_ledger(spark, ledger, "candles", ["trades"]).first().last_offset == 2


def test_batch_without_input_writes_nothing(topic, tmp_path, spark):
    topic.send(trade(1, "10:00:00"))
    messages(spark, []).coalesce(1).write.mode("append").parquet(topic.folder)
    calls = []

    def sink(batch, batch_id):
        calls.append((batch_id, batch.count()))

    start_candles(topic.stream(), sink, str(tmp_path / "ck"), "per_batch", trigger=NOW).awaitTermination()
    assert calls == [(0, 1)]


def test_progress_metrics_of_a_query(topic, tmp_path, spark):
    topic.send(trade(1, "10:00:00"), trade(2, "10:00:01"))
    _, query = run(topic, tmp_path, "stateful", "replace", app="p")
    rows = progress_metrics(spark, query.recentProgress, "p").collect()
    assert [(r.status, r.service_name, r.batch_size, r.batch_id) for r in rows] == [("OK", "p", 2, 0)]


def test_progress_offsets_of_kafka(spark):
    # The form in which Spark's Kafka source reports positions.
    progress = [
        {
            "timestamp": "2021-09-01T10:00:00.000Z",
            "batchId": 4,
            "sources": [{"endOffset": {"trades": {"0": 10, "1": 20}}}, {"endOffset": json.dumps({"more": {"0": 3}})}],
        }
    ]
    got = {(r.topic, r.part): r.last_offset for r in progress_offsets(spark, progress, "a").collect()}
    assert got == {("trades", 0): 10, ("trades", 1): 20, ("more", 0): 3}


def test_metric_failure_is_not_raised(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    append_metric(spark, str(tmp_path / "file" / "below"), "s", True, 1, 1)
    append_metric(spark, None, "s", True, 1, 1)
    row = metric_row(spark, "s", False, 5, 7, 3).first()
    assert (row.status, row.service_name, row.request_time, row.batch_size, row.batch_id) == ("FAIL", "s", 5, 7, 3)
    assert abs(row.ts - dt.datetime.now()) < dt.timedelta(days=2)


def test_messages_on_files(topic, spark):
    topic.send(trade(1, "10:00:00"), "{bad")
    read = read_messages(spark, "parquet", topic.folder)
    assert read.count() == 2 and read.columns == stream_messages(spark, "parquet", topic.folder).columns


def test_wrong_mode(topic, tmp_path):
    topic.send(trade(1, "10:00:00"))
    with pytest.raises(ValueError):
        run(topic, tmp_path, "other", "replace")
    with pytest.raises(ValueError):
        run(topic, tmp_path, "stateful", "replace", quarantine="x")


def test_candles_restart_whatever_the_zone(topic, tmp_path, spark):
    topic.send(trade(1, "02:31:00", 1.0, date="14.03.2021"), trade(2, "02:34:59", 2.0, date="14.03.2021"))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got, _ = run(topic, tmp_path, "stateful", "replace")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {(dt.datetime(2021, 3, 14, 2, 30), "SBER"): (1.0, 2.0, 1.0, 2.0, 200)}


def test_own_steps_and_sink(topic, tmp_path, spark):
    topic.send(trade(1, "10:00:00"), trade(2, "10:01:00", sec="GAZP"))
    topic.raw(message(payload(trade(3, "10:00:00")), 9, headers=[("eventType", "OTHER")]))
    topic.send(trade(4, "10:02:00"))
    out, metrics = str(tmp_path / "out"), str(tmp_path / "metrics")
    steps = [lambda m: filter_events(m, ["MARKET_RECORD"]), decode_trades, lambda t: t.where("secId = 'SBER'")]

    def sink(rows, batch_id):
        rows.select("tradeNo").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = start_stream(topic.stream(), steps, sink, str(tmp_path / "ck"), trigger=NOW, app="own", metrics=metrics)
    query.awaitTermination()
    assert sorted(r.tradeNo for r in spark.read.parquet(out).collect()) == [1, 4]
    rows = spark.read.parquet(metrics).orderBy("batch_id").collect()
    assert [(r.service_name, r.batch_size) for r in rows] == [("own", 1), ("own", 0), ("own", 1)]


def test_stream_of_messages_into_a_database(topic, tmp_path, spark):
    from test_upsert import OPTIONS, database, stored

    path = database(tmp_path)
    topic.send(trade(1, "10:00:10", 1.0))
    topic.send(trade(2, "10:03:00", 5.0), trade(1 << 62, "10:04:00", 3.0))
    sink = candle_database("replace", connections=1, url=path, **OPTIONS)
    start_candles(topic.stream(), sink, str(tmp_path / "ck"), trigger=NOW).awaitTermination()
    assert stored(path) == {(str(at(10, 0)), "SBER"): (1, 5, 1, 3, 300)}


def parts_of(spark, path):
    return op.combine_candles(read_batches(spark, path, PARTIAL))


def test_a_batch_that_runs_again_counts_once(topic, tmp_path, spark):
    """Parts, late trades and numbers are all kept by batch: a failure after they were written changes nothing."""
    parts, late, numbers, ck = (str(tmp_path / n) for n in ("parts", "late", "numbers", "ck"))
    topic.send(trade(1, "10:00:10", 1.0), trade(2, "10:01:00", 5.0))
    topic.send(trade(3, "11:02:00", 3.0), trade(2, "10:01:00", 5.0), trade(4, "10:02:00", 7.0))
    topic.send(trade(5, "10:03:00", 9.0), trade(3, "11:02:00", 3.0), trade(6, "11:03:00", 2.0), trade(1, "10:00:10", 1.0))
    failing = [1, 2]

    def sink(rows, batch_id):
        write_batch(rows, parts, batch_id)
        if batch_id in failing:
            failing.remove(batch_id)
            raise RuntimeError("lost on purpose")

    how = {"versioned": True, "late": late, "numbers": numbers, "lateness": "10 minutes", "trigger": NOW}
    for _ in range(2):
        with pytest.raises(Exception, match="lost on purpose"):
            start_candles(topic.stream(), sink, ck, "per_batch", **how).awaitTermination()
    start_candles(topic.stream(), sink, ck, "per_batch", **how).awaitTermination()
    got = {r.datetime: (r.open, r.close, r.trades) for r in parts_of(spark, parts).collect()}
    assert got == {at(10, 0): (1.0, 7.0, 3), at(11, 0): (3.0, 2.0, 2)}
    assert [(r.tradeNo, r.batch_id) for r in read_late(spark, late).collect()] == [(5, 2)]
    whole = op.combine_candles(read_batches(spark, parts, PARTIAL).drop("batch_id").unionByName(op.candle_partials(read_late(spark, late))))
    assert whole.where("datetime = timestamp_ntz'2021-09-01 10:00:00'").first().trades == 4


def test_batches_that_left_nothing(topic, tmp_path, spark):
    topic.send("{bad")
    parts, late, numbers = (str(tmp_path / n) for n in ("parts", "late", "numbers"))
    how = {"versioned": True, "late": late, "numbers": numbers, "trigger": NOW}
    sink = lambda rows, batch_id: write_batch(rows, parts, batch_id)
    start_candles(topic.stream(), sink, str(tmp_path / "ck"), "per_batch", **how).awaitTermination()
    assert parts_of(spark, parts).count() == read_late(spark, late).count() == read_late(spark, str(tmp_path / "none")).count() == 0
    for wrong in ("late", "numbers"):
        with pytest.raises(ValueError):
            start_candles(topic.stream(), sink, str(tmp_path / "ck2"), **{wrong: "x"})


def test_a_stream_without_its_state_keeps_the_greater_candle(topic, tmp_path, spark):
    table = str(tmp_path / "table")
    topic.send(trade(1, "10:00:10", 1.0), trade(2, "10:01:00", 5.0))
    for policy, version, close in (("newest", CANDLE_VERSION, 5.0), ("replace", (), 3.0)):
        for n in range(2):
            path = f"{table}-{policy}"
            sent = topic.stream().where(f"offset {'<' if n == 0 else '>='} 2")
            start_candles(sent, candle_table(path, policy, version), f"{path}-{n}", trigger=NOW, versioned=True).awaitTermination()
            if n == 0 and policy == "newest":
                topic.send(trade(3, "10:02:00", 3.0))
        assert [r.close for r in read_candles(spark, path, schema=PARTIAL).collect()] == [close]
