from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import by_key
from tickbars import files
from tickbars.plans import inputs
from tickbars.plans.catalog import QUERIES
from tickbars.sources import stream_messages

SF_DIR = "/root/testdata/sf0.001"


def test_tables_may_be_folders_of_files(spark, tmp_path):
    inputs.events(spark, SF_DIR).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    want = by_key(QUERIES["candles_5m"](spark, SF_DIR))
    for name in ("candles_5m", "stream_candles"):
        assert by_key(QUERIES[name](spark, str(tmp_path))) == want


@pytest.mark.parametrize("name", ["candles_5m", "decode_trades", "malformed_messages", "day_filter_parsed"])
def test_settings_do_not_matter(spark, name):
    want = sorted(map(str, QUERIES[name](spark, SF_DIR).collect()))
    for setting in ("spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage"):
        spark.conf.set(setting, "false")
        try:
            assert sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) == want
        finally:
            spark.conf.unset(setting)


def events_of(spark, days, parts):
    """An event of each of these days, numbered from 0."""
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = [(n, dt.datetime(2024, 1, day, 10, 0, n), n, "view", 2.5, '{"k": 50}') for n, day in enumerate(days)]
    return spark.createDataFrame(rows, kinds).repartition(parts)


def test_events_are_read_once_for_all_batches(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def note(number):
        seen.add(1)
        return number

    noted = F.udf(note, "bigint").asNondeterministic()
    table = events_of(spark, [1, 2, 11, 12, 21, 22], 2).withColumn("event_id", noted("event_id"))
    monkeypatch.setattr(inputs, "events", lambda spark, sf_dir: table)
    path, _ = inputs.message_batches(spark, "", "tradeNo % 3", "if(tradeNo < 2, 3, null)")
    assert spark.read.parquet(path).count() == 8
    assert seen.value == 6


def test_batches_of_few_messages_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "events", lambda spark, sf_dir: events_of(spark, [1, 25, 12, 2, 3, 4, 5, 6], 4))
    path, n = inputs.message_batches(spark, "", "least((cast(substring(tradeDate, 1, 2) as int) - 1) div 10, 2)", "if(tradeNo = 1, 3, null)")
    got = {}

    def sink(batch, batch_id):
        got[batch_id] = sorted(3 * r.offset + r.partition for r in batch.collect())

    sent = stream_messages(spark, "parquet", path, maxFilesPerTrigger=str(n))
    writer = sent.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert n == 4 and got == {0: [0, 3, 4, 5, 6, 7], 1: [2], 2: [1], 3: [1]}


@pytest.mark.parametrize("name", ["stream_restart", "stream_day_totals"])
def test_state_has_no_more_partitions_than_a_batch_has_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(files, "job_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(inputs, "events", lambda spark, sf_dir: events_of(spark, [1, 2, 11, 12, 21, 22], 2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert QUERIES[name](spark, "").count() > 0
    states = list(tmp_path.glob("checkpoint-*/state/[0-9]*"))
    assert states and all(len(list(state.glob("[0-9]*"))) == 2 for state in states)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before != "2"
