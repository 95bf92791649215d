"""Streaming candles, stateful or per batch.

Stateful (default): state across batches, so a candle cut by a batch boundary comes out whole; every
change of a candle is emitted and replaces the stored one. Per batch: each batch builds candles from
its own trades only, for use with a keep-first table.

Set `spark.sql.streaming.stateStore.providerClass` to Spark's RocksDB provider for many open candles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickbars.functions import to_instant
from tickbars.operators import candle_partials, candles, decode_trades, dedup_trades, drop_null_messages, filter_events
from tickbars.operators.progress import count_of
from tickbars.operators.trades import invalid_trades, with_problem
from tickbars.plans.batch import Sink, run_batch
from tickbars.sinks.batches import write_batch
from tickbars.sinks.records import append_ledger
from tickbars.streaming.late import first_time, in_time
from tickbars.streaming.progress import Recorder, keep, record

_EVENTS = ("MARKET_RECORD",)
_EVERY_MINUTE = {"processingTime": "60 seconds"}


def decoded_stream(messages: DataFrame, allowed: Iterable[str] = _EVENTS) -> DataFrame:
    """Header filter, null payloads out, decode. Works on batches and streams."""
    return (
        messages.transform(filter_events, list(allowed)).transform(drop_null_messages).transform(decode_trades)
    )


def with_instant(trades: DataFrame, lateness: str | None = None) -> DataFrame:
    """Adds `instant`, the event time as the type that watermarks need, and sets the watermark."""
    df = trades.withColumn("instant", to_instant("dt"))
    return df.withWatermark("instant", lateness) if lateness else df


@contextmanager
def state_partitions(spark: SparkSession, most: int) -> Iterator[None]:
    """Streams started within deal their state, and what their batches shuffle, to no more than this many partitions.

    Every batch writes at least one file for each partition of each state, however little is in it. Candles are far
    fewer than trades, so as many partitions as a batch is read by are enough. A checkpoint keeps the number it has.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_candles(
    trades: DataFrame,
    minutes: int = 5,
    lateness: str = "10 minutes",
    dedup: bool = False,
    versioned: bool = False,
    **how: str,
) -> DataFrame:
    """Candles of a stream of valid trades, with state across batches.

    Trades later than `lateness` behind the newest event time may be dropped. `dedup` counts a trade
    number once within that time. Use output mode update for every change or append for final candles.
    `versioned` adds the columns of `schemas.PARTIAL`: a table with the policy newest then keeps, of a candle's
    states, the one that has seen most, also if the state was lost and a stream knows the rest of a candle only.
    """
    timed = with_instant(trades, lateness)
    make = candle_partials if versioned else candles
    return make(dedup_trades(timed) if dedup else timed, minutes, **how)


def start_stream(
    messages: DataFrame,
    steps: Iterable[Callable[[DataFrame], DataFrame]],
    sink: Sink,
    checkpoint: str,
    trigger: dict | None = None,
    app: str = "stream",
    ledger: str | None = None,
    metrics: str | None = None,
) -> StreamingQuery:
    """Any per-batch job: each batch of messages goes through `steps` into `sink(rows, batch_id)`.

    Empty batches are skipped. A batch that fails is run again from the checkpoint: give the sink a
    keyed write, and let it run over all rows. `ledger` and `metrics` name Parquet tables for the
    positions read and for one row per batch. The trigger is 60 seconds unless given.
    """
    steps = list(steps)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        for step in steps:
            rows = rows.transform(step)
        run_batch(rows, sink, app, metrics, batch_id)

    return _start_batches(messages, handle, checkpoint, trigger, app, ledger)


def _start_batches(
    messages: DataFrame, handle: Sink, checkpoint: str, trigger: dict | None, app: str, ledger: str | None
) -> StreamingQuery:
    """Each batch that has messages through `handle`, then into the ledger."""

    def batch_of(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        handle(batch, batch_id)
        if ledger:
            append_ledger(batch, ledger, app, batch_id)

    writer = messages.writeStream.foreachBatch(batch_of).queryName(app)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or _EVERY_MINUTE).start()


def start_candles(
    messages: DataFrame,
    sink: Sink,
    checkpoint: str,
    mode: str = "stateful",
    minutes: int = 5,
    lateness: str = "10 minutes",
    allowed: Iterable[str] = _EVENTS,
    dedup: bool = False,
    trigger: dict | None = None,
    app: str = "candles",
    ledger: str | None = None,
    metrics: str | None = None,
    quarantine: str | None = None,
    versioned: bool = False,
    late: str | None = None,
    numbers: str | None = None,
    **how: str,
) -> StreamingQuery:
    """Starts candles from a stream of messages; `sink(df, batch_id)` writes each batch, all of it.

    If the sink fails, the query fails and the batch is run again from the checkpoint: give the sink a
    keyed write. `metrics` names a Parquet table for one row per batch: trades used, messages set aside as
    invalid, and in stateful mode trades that came too late; `ledger` one for the positions, which a
    stateful query knows of Kafka only. In stateful mode both are written after the batch (`recorded` waits for
    them). `quarantine` names a folder for the invalid messages of per_batch mode, from the same parse;
    for a stateful query start `start_quarantine` beside it. The trigger is 60 seconds unless given. `versioned`
    as in `stream_candles`.

    Folders for what per_batch mode remembers: with `late`, trades more than `lateness` behind those of earlier batches
    are left out of the candles and kept there (`read_late`); with `numbers`, which takes `dedup` too, a trade counts
    once however much later it comes again.
    """
    allowed = list(allowed)
    if mode == "per_batch":
        memory = {"quarantine": quarantine, "late": late, "numbers": numbers, "lateness": lateness}
        make = partial(candle_partials if versioned else candles, minutes=minutes, **how)
        handle = _per_batch(sink, make, minutes, allowed, dedup or bool(numbers), app, metrics, **memory)
        return _start_batches(messages, handle, checkpoint, trigger, app, ledger)
    if mode != "stateful":
        raise ValueError(f"mode must be 'stateful' or 'per_batch', got {mode!r}")
    if quarantine:
        raise ValueError("quarantine belongs to per_batch mode; use start_quarantine")
    if late or numbers:
        raise ValueError("late and numbers belong to per_batch mode")
    spark, counts = messages.sparkSession, f"{app}_input"
    bad = F.count(F.when(F.col("problem").isNotNull(), 1))
    tagged = with_problem(decoded_stream(messages, allowed))
    tagged = tagged.observe(counts, (F.count(F.lit(1)) - bad).alias("n"), bad.alias("invalid"))
    out = stream_candles(tagged.where("problem is null").drop("problem"), minutes, lateness, dedup, versioned, **how)
    writer = out.writeStream.outputMode("update").foreachBatch(sink).queryName(app)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger or _EVERY_MINUTE)
    if not (ledger or metrics):
        return writer.start()
    recorder = record(spark, Recorder(spark, app, counts, ledger, metrics))
    return keep(writer.start(), recorder)


def _per_batch(
    sink: Sink,
    make: Callable[[DataFrame], DataFrame],
    minutes: int,
    allowed: list[str],
    dedup: bool,
    app: str,
    metrics: str | None,
    quarantine: str | None,
    late: str | None,
    numbers: str | None,
    lateness: str,
) -> Sink:
    """A batch of messages to candles; its invalid messages are counted and, if asked for, kept."""
    several = bool(quarantine or late or numbers)

    def handle(batch: DataFrame, batch_id: int) -> None:
        tagged = with_problem(decoded_stream(batch, allowed))
        if several:
            tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)  # read for more than the candles
        bad = F.count(F.when(F.col("problem").isNotNull(), 1)).alias("n")
        seen = Observation(f"invalid_{batch_id}_{uuid.uuid4().hex}")
        good = tagged.observe(seen, bad).where("problem is null").drop("problem")
        good = dedup_trades(good) if dedup else good

        def write(trades: DataFrame, number: int) -> None:
            if quarantine:
                # A batch that runs again replaces its own folder.
                write_batch(tagged.where("problem is not null"), quarantine, number)
            if numbers:
                trades = first_time(trades, numbers, number)
            if late:
                trades = in_time(trades, late, number, minutes, lateness)
            sink(make(trades), number)

        try:
            run_batch(good, write, app, metrics, batch_id, lambda: count_of(seen))
        finally:
            if several:
                tagged.unpersist()

    return handle


def start_quarantine(
    messages: DataFrame, path: str, checkpoint: str, allowed: Iterable[str] = _EVENTS, trigger: dict | None = None
) -> StreamingQuery:
    """Writes the messages that cannot go into a candle, with the reason, to Parquet."""
    bad = invalid_trades(decoded_stream(messages, list(allowed)))
    writer = bad.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or _EVERY_MINUTE).start()
