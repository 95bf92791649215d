"""Ledger and metric rows out of the progress of a query: of the batches that Spark still keeps, or of each as it ends."""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from tickbars.schemas import LEDGER, METRIC
from tickbars.sinks.records import append_metric, append_rows

_log = logging.getLogger(__name__)


def _fields(progress: StreamingQueryProgress | dict) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def _when(p: dict) -> dt.datetime:
    return dt.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00"))


def _late(p: dict) -> int:
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))


def progress_offsets(spark: SparkSession, progress: Iterable[StreamingQueryProgress | dict], app: str) -> DataFrame:
    """Ledger rows from Kafka end offsets; one row per batch and topic partition."""
    rows = []
    for p in map(_fields, progress):
        for source in p["sources"]:
            end = source["endOffset"]
            end = json.loads(end) if isinstance(end, str) else end
            for topic, parts in end.items():
                if isinstance(parts, dict):
                    rows += [(app, topic, int(n), at, p["batchId"], _when(p)) for n, at in parts.items()]
    return spark.createDataFrame(rows, LEDGER)


def progress_metrics(spark: SparkSession, progress: Iterable[StreamingQueryProgress | dict], service: str) -> DataFrame:
    """Metric rows; batches without input are left out."""
    rows = [
        ("OK", service, int(p["batchDuration"]), p["numInputRows"], p["batchId"], _when(p), _late(p), None)
        for p in map(_fields, progress)
        if p["numInputRows"] > 0
    ]
    return spark.createDataFrame(rows, METRIC)


class Recorder(StreamingQueryListener):
    """Writes ledger and metric rows of one query while it runs: a row per batch as it ends, and FAIL if it stops by an error.

    Positions come from Kafka's progress; other sources report none. Of the observation `counts`, if the query has it,
    `n` becomes the batch size and `invalid` the number of rows set aside.
    """

    def __init__(self, spark: SparkSession, app: str, counts: str, ledger: str | None, metrics: str | None):
        self.spark, self.app, self.counts, self.ledger, self.metrics = spark, app, counts, ledger, metrics
        self.run: str | None = None
        self.last = -1
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.app and self.run is None:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.runId) != self.run:
            return
        p = _fields(progress)
        self.last = p["batchId"]
        if not p["numInputRows"]:
            return
        seen = progress.observedMetrics.get(self.counts)
        size, invalid = (seen["n"], seen["invalid"]) if seen is not None else (p["numInputRows"], None)
        if self.metrics:
            append_metric(self.spark, self.metrics, self.app, True, int(p["batchDuration"]), size, self.last, _late(p), invalid)
        if self.ledger:
            try:
                append_rows(progress_offsets(self.spark, [p], self.app), self.ledger)
            except Exception:
                _log.exception("positions were not written")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) != self.run:
            return
        if event.exception and self.metrics:
            append_metric(self.spark, self.metrics, self.app, False, 0, 0, self.last + 1)
        self.ended.set()


_recorders: dict[str, Recorder] = {}


def record(spark: SparkSession, recorder: Recorder) -> Recorder:
    """Attaches a recorder; do so before its query starts."""
    spark.streams.addListener(recorder)
    return recorder


def keep(query: StreamingQuery, recorder: Recorder) -> StreamingQuery:
    _recorders[str(query.runId)] = recorder
    return query


def recorded(query: StreamingQuery, seconds: float = 60.0) -> bool:
    """Waits until all rows of a query that has ended are written; True if they are."""
    recorder = _recorders.pop(str(query.runId), None)
    if recorder is None:
        return True
    done = recorder.ended.wait(seconds)
    recorder.spark.streams.removeListener(recorder)
    return done
