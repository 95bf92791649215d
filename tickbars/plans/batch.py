"""One batch of any job: count, write, record."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tickbars.operators.progress import count_of, counted
from tickbars.sinks.records import append_metric

Sink = Callable[[DataFrame, int], None]


def run_batch(
    rows: DataFrame,
    sink: Sink,
    service: str,
    metrics: str | None = None,
    batch_id: int = 0,
    invalid: Callable[[], int | None] = lambda: None,
) -> int:
    """Hands `rows` to `sink(rows, batch_id)` and records a metric row; returns their number.

    The rows are counted on the way through, so the sink has to run over all of them. A failure is
    recorded and raised. `invalid` tells, after the sink has run, how many rows were set aside before.
    """
    began = time.monotonic()
    seen_rows, seen = counted(rows, f"{service}_{batch_id}")
    ok, size = False, 0
    try:
        sink(seen_rows, batch_id)
        ok, size = True, count_of(seen)
        return size
    finally:
        millis = int((time.monotonic() - began) * 1000)
        append_metric(rows.sparkSession, metrics, service, ok, millis, size, batch_id, None, invalid() if ok else None)
