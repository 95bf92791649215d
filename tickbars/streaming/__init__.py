"""Candles from streams."""

from tickbars.streaming.candles import (
    decoded_stream,
    start_candles,
    start_quarantine,
    start_stream,
    state_partitions,
    stream_candles,
    with_instant,
)
from tickbars.streaming.late import first_time, in_time, read_late
from tickbars.streaming.progress import Recorder, progress_metrics, progress_offsets, recorded
from tickbars.streaming.totals import stream_day_totals

__all__ = [
    "Recorder",
    "decoded_stream",
    "first_time",
    "in_time",
    "progress_metrics",
    "progress_offsets",
    "read_late",
    "recorded",
    "start_candles",
    "start_quarantine",
    "start_stream",
    "state_partitions",
    "stream_candles",
    "stream_day_totals",
    "with_instant",
]
