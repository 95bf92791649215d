"""Column expressions. All are built-in Spark functions, so they stay in generated code."""

from tickbars.functions.messages import event_header_in, json_null, status_label
from tickbars.functions.time import (
    bucket_start,
    day_spellings,
    event_time,
    from_instant,
    hour_text,
    iso_day,
    minute_of_hour,
    shift_day,
    tick_number,
    to_instant,
    trade_day,
)
from tickbars.functions.values import total_order, trade_order, whole_value

__all__ = [
    "bucket_start",
    "day_spellings",
    "event_header_in",
    "event_time",
    "from_instant",
    "hour_text",
    "iso_day",
    "json_null",
    "minute_of_hour",
    "shift_day",
    "status_label",
    "tick_number",
    "to_instant",
    "total_order",
    "trade_day",
    "trade_order",
    "whole_value",
]
