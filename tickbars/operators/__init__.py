"""Operators from DataFrame to DataFrame."""

from tickbars.operators.candles import (
    candles,
    cast_serving,
    serving_split,
    day_series,
    explode_series,
    microbatch_candles,
    ordered_candles,
)
from tickbars.operators.columns import with_once
from tickbars.operators.distributions import merge_sketches, quantile_of, value_sketches
from tickbars.operators.late import late_trades, trades_in_time, watermarks
from tickbars.operators.messages import decode_trades, drop_null_messages, filter_events, to_messages
from tickbars.operators.numbers import count_numbers, merge_bitmaps, number_bitmaps, unseen_trades
from tickbars.operators.partials import candle_partials, combine_candles, plain_candles
from tickbars.operators.progress import (
    batch_options,
    batch_sizes,
    count_of,
    counted,
    latest_offsets,
    offset_ranges,
    planned_batches,
    start_positions,
    starting_offsets,
    with_planned_batch,
)
from tickbars.operators.trades import (
    CANDLE_INPUTS,
    deals_to_trades,
    dedup_trades,
    dup_trades,
    filter_day,
    filter_days,
    first_trades,
    invalid_trades,
    time_key,
    valid_trades,
    with_event_time,
    with_problem,
)
from tickbars.operators.upsert import upsert

__all__ = [
    "CANDLE_INPUTS",
    "batch_options",
    "batch_sizes",
    "candle_partials",
    "candles",
    "cast_serving",
    "combine_candles",
    "count_numbers",
    "count_of",
    "counted",
    "day_series",
    "deals_to_trades",
    "decode_trades",
    "dedup_trades",
    "drop_null_messages",
    "dup_trades",
    "explode_series",
    "filter_day",
    "filter_days",
    "filter_events",
    "first_trades",
    "invalid_trades",
    "late_trades",
    "latest_offsets",
    "merge_bitmaps",
    "merge_sketches",
    "microbatch_candles",
    "number_bitmaps",
    "offset_ranges",
    "ordered_candles",
    "plain_candles",
    "planned_batches",
    "quantile_of",
    "serving_split",
    "start_positions",
    "starting_offsets",
    "time_key",
    "to_messages",
    "trades_in_time",
    "unseen_trades",
    "upsert",
    "valid_trades",
    "value_sketches",
    "watermarks",
    "with_event_time",
    "with_once",
    "with_planned_batch",
    "with_problem",
]
