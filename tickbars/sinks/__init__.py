"""Writers."""

from tickbars.sinks.batches import of_days, read_batches, write_batch
from tickbars.sinks.messages import write_messages
from tickbars.sinks.records import append_ledger, append_metric, compact_records, ledger_rows, metric_row
from tickbars.sinks.tables import candle_table, merge_candles, overwrite_days, read_candles
from tickbars.sinks.upsert_source import UpsertDataSource, candle_database, save_candles

__all__ = [
    "UpsertDataSource",
    "append_ledger",
    "append_metric",
    "candle_database",
    "candle_table",
    "compact_records",
    "ledger_rows",
    "merge_candles",
    "metric_row",
    "of_days",
    "overwrite_days",
    "read_batches",
    "read_candles",
    "save_candles",
    "write_batch",
    "write_messages",
]
