"""Messages: encode, filter by header, decode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickbars.functions.messages import EVENT_HEADER, event_header_in, json_null
from tickbars.operators.columns import with_once
from tickbars.schemas import TRADE

# Numbers are read as text and cast, so that 12.5 and "12.5" are both taken. A payload is read as the only
# element of an array: what follows an object, a second one too, then makes the text malformed.
_PAYLOAD = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in TRADE.fields]))
_POSITION = ("topic", "partition", "offset")


def to_messages(trades: DataFrame, event_type: str = "MARKET_RECORD", topic: str | None = None) -> DataFrame:
    """Trades as messages: JSON value, no key, one header with the event type.

    The columns are those that Spark's Kafka sink takes. Missing fields are written as null.
    """
    fields = [F.col(f.name) for f in TRADE.fields]
    header = F.struct(
        F.lit(EVENT_HEADER).alias("key"), F.lit(event_type.encode("utf-8")).alias("value")
    )
    columns = [
        F.lit(None).cast("binary").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary").alias("value"),
        F.array(header).alias("headers"),
    ]
    if topic is not None:
        columns.append(F.lit(topic).alias("topic"))
    return trades.select(*columns)


def filter_events(messages: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Messages with a header `eventType` of an allowed value."""
    return messages.where(event_header_in("headers", list(allowed)))


def drop_null_messages(messages: DataFrame) -> DataFrame:
    """Leaves out messages whose payload is the JSON literal null."""
    return messages.where(~json_null("value"))


def decode_trades(messages: DataFrame) -> DataFrame:
    """Trades from JSON values; unknown fields are ignored.

    Adds `payload`, the text, and `problem`: 'malformed' if the text is no JSON object, or the name
    of a numeric field whose text is no such number. `valid_trades` and `invalid_trades` split on it.
    """
    position = [c for c in _POSITION if c in messages.columns]
    text = messages.select(*position, F.col("value").cast("string").alias("payload"))
    records = F.from_json(F.concat(F.lit("["), "payload", F.lit("]")), _PAYLOAD)
    parsed = with_once(text, "r", F.when(F.size(records) == 1, F.get(records, 0)))
    problems = ["when r is null then 'malformed'"]
    columns = []
    for f in TRADE.fields:
        kind = f.dataType.simpleString()
        if kind == "string":
            columns.append(f"r.{f.name}")
            continue
        value = f"try_cast(r.{f.name} as {kind})"
        if kind != "double":
            # 100.0 is a whole number too, 100.7 is none.
            exact = f"try_cast(r.{f.name} as decimal(38,10))"
            value = f"coalesce({value}, case when {exact} = floor({exact}) then try_cast({exact} as {kind}) end)"
        columns.append(f"{value} as {f.name}")
        problems.append(f"when r.{f.name} is not null and {value} is null then '{f.name}'")
    problem = f"case {' '.join(problems)} end as problem"
    return parsed.selectExpr(*position, "payload", *columns, problem)
