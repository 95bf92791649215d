"""Schemas of the tables and messages, as Spark types."""

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "decimal": T.DecimalType(10, 2),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "ntz": T.TimestampNTZType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _struct(**fields: str | T.DataType) -> T.StructType:
    # Not StructType.fromDDL, which needs a running session.
    return T.StructType([T.StructField(n, _TYPES.get(t, t) if isinstance(t, str) else t) for n, t in fields.items()])


# Raw trades table. TRADEDATE is dd.MM.yyyy, TRADETIME is HH:mm:ss, TRADENO is the key.
DEAL = _struct(
    TRADENO="bigint",
    TRADEDATE="string",
    TRADETIME="string",
    SECID="string",
    BOARDID="string",
    PRICE="decimal",
    QUANTITY="int",
    VALUE="decimal",
    TYPE="string",
    BUYSELL="string",
    TRADINGSESSION="string",
)

# Trade record: the JSON payload of a message, and a DEAL row without TYPE.
TRADE = _struct(
    tradeNo="bigint",
    tradeDate="string",
    tradeTime="string",
    secId="string",
    boardId="string",
    price="double",
    quantity="int",
    value="double",
    buySell="string",
    tradingSession="string",
)

# Message in the shape of Spark's Kafka source with includeHeaders.
MESSAGE = _struct(
    key="binary",
    value="binary",
    topic="string",
    partition="int",
    offset="bigint",
    timestamp="timestamp",
    headers=T.ArrayType(_struct(key="string", value="binary")),
)

# Candle, keyed by (datetime, ticker). datetime is exchange wall-clock time.
_CANDLE = {
    "datetime": "ntz",
    "ticker": "string",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "value": "bigint",
}
CANDLE = _struct(**_CANDLE)
CANDLE_KEYS = ["datetime", "ticker"]

# Candle with what is needed to combine it with others of its ticker, or to tell which of two is the later one.
PARTIAL = _struct(
    **_CANDLE, open_time="ntz", open_no="bigint", close_time="ntz", close_no="bigint", trades="bigint"
)
# Of two states of one candle the one that has seen more trades is the newer, then the one that has seen a later trade.
CANDLE_VERSION = ["trades", "close_time", "close_no"]

# How far an application has read each topic partition; last_offset is exclusive.
LEDGER = _struct(
    app_name="string", topic="string", part="int", last_offset="bigint", batch_id="bigint", ts="timestamp"
)

# One row per processed batch. late_rows were dropped by the watermark, invalid_rows set aside; NULL if not counted.
METRIC = _struct(
    status="string",
    service_name="string",
    request_time="bigint",
    batch_size="bigint",
    batch_id="bigint",
    ts="timestamp",
    late_rows="bigint",
    invalid_rows="bigint",
)
