"""Trades, table rows and messages made of the `events` table, for queries, tests and the bench."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars import files
from tickbars.operators import with_once
from tickbars.schemas import DEAL, MESSAGE, TRADE
from tickbars.sinks.messages import write_messages


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(events(spark, sf_dir).schema).options(**options)
    if files.is_dir(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def trades_of(table: DataFrame) -> DataFrame:
    """One trade per event. Text is cut from the ISO form of `ts`, which needs no time zone."""
    iso = "cast(cast(ts as timestamp_ntz) as string)"
    k = "cast(get_json_object(props, '$.k') as int)"
    return table.selectExpr(
        "event_id as tradeNo",
        f"concat_ws('.', substring({iso}, 9, 2), substring({iso}, 6, 2), substring({iso}, 1, 4)) as tradeDate",
        f"substring({iso}, 12, 8) as tradeTime",
        "event_type as secId",
        "concat('B', cast(user_id % 4 as string)) as boardId",
        "value as price",
        f"{k} as quantity",
        f"value * {k} as value",
        f"case when {k} < 50 then 'B' else 'S' end as buySell",
        "'MAIN' as tradingSession",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(events(spark, sf_dir))


def mixed_days(df: DataFrame) -> DataFrame:
    """The same trades, of which those of every other user have days without leading zeros."""
    bare = F.regexp_replace("tradeDate", "(^|[.])0", "$1")
    return df.withColumn("tradeDate", F.when(F.col("boardId").isin("B1", "B3"), bare).otherwise(F.col("tradeDate")))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows of the raw trades table."""
    lower = {f.name.upper(): F.col(f.name) for f in TRADE.fields}
    lower["TYPE"] = F.lit("REGULAR")
    return trades(spark, sf_dir).select(*[lower[f.name].cast(f.dataType).alias(f.name) for f in DEAL.fields])


_POSITION = ("'trades' as topic", "cast(tradeNo % 3 as int) as partition", "tradeNo div 3 as offset")
_FIELDS = ", ".join(TRADE.names)
_QUOTED = _FIELDS.replace("price", "case secId when 'purchase' then 'n/a' else cast(price as string) end as price")
# The JSON of a trade without its last brace.
_OPEN = f"rtrim('}}', to_json(struct({_FIELDS})))"
_PAYLOAD = f"""case
    when quantity = 0 then ' null '
    when secId = 'signup' then {_OPEN}
    when secId = 'view' then concat({_OPEN}, ',"venue":{{"id":1}}}}')
    when secId in ('purchase', 'click') then to_json(struct({_QUOTED}))
    else to_json(struct({_FIELDS})) end"""


def _header(key: str, value: str) -> str:
    return f"named_struct('key', '{key}', 'value', cast({value} as binary))"


_RIGHT = _header("eventType", "'MARKET_RECORD'")
_HEADERS = f"""case
    when quantity between 1 and 4 then slice(array({_RIGHT}), 1, 0)
    when quantity = 5 then array({_header("eventType", "null")})
    when quantity = 6 then array({_header("eventType", "'OTHER'")}, {_RIGHT})
    when quantity = 7 then array({_header("EventType", "'MARKET_RECORD'")})
    when secId = 'error' then array({_header("eventType", "'ERROR_RECORD'")})
    else array({_RIGHT}) end"""


def messages_of(df: DataFrame, *more: str) -> DataFrame:
    """Trades as messages of three partitions, with every irregularity that a reader has to deal with.

    quantity 0: payload null; 1 to 4: no header; 5: header without value; 6: two headers, one of them
    right; 7: header of another name. Ticker error: another event type; signup: truncated payload;
    view: unknown field; purchase: price is no number; click: price in quotes. `more` names columns to keep.
    """
    return with_once(df, "m", F.expr(f"struct({_PAYLOAD} as payload, {_HEADERS} as headers)")).selectExpr(
        "cast(null as binary) as key",
        "cast(m.payload as binary) as value",
        *_POSITION,
        "cast(null as timestamp) as timestamp",
        "m.headers as headers",
        *more,
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, partition and offset of all messages, without making their payloads."""
    return trades(spark, sf_dir).selectExpr(*_POSITION)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(trades(spark, sf_dir))


def message_batches(spark: SparkSession, sf_dir: str, *numbers: str) -> tuple[str, int]:
    """A folder with all messages, those of each number in files of their own, oldest numbers first; and how many files.

    A message is sent once for every one of `numbers`, SQL over the trade, that is not null.

    Messages are made by as many tasks as the table is read by, and at least two. Each writes a file of every number, so a
    stream of that many files a batch has one batch per number and reads each with many tasks.
    """
    path = files.new_dir(spark, "messages")
    return path, add_message_batches(spark, sf_dir, path, *numbers)


def add_message_batches(spark: SparkSession, sf_dir: str, path: str, *numbers: str, where: str = "true") -> int:
    """Adds the messages of some trades to a folder as in `message_batches`; returns how many files a batch has.

    The table is read once, however many numbers there are: the files of all are written beside the folder and then
    moved into it, number after number. A number with fewer files than the others gets empty ones.
    """
    table = events(spark, sf_dir)
    n = max(2, table.rdd.getNumPartitions())
    # Dealt out before anything is made of the rows, so that a table of few row groups is shared out too.
    rows = trades_of(table.repartition(n)).where(where).withColumn("file", F.expr(f"explode(array_compact(array({', '.join(numbers)})))"))
    staged = files.new_dir(spark, "staged")
    messages_of(rows, "file").write.partitionBy("file").parquet(staged)
    found = (name.removeprefix("file=") for name in files.children(spark, staged) if name.startswith("file="))
    for batch in sorted(map(int, found)):
        folder = f"{staged}/file={batch}"
        made = [name for name in files.children(spark, folder) if name.endswith(".parquet")]
        for name in made:
            files.move(spark, f"{folder}/{name}", f"{path}/{batch}-{name}", touch=True)
        for _ in range(n - len(made)):
            write_messages(spark.createDataFrame([], MESSAGE).coalesce(1), "parquet", path)
        time.sleep(0.02)  # the file source orders by modification time
    files.delete(spark, staged)
    return n
