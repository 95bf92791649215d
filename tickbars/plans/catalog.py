"""Every operator as a query over the given tables, with the SQL that has to give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars import files
from tickbars import functions as TF
from tickbars import operators as op
from tickbars.plans import inputs
from tickbars.plans.backfill import backfill, backfill_day, run_job
from tickbars.schemas import CANDLE, CANDLE_KEYS, CANDLE_VERSION, PARTIAL, TRADE
from tickbars.sinks import append_ledger, candle_table, merge_candles, read_batches, read_candles, write_batch
from tickbars.plans.repair import repair, repair_plan
from tickbars.sources import range_predicates, read_deals_csv, read_ledger, read_messages, stream_messages
from tickbars.streaming import (
    decoded_stream,
    read_late,
    recorded,
    start_candles,
    start_quarantine,
    start_stream,
    state_partitions,
    stream_candles,
    stream_day_totals,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The day that the recovery job repairs in these queries.
DAY = dt.date(2024, 1, 10)
_NOW = {"availableNow": True}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return add


# ---------------------------------------------------------------- SQL shared by several oracles

_T = """
    t as (
      select event_id as tn, date_trunc('second', ts) as dt, event_type as tk, value as p,
             cast(json_extract_string(props, '$.k') as int) as k,
             value * cast(json_extract_string(props, '$.k') as int) as v,
             'B' || (user_id % 4) as board
      from events)"""
_TABLE_T = _T.replace("value as p", "cast(value::decimal(10,2) as double) as p").replace(
    "value * cast(json_extract_string(props, '$.k') as int) as v",
    "cast(cast(value * cast(json_extract_string(props, '$.k') as int) as decimal(10,2)) as double) as v",
)
# What a reader of the messages gets to see.
_HEADER_OK = "(k = 6 or (k not between 1 and 7 and tk <> 'error'))"
_USABLE = f"{_HEADER_OK} and k <> 0 and tk in ('view', 'click', 'error')"


def _candle_sql(source: str = "t", minutes: int = 5, where: str = "true", extra: str = "") -> str:
    by = "1, 2, 3" if extra else "1, 2"
    return f"""
      select {extra}time_bucket(interval {minutes} minute, dt) as datetime, tk as ticker,
             arg_min(p, (dt, tn)) as open, max(p) as high, min(p) as low,
             arg_max(p, (dt, tn)) as close, cast(sum(cast(trunc(v) as bigint)) as bigint) as value
      from {source} where {where} group by {by}"""


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.valid_trades(inputs.trades(spark, sf_dir))


# ---------------------------------------------------------------- candles


def _candles(name: str, minutes: int, order: str = "wide") -> None:
    @query(name, f"with {_T} {_candle_sql(minutes=minutes)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.candles(_valid(spark, sf_dir), minutes, order=order)


for _minutes in (1, 5, 15, 60):
    _candles(f"candles_{_minutes}m", _minutes)
_candles("candles_packed_key", 5, order="packed")


@query(
    "candles_reverse_ties",
    f"with {_T} {_candle_sql().replace('(dt, tn)', '(dt, -tn)')}",
)
def candles_reverse_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.candles(_valid(spark, sf_dir), tie="reverse")


@query(
    "serving_candles",
    f"""with {_T}, c as ({_candle_sql()})
    select datetime, ticker, open::decimal(10,2) as open, high::decimal(10,2) as high,
           low::decimal(10,2) as low, close::decimal(10,2) as close, value::decimal(10,2) as value from c""",
)
def serving_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cast_serving(op.candles(_valid(spark, sf_dir)))


def _microbatch(name: str, minutes: int) -> None:
    sql = f"""with {_T}, b as (select *, epoch(dt)::bigint // 60 as batch from t),
    c as ({_candle_sql("b", minutes, extra="batch, ")})
    select datetime, ticker, arg_min(open, batch) as open, arg_min(high, batch) as high,
           arg_min(low, batch) as low, arg_min(close, batch) as close, arg_min(value, batch) as value
    from c group by datetime, ticker"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        minute = F.floor(F.unix_seconds(TF.to_instant("dt")) / 60).cast("bigint")
        return op.microbatch_candles(_valid(spark, sf_dir).withColumn("batch", minute), "batch", minutes)


_microbatch("microbatch_candles", 5)
_microbatch("microbatch_candles_60m", 60)


_SERIES = f"""with {_T}, c as ({_candle_sql()}),
    s as (select cast(datetime as date) as day, *,
                 row_number() over (partition by cast(datetime as date), ticker order by datetime) - 1 as pos
          from c)"""


@query(
    "day_series",
    f"""{_SERIES} select day, ticker, count(*) as n, min(datetime) as first_time, max(datetime) as last_time,
    arg_min(open, datetime) as first_open, arg_max(close, datetime) as last_close,
    cast(sum(value) as bigint) as value from s group by day, ticker""",
)
def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = op.day_series(op.candles(_valid(spark, sf_dir)))
    total = F.aggregate("series", F.lit(0).cast("bigint"), lambda a, c: a + c["value"])
    first, last = F.element_at("series", 1), F.element_at("series", -1)
    return series.select(
        "day",
        "ticker",
        F.size("series").cast("bigint").alias("n"),
        first["datetime"].alias("first_time"),
        last["datetime"].alias("last_time"),
        first["open"].alias("first_open"),
        last["close"].alias("last_close"),
        total.alias("value"),
    )


@query("explode_series", f"{_SERIES} select * from s")
def explode_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = op.day_series(op.candles(_valid(spark, sf_dir)))
    return op.explode_series(series).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "ordered_candles",
    f"with {_T} select * from ({_candle_sql()}) order by cast(datetime as date), ticker, datetime",
)
def ordered_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ordered_candles(op.candles(_valid(spark, sf_dir)))


# ---------------------------------------------------------------- candles out of parts


def _partial_sql(source: str = "t", minutes: int = 5, where: str = "true", extra: str = "") -> str:
    more = """, arg_min(dt, (dt, tn)) as open_time, arg_min(tn, (dt, tn)) as open_no,
             arg_max(dt, (dt, tn)) as close_time, arg_max(tn, (dt, tn)) as close_no, count(*) as trades
      from """
    return _candle_sql(source, minutes, where, extra).replace("from ", more.lstrip(" "), 1)


@query("candle_partials", f"with {_T} {_partial_sql()}")
def candle_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.candle_partials(_valid(spark, sf_dir))


@query("candles_60m_from_5m", f"with {_T} {_candle_sql(minutes=60)}")
def candles_60m_from_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours out of stored five-minute candles, without their trades."""
    path = files.new_dir(spark, "candles")
    merge_candles(op.candle_partials(_valid(spark, sf_dir)), path)
    return op.plain_candles(op.combine_candles(read_candles(spark, path, schema=PARTIAL), 60))


@query("combine_halves", f"with {_T} {_partial_sql()}")
def combine_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of every other trade and of the rest, which cuts most candles, put together."""
    trades = _valid(spark, sf_dir)
    parts = [op.candle_partials(trades.where(f"tradeNo % 2 = {n}")) for n in (1, 0)]
    return op.combine_candles(parts[0].unionByName(parts[1]))


@query("combine_batches", f"with {_T} {_candle_sql(minutes=15)}")
def combine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of seven batches from one pass, first put together in three groups, then to candles of another width."""
    trades = _valid(spark, sf_dir).withColumn("batch", F.expr("tradeNo % 7"))
    parts = op.candle_partials(trades, by=["batch"]).withColumn("group", F.expr("batch % 3"))
    grouped = op.combine_candles(parts, by=["group"])
    return op.plain_candles(op.combine_candles(grouped, 15))


# ---------------------------------------------------------------- trades


@query("event_time", f"with {_T} select tn as \"tradeNo\", dt from t")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_event_time(inputs.trades(spark, sf_dir)).select("tradeNo", "dt")


_KEY = """cast(dt as date) as day, tk as "secId", strftime(dt, '%H') as hour,
    cast(minute(dt) // 5 as int) as tick"""


@query("time_key", f'with {_T} select tn as "tradeNo", {_KEY} from t')
def time_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.time_key(inputs.trades(spark, sf_dir)).select("tradeNo", "day", "secId", "hour", "tick")


@query("time_key_counts", f"with {_T} select {_KEY}, count(*) as n from t group by all")
def time_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = op.time_key(inputs.trades(spark, sf_dir))
    return keyed.groupBy("day", "secId", "hour", "tick").agg(F.count("*").alias("n"))


@query("whole_value", f'with {_T} select tn as "tradeNo", cast(trunc(v) as bigint) as whole_value from t')
def whole_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.trades(spark, sf_dir).select("tradeNo", TF.whole_value("value").alias("whole_value"))


_TRADE_ROW = """tn as "tradeNo", strftime(dt, '%d.%m.%Y') as "tradeDate", strftime(dt, '%H:%M:%S') as "tradeTime",
    tk as "secId", board as "boardId", p as price, k as quantity, v as value,
    case when k < 50 then 'B' else 'S' end as "buySell", 'MAIN' as "tradingSession" """


@query("deals_to_trades", f"with {_TABLE_T} select {_TRADE_ROW} from t")
def deals_to_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.deals_to_trades(inputs.deals(spark, sf_dir))


@query("csv_deals", f"with {_TABLE_T} select {_TRADE_ROW} from t")
def csv_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.new_dir(spark, "csv")
    inputs.deals(spark, sf_dir).write.option("sep", ";").option("header", True).csv(path)
    return op.deals_to_trades(read_deals_csv(spark, path))


@query("day_filter", f"with {_T} select {_TRADE_ROW} from t where cast(dt as date) = date '{DAY}'")
def day_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_day(inputs.trades(spark, sf_dir), DAY, "tradeDate")


@query("day_filter_parsed", f"with {_T} select {_TRADE_ROW} from t where cast(dt as date) = date '{DAY}'")
def day_filter_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.trades(spark, sf_dir).where(TF.trade_day("tradeDate") == F.lit(DAY))


@query(
    "day_filter_spellings",
    f"""with {_T}, r as (select {_TRADE_ROW}, dt, board in ('B1', 'B3') as bare from t)
    select * exclude (dt, bare) replace (if(bare, strftime(dt, '%-d.%-m.%Y'), "tradeDate") as "tradeDate")
    from r where cast(dt as date) = date '{DAY}'""",
)
def day_filter_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the users send days without leading zeros."""
    return op.filter_day(inputs.mixed_days(inputs.trades(spark, sf_dir)), DAY, "tradeDate")


@query(
    "previous_day",
    f"with {_T} select distinct strftime(cast(dt as date) - interval 1 day, '%Y-%m-%d') as previous_day from t",
)
def previous_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = TF.iso_day(TF.shift_day(TF.trade_day("tradeDate"), -1))
    return inputs.trades(spark, sf_dir).select(day.alias("previous_day")).distinct()


@query("first_trades", f"with {_T} select {_TRADE_ROW} from t order by tn limit 10")
def first_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_trades(inputs.trades(spark, sf_dir), 10)


def _sent_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades, and the buys once more, as after a restart of the replay."""
    all_trades = inputs.trades(spark, sf_dir)
    return all_trades.unionByName(all_trades.where("buySell = 'B'"))


@query("dup_trades", f'with {_T} select tn as "tradeNo", 2 as n from t where k < 50')
def dup_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dup_trades(_sent_twice(spark, sf_dir))


@query("dedup_trades", f"with {_T} select {_TRADE_ROW} from t")
def dedup_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedup_trades(_sent_twice(spark, sf_dir))


@query("dedup_candles", f"with {_T} {_candle_sql()}")
def dedup_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.candles(op.dedup_trades(op.valid_trades(_sent_twice(spark, sf_dir)), op.CANDLE_INPUTS))


# Numbers of trades seen before, and trades sent again.


@query(
    "unseen_trades",
    f"with {_T} select {_TRADE_ROW}, dt from t where k >= 50",
)
def unseen_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything comes once more after the buys were read, in two parts: the sells are new."""
    trades = _valid(spark, sf_dir)
    buys = trades.where("buySell = 'B'")
    parts = [op.number_bitmaps(buys.where(f"tradeNo % 2 = {n}")) for n in (0, 1)]
    return op.unseen_trades(trades, op.merge_bitmaps(parts[0].unionByName(parts[1])))


@query("count_numbers", f"with {_T} select cast(dt as date) as day, count(distinct tn) as n from t group by 1")
def count_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_numbers(op.number_bitmaps(op.valid_trades(_sent_twice(spark, sf_dir))))


# Trade numbers that jump from day to day.
_JUMPING = "day(dt) * 1000000000000 + tradeNo"


@query(
    "balanced_ranges",
    f"""with {_T} select 16 as ranges, count(*) as n, count(distinct cast(dt as date)) as days, true as balanced from t""",
)
def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen ranges of a number that jumps between days: each row is in one, and none has 1.2 times its share."""
    trades = _valid(spark, sf_dir).withColumn("number", F.expr(_JUMPING))
    cases = [f"when {p} then {i}" for i, p in enumerate(range_predicates(trades, "number", 16))]
    sizes = trades.groupBy(F.expr(f"case {' '.join(cases)} end").alias("part")).agg(
        F.count("*").alias("n"), F.collect_set(F.to_date("dt")).alias("days")
    )
    whole = sizes.agg(F.count("part").alias("ranges"), F.sum("n").alias("n"), F.max("n").alias("most"), F.flatten(F.collect_list("days")).alias("days"))
    balanced = F.expr("most <= 1.2 * n / 16").alias("balanced")
    return whole.select(F.col("ranges").cast("int").alias("ranges"), "n", F.size(F.array_distinct("days")).cast("bigint").alias("days"), balanced)


# Every tenth trade comes with the batch after its own.
_ARRIVAL = "least((day(dt) - 1) // 10, 2) + cast(k % 10 = 0 as int)"
_ARRIVAL_TEXT = "least((cast(substring(tradeDate, 1, 2) as int) - 1) div 10, 2) + if(quantity % 10 = 0, 1, 0)"


def _late_sql(where: str = "true") -> str:
    return f"""b as (select *, {_ARRIVAL} as batch from t where {where}),
    m as (select batch, max(dt) as newest from b group by batch),
    w as (select batch, max(newest) over (order by batch rows between unbounded preceding and 1 preceding) - interval 10 minute as mark from m),
    l as (select b.*, coalesce(time_bucket(interval 5 minute, dt) + interval 5 minute <= mark, false) as late from b join w using (batch))"""


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).withColumn("batch", F.expr(_ARRIVAL_TEXT))


@query("watermarks", f"with {_T}, {_late_sql()} select cast(batch as int) as batch, mark as watermark from w")
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.watermarks(_arriving(spark, sf_dir), "batch")


@query("late_trades", f'with {_T}, {_late_sql()} select tn as "tradeNo", cast(batch as int) as batch, dt from l where late')
def late_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.late_trades(_arriving(spark, sf_dir), "batch").select("tradeNo", "batch", "dt")


@query("candles_in_time", f"with {_T}, {_late_sql()} {_candle_sql('l', where='not late')}")
def candles_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.candles(op.trades_in_time(_arriving(spark, sf_dir), "batch"))


@query("late_combined", f"with {_T} {_partial_sql()}")
def late_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late trades put to the candles that were made without them."""
    trades = _arriving(spark, sf_dir)
    parts = [op.candle_partials(part(trades, "batch")) for part in (op.trades_in_time, op.late_trades)]
    return op.combine_candles(parts[0].unionByName(parts[1]))


# ---------------------------------------------------------------- messages

_POS = "'trades' as topic, cast(tn % 3 as int) as partition, tn // 3 as \"offset\""


@query(
    "encode_messages",
    f"""with {_T} select tn as "tradeNo", 'eventType' as header_key, 'MARKET_RECORD' as header_value, p as price,
    'tradeNo,tradeDate,tradeTime,secId,boardId,price,quantity,value,buySell,tradingSession' as fields from t""",
)
def encode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("value").cast("string")
    header = F.col("headers")[0]
    return op.to_messages(inputs.trades(spark, sf_dir)).select(
        F.get_json_object(text, "$.tradeNo").cast("bigint").alias("tradeNo"),
        header["key"].alias("header_key"),
        header["value"].cast("string").alias("header_value"),
        F.get_json_object(text, "$.price").cast("double").alias("price"),
        F.array_join(F.json_object_keys(text), ",").alias("fields"),
    )


@query("message_roundtrip", f"with {_T} select {_TRADE_ROW} from t")
def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.decode_trades(op.to_messages(inputs.trades(spark, sf_dir))).select(*TRADE.names)


@query("header_filter", f"with {_T} select {_POS} from t where {_HEADER_OK}")
def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op.filter_events(inputs.messages(spark, sf_dir), ["MARKET_RECORD"])
    return kept.select("topic", "partition", "offset")


@query("drop_null_messages", f"with {_T} select {_POS} from t where k <> 0")
def drop_null_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.drop_null_messages(inputs.messages(spark, sf_dir)).select("topic", "partition", "offset")


@query(
    "decode_trades",
    f"""with {_T} select {_POS}, {_TRADE_ROW} from t
    where {_HEADER_OK} and k <> 0 and tk not in ('signup', 'purchase')""",
)
def decode_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = op.valid_trades(decoded_stream(inputs.messages(spark, sf_dir)))
    return good.select("topic", "partition", "offset", *TRADE.names)


_BAD = f"""with {_T} select {_POS}, case tk when 'signup' then 'malformed' else 'price' end as problem from t
    where {_HEADER_OK} and k <> 0 and tk in ('signup', 'purchase')"""


@query("malformed_messages", _BAD)
def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = op.invalid_trades(decoded_stream(inputs.messages(spark, sf_dir)))
    return bad.select("topic", "partition", "offset", "problem")


@query("message_candles", f"with {_T} {_candle_sql(where=_USABLE)}")
def message_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.candles(op.valid_trades(decoded_stream(inputs.messages(spark, sf_dir))))


# ---------------------------------------------------------------- progress and metrics


@query(
    "offset_ranges",
    f"""with {_T}, m as (select {_POS} from t)
    select topic, partition, min("offset") as from_offset, max("offset") + 1 as until_offset, count(*) as n
    from m group by topic, partition""",
)
def offset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.offset_ranges(inputs.positions(spark, sf_dir))


@query(
    "ledger",
    f"""with {_T}, m as (select {_POS} from t)
    select 'candles' as app_name, topic, partition as part, max("offset") + 1 as last_offset
    from m group by topic, partition""",
)
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.new_dir(spark, "ledger")
    sent = inputs.positions(spark, sf_dir)
    append_ledger(sent.where("partition <> 2"), path, "candles", 0)
    append_ledger(sent, path, "candles", 1)
    append_ledger(sent, path, "another", 0)
    return read_ledger(spark, path, "candles", ["trades"])


# Saved: partition 0 within its range, 1 beyond it, 5 of a partition that is gone; never saved: 2.
_SAVED = f"""m as (select {_POS} from t),
    h as (select topic, partition, min("offset") as lo, max("offset") + 1 as hi from m group by all),
    s as (select topic, partition, case partition when 0 then 101 else hi + 1000 end as saved from h where partition < 2
          union all select topic, 5, hi from h where partition = 1)"""


def _saved_and_held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path, sent = files.new_dir(spark, "ledger"), inputs.positions(spark, sf_dir)
    one = sent.where("partition = 1")
    read = sent.where("partition = 0 and offset <= 100").unionByName(one.withColumn("offset", F.expr("offset + 1000")))
    append_ledger(read.unionByName(one.withColumn("partition", F.lit(5))), path, "candles", 0)
    return read_ledger(spark, path, "candles", ["trades"]), op.offset_ranges(sent)


@query(
    "start_positions",
    f"""with {_T}, {_SAVED}
    select topic, partition, case when saved is null then lo when hi is null or saved between lo and hi then saved else hi end as position,
           case when saved is null then 'unsaved' when hi is null then 'not held' when saved between lo and hi then 'saved' else 'outside' end as rule
    from h full join s using (topic, partition)""",
)
def start_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.start_positions(*_saved_and_held(spark, sf_dir))


@query(
    "start_positions_unsaved",
    f"with {_T}, {_SAVED} select topic, partition, hi as position, 'ends' as rule from h",
)
def start_positions_unsaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is saved: reading begins at the ends."""
    saved, held = _saved_and_held(spark, sf_dir)
    return op.start_positions(saved.where("app_name = 'another'"), held)


@query(
    "start_positions_leave",
    f"""with {_T}, {_SAVED}
    select topic, partition, case when hi is null or saved between lo and hi then saved else hi end as position,
           case when hi is null then 'not held' when saved between lo and hi then 'saved' else 'outside' end as rule
    from s left join h using (topic, partition)""",
)
def start_positions_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that were never saved are not read."""
    return op.start_positions(*_saved_and_held(spark, sf_dir), unsaved="leave")


# Messages of a partition in one batch.
_RATE = 64


@query(
    "planned_batches",
    f"""with {_T}, m as (select {_POS} from t), r as (select topic, partition, min("offset") as lo, max("offset") + 1 as hi from m group by all)
    select i as batch_id, topic, partition, lo + i * {_RATE} as from_offset, least(lo + i * {_RATE} + {_RATE}, hi) as until_offset
    from r, lateral (select unnest(range((hi - lo + {_RATE - 1}) // {_RATE})) as i)""",
)
def planned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.planned_batches(op.offset_ranges(inputs.positions(spark, sf_dir)), _RATE)


@query(
    "rated_microbatch_candles",
    f"""with {_T}, m as (select *, {_POS} from t), n as (select *, ("offset" - min("offset") over (partition by partition)) // {_RATE} as batch from m),
    c as ({_candle_sql("n", extra="batch, ", where=_USABLE)})
    select datetime, ticker, arg_min(open, batch) as open, arg_min(high, batch) as high,
           arg_min(low, batch) as low, arg_min(close, batch) as close, arg_min(value, batch) as value
    from c group by datetime, ticker""",
)
def rated_microbatch_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-batch candles when each batch reads so many messages of a partition at most."""
    ranges = op.offset_ranges(inputs.positions(spark, sf_dir))
    sent = op.valid_trades(decoded_stream(inputs.messages(spark, sf_dir)))
    return op.microbatch_candles(op.with_planned_batch(sent, ranges, _RATE), "batch_id")


@query(
    "batch_size_quantiles",
    f"""with {_T}, b as (select cast(dt as date) as day, tk as service_name, date_trunc('minute', dt) as minute, count(*) as size from t group by all)
    select day, count(*) as n, quantile_disc(size, 0.5) as half, quantile_disc(size, 0.9) as most, max(size) as largest from b group by day""",
)
def batch_size_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of one-minute batches: a sketch per service and day, then one per day of all services.

    A day has at most 1,440 batches of each of five services, fewer than `k`, so that the quantiles are exact.
    """
    sizes = _valid(spark, sf_dir).groupBy(F.to_date("dt").alias("day"), "secId", F.date_trunc("minute", "dt").alias("minute")).agg(F.count("*").alias("size"))
    sketches = op.merge_sketches(op.value_sketches(sizes, "size", ["day", "secId"], 8192), ["day"], 8192)
    shares = {"half": 0.5, "most": 0.9, "largest": 1.0}
    return sketches.select("day", "n", *[op.quantile_of(share).alias(name) for name, share in shares.items()])


@query(
    "batch_sizes",
    f"with {_T} select epoch(dt)::bigint // 60 as batch_id, count(*) as batch_size from t group by 1",
)
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _valid(spark, sf_dir)
    return op.batch_sizes(trades, F.floor(F.unix_seconds(TF.to_instant("dt")) / 60).cast("bigint"))


@query(
    "batch_metrics",
    f"""with {_T}
    select tn // 6 as batch_id, count(*) as batch_size, 'candles' as service_name,
           case when bool_and(tk not in ('signup', 'purchase')) then 'OK' else 'FAIL' end as status
    from t where {_HEADER_OK} and k <> 0 group by 1""",
)
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of two messages per partition; a batch with an unreadable message counts as failed."""
    tagged = op.with_problem(decoded_stream(inputs.messages(spark, sf_dir)))
    batch = F.floor(F.col("offset") / 2).cast("bigint")
    return tagged.groupBy(batch.alias("batch_id")).agg(
        F.count("*").alias("batch_size"),
        F.lit("candles").alias("service_name"),
        TF.status_label(F.bool_and(F.col("problem").isNull())).alias("status"),
    )


# ---------------------------------------------------------------- upsert and backfill

_SIDES = f"""with {_T}, e as ({_candle_sql(where="k < 50")}), i as ({_candle_sql(where="k >= 50")})"""
_KEEP_FIRST = f"{_SIDES} select * from e union all select i.* from i anti join e using (datetime, ticker)"
_REPLACE = f"{_SIDES} select * from i union all select e.* from e anti join i using (datetime, ticker)"


def _buys_and_sells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trades = _valid(spark, sf_dir)
    return op.candles(trades.where("buySell = 'B'")), op.candles(trades.where("buySell = 'S'"))


def _upserts(policy: str, sql: str) -> None:
    @query(f"upsert_{policy}", sql)
    def table_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
        existing, incoming = _buys_and_sells(spark, sf_dir)
        return op.upsert(existing, incoming, CANDLE_KEYS, policy)

    @query(f"merge_candles_{policy}", sql)
    def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = files.new_dir(spark, "candles")
        for side in _buys_and_sells(spark, sf_dir):
            merge_candles(side, path, policy)
        return read_candles(spark, path).select(*CANDLE.names)


_upserts("keep_first", _KEEP_FIRST)
_upserts("replace", _REPLACE)


def _newest_sql(*sides: str) -> str:
    """Of the candles of one key in some tables the one of the greatest version; of equal ones that of the last table."""
    every = " union all ".join(f"select *, {i} as place from {side}" for i, side in enumerate(sides))
    best = "row_number() over (partition by datetime, ticker order by trades desc, close_time desc, close_no desc, place desc)"
    return f"select * exclude (place) from ({every}) qualify {best} = 1"


@query(
    "upsert_newest",
    f"with {_T}, e as ({_partial_sql(where='k < 50')}), i as ({_partial_sql(where='k >= 50')}) {_newest_sql('e', 'i')}",
)
def upsert_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candle of the buys or of the sells, whichever knows of more trades."""
    trades = _valid(spark, sf_dir)
    sides = [op.candle_partials(trades.where(f"buySell = '{side}'")) for side in "BS"]
    return op.upsert(*sides, CANDLE_KEYS, "newest", CANDLE_VERSION)


def _states(trades: DataFrame) -> list[DataFrame]:
    """What a stateful stream would emit after each of three batches: candles of all trades so far."""
    return [op.candle_partials(trades.where(f"tradeNo % 3 <= {n}")) for n in range(3)]


@query("merge_newest_any_order", f"with {_T} {_candle_sql()}")
def merge_newest_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of a stream merged last one first, the first one twice: the newest stays."""
    path = files.new_dir(spark, "candles")
    first, second, third = _states(_valid(spark, sf_dir))
    for state in (third, first, second, first):
        merge_candles(state, path, "newest", CANDLE_VERSION)
    return read_candles(spark, path).select(*CANDLE.names)


@query("backfill", f"with {_TABLE_T} {_candle_sql()}")
def backfill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill(inputs.deals(spark, sf_dir))


_ONE_DAY = f"cast(dt as date) = date '{DAY}'"


@query("backfill_day", f"with {_TABLE_T} {_candle_sql(where=_ONE_DAY)}")
def backfill_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill_day(inputs.deals(spark, sf_dir), DAY)


@query(
    "backfill_repair",
    f"""with {_TABLE_T}, lost as ({_candle_sql(where="k < 50")}), made as ({_candle_sql(where=_ONE_DAY)})
    select * from made union all select lost.* from lost anti join made using (datetime, ticker)""",
)
def backfill_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that has lost the sells, with one day made good."""
    path = files.new_dir(spark, "candles")
    table = inputs.deals(spark, sf_dir)
    merge_candles(backfill(table.where("BUYSELL = 'B'")), path)
    merge_candles(backfill_day(table, DAY), path, "replace")
    return read_candles(spark, path).select(*CANDLE.names)


_LOST_TABLE = f"""with {_TABLE_T}, lost as ({_candle_sql(where="k < 50")}), made as ({_candle_sql(where=_ONE_DAY)}), whole as ({_candle_sql()}),
    stored as (select * from made union all select lost.* from lost anti join made using (datetime, ticker))"""


def _lost_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The trades table, and the place of the candle table of `backfill_repair`, which lacks the sells of all other days."""
    path = files.new_dir(spark, "candles")
    table = inputs.deals(spark, sf_dir)
    merge_candles(backfill(table.where("BUYSELL = 'B'")), path)
    merge_candles(backfill_day(table, DAY), path, "replace")
    return table, path


@query(
    "repair_plan",
    f"""{_LOST_TABLE}, d as (select * from (select * from stored except select * from whole) union select * from (select * from whole except select * from stored)),
    k as (select distinct cast(datetime as date) as day, ticker from d),
    s as (select cast(datetime as date) as day, ticker, count(*) as n from stored group by all),
    w as (select cast(datetime as date) as day, ticker, count(*) as n from whole group by all)
    select day, ticker, coalesce(s.n, 0) as n_stored, coalesce(w.n, 0) as n_made
    from k left join s using (day, ticker) left join w using (day, ticker)""",
)
def repair_plan_of_lost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, path = _lost_table(spark, sf_dir)
    return repair_plan(read_candles(spark, path), backfill(table))


@query("repair", f"with {_TABLE_T} {_candle_sql()}")
def repair_of_lost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, path = _lost_table(spark, sf_dir)
    repair(table, path)
    return read_candles(spark, path).select(*CANDLE.names)


# Days of three jobs; the exchange is closed on the last one.
_JOB_DAYS = [DAY, DAY + dt.timedelta(days=1), dt.date(2000, 1, 1)]
_JOBS = ", ".join(f"(date '{day}', {number})" for number, day in enumerate(_JOB_DAYS))
_ONE_OF_DAYS = f"cast(dt as date) in ({', '.join(f"date '{day}'" for day in _JOB_DAYS)})"


def _run_jobs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Places of the candle table and of the metrics of a job a day, of which the second fails once, after its write."""
    path, metrics = files.new_dir(spark, "candles"), files.new_dir(spark, "metrics")
    table, sink = inputs.deals(spark, sf_dir), candle_table(path)

    def fails(rows: DataFrame, number: int) -> None:
        sink(rows, number)
        raise InterruptedError("after the write")

    for number, day in enumerate(_JOB_DAYS):
        if number == 1:
            try:
                run_job(table, fails, day, metrics=metrics, batch_id=number)
            except InterruptedError:
                pass
        run_job(table, sink, day, metrics=metrics, batch_id=number)
    return path, metrics


@query("job_candles", f"with {_TABLE_T} {_candle_sql(where=_ONE_OF_DAYS)}")
def job_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the jobs leave in the table; the day of the job that failed and ran again is there once."""
    return read_candles(spark, _run_jobs(spark, sf_dir)[0]).select(*CANDLE.names)


@query(
    "job_metrics",
    f"""with {_TABLE_T}, d as (select * from (values {_JOBS}) as v(day, batch_id))
    select 'OK' as status, cast(batch_id as bigint) as batch_id, count(dt) as batch_size, true as timed
    from d left join t on cast(dt as date) = day group by batch_id
    union all select 'FAIL', 1, 0, true""",
)
def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each run of a job, also for the one that failed: trades read, and whether the time taken is known."""
    rows = spark.read.parquet(_run_jobs(spark, sf_dir)[1])
    return rows.select("status", "batch_id", "batch_size", F.coalesce(F.col("request_time") >= 0, F.lit(False)).alias("timed"))


# ---------------------------------------------------------------- streams


def _stream_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.valid_trades(inputs.trades_of(inputs.events_stream(spark, sf_dir)))


def _run_into_table(spark: SparkSession, out: DataFrame, policy: str) -> DataFrame:
    path = files.new_dir(spark, "candles")
    writer = out.writeStream.outputMode("update").foreachBatch(candle_table(path, policy))
    writer = writer.option("checkpointLocation", files.new_dir(spark, "checkpoint"))
    writer.trigger(**_NOW).start().awaitTermination()
    return read_candles(spark, path).select(*CANDLE.names)


@query("stream_candles", f"with {_T} {_candle_sql()}")
def stateful_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a candle, merged into a table."""
    return _run_into_table(spark, stream_candles(_stream_trades(spark, sf_dir)), "replace")


@query("stream_dedup_candles", f"with {_T} {_candle_sql()}")
def dedup_stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when every buy is sent twice."""
    sent = _stream_trades(spark, sf_dir)
    twice = F.when(F.col("buySell") == "B", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    sent = sent.withColumn("copy", F.explode(twice)).drop("copy")
    return _run_into_table(spark, stream_candles(sent, dedup=True), "replace")


@query(
    "stream_final_candles",
    f"""with {_T}, c as ({_candle_sql()})
    select * from c where datetime + interval 5 minute <= (select max(dt) from t) - interval 10 minute""",
)
def final_stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles that the watermark has closed, appended to files."""
    path = files.new_dir(spark, "candles")
    out = stream_candles(_stream_trades(spark, sf_dir), lateness="10 minutes")
    writer = out.withColumn("trade_date", F.to_date("datetime")).writeStream.outputMode("append")
    writer = writer.format("parquet").partitionBy("trade_date").option("path", path)
    writer = writer.option("checkpointLocation", files.new_dir(spark, "checkpoint"))
    writer.trigger(**_NOW).start().awaitTermination()
    return spark.read.parquet(path).select(*CANDLE.names)


def _from_messages(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = files.new_dir(spark, "candles")
        sent = inputs.messages_of(inputs.trades_of(inputs.events_stream(spark, sf_dir)))
        policy = "keep_first" if mode == "per_batch" else "replace"
        records = {}
        if mode == "per_batch":
            records = {"ledger": files.new_dir(spark, "ledger"), "metrics": files.new_dir(spark, "metrics")}
        name = path[-32:]
        started = start_candles(
            sent,
            candle_table(path, policy),
            files.new_dir(spark, "checkpoint"),
            mode,
            app=f"candles-{name}",
            trigger=_NOW,
            **records,
        )
        started.awaitTermination()
        return read_candles(spark, path).select(*CANDLE.names)

    return run


query("stream_message_candles", f"with {_T} {_candle_sql(where=_USABLE)}")(_from_messages("stateful"))
query("stream_per_batch", f"with {_T} {_candle_sql(where=_USABLE)}")(_from_messages("per_batch"))


@query("stream_quarantine", _BAD)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.new_dir(spark, "quarantine")
    sent = inputs.messages_of(inputs.trades_of(inputs.events_stream(spark, sf_dir)))
    start_quarantine(sent, path, files.new_dir(spark, "checkpoint"), trigger=_NOW).awaitTermination()
    return spark.read.parquet(path).select("topic", "partition", "offset", "problem")


# ---------------------------------------------------------------- streams of several batches

# All messages in three batches of files, once by trade number, which cuts every candle, and once in the order of time.
_BY_NUMBER, _BY_TIME = "tn % 3", "least((day(dt) - 1) // 10, 2)"
_NUMBER = "tradeNo % 3"
_TIME = "least((cast(substring(tradeDate, 1, 2) as int) - 1) div 10, 2)"


def _file_stream_of(spark: SparkSession, sf_dir: str, *numbers: str) -> tuple[DataFrame, int]:
    """The stream, and how many files a batch of it has."""
    path, n = inputs.message_batches(spark, sf_dir, *numbers)
    return stream_messages(spark, "parquet", path, maxFilesPerTrigger=str(n)), n


def _file_stream(spark: SparkSession, sf_dir: str, *numbers: str) -> DataFrame:
    return _file_stream_of(spark, sf_dir, *numbers)[0]


@query("message_files", f"with {_T} select {_POS}, {_TRADE_ROW} from t where {_USABLE}")
def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written to files and read back as a batch."""
    found = read_messages(spark, "parquet", inputs.message_batches(spark, sf_dir, _NUMBER)[0])
    return op.valid_trades(decoded_stream(found)).select("topic", "partition", "offset", *TRADE.names)


@query(
    "stream_files_per_batch",
    f"""with {_T}, b as (select *, {_BY_NUMBER} as batch from t where {_USABLE}),
    c as ({_candle_sql("b", extra="batch, ")})
    select datetime, ticker, arg_min(open, batch) as open, arg_min(high, batch) as high,
           arg_min(low, batch) as low, arg_min(close, batch) as close, arg_min(value, batch) as value
    from c group by datetime, ticker""",
)
def stream_files_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each with candles of its own: the first one to write a candle wins."""
    path = files.new_dir(spark, "candles")
    sent = _file_stream(spark, sf_dir, _NUMBER)
    checkpoint = files.new_dir(spark, "checkpoint")
    start_candles(sent, candle_table(path, "keep_first"), checkpoint, "per_batch", app=path[-32:], trigger=_NOW).awaitTermination()
    return read_candles(spark, path).select(*CANDLE.names)


@query("stream_files_stateful", f"with {_T} {_candle_sql(where=_USABLE)}")
def stream_files_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches in the order of time; state carries a candle over from one to the next."""
    path = files.new_dir(spark, "candles")
    sent, n = _file_stream_of(spark, sf_dir, _TIME)
    with state_partitions(spark, n):
        started = start_candles(sent, candle_table(path), files.new_dir(spark, "checkpoint"), app=path[-32:], trigger=_NOW)
    started.awaitTermination()
    return read_candles(spark, path).select(*CANDLE.names)


@query("stream_restart", f"with {_T} {_candle_sql(where=_USABLE)}")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink fails in the second batch, after its write; the query goes on from the checkpoint."""
    path, checkpoint = files.new_dir(spark, "candles"), files.new_dir(spark, "checkpoint")
    sent, n = _file_stream_of(spark, sf_dir, _TIME)
    good, failed = candle_table(path), []

    def sink(batch: DataFrame, batch_id: int) -> None:
        good(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise ConnectionError("lost on purpose")

    def once() -> None:
        with state_partitions(spark, n):
            started = start_candles(sent, sink, checkpoint, app=path[-32:], trigger=_NOW)
        started.awaitTermination()

    try:
        once()
    except StreamingQueryException:
        once()
    return read_candles(spark, path).select(*CANDLE.names)


@query(
    "stream_lost_checkpoint",
    f"""with {_T}, a as ({_partial_sql(where=f"{_USABLE} and tn % 3 < 2")}),
    b as ({_partial_sql(where=f"{_USABLE} and tn % 3 = 2")})
    select {", ".join(CANDLE.names)} from ({_newest_sql("a", "b")})""",
)
def stream_lost_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that starts again without its state knows the rest of a candle only, which does not replace the greater part."""
    path = files.new_dir(spark, "candles")
    for part in ("tradeNo % 3 < 2", "tradeNo % 3 = 2"):
        sent = inputs.messages_of(inputs.trades_of(inputs.events_stream(spark, sf_dir)).where(part))
        sink, checkpoint = candle_table(path, "newest", CANDLE_VERSION), files.new_dir(spark, "checkpoint")
        start_candles(sent, sink, checkpoint, app=path[-32:], trigger=_NOW, versioned=True).awaitTermination()
    return read_candles(spark, path).select(*CANDLE.names)


@query("stream_partials", f"with {_T} {_candle_sql(where=_USABLE)}")
def stream_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that cut every candle, without state: each leaves its parts, which readers put together."""
    path = files.new_dir(spark, "parts")
    sent, checkpoint = _file_stream(spark, sf_dir, _NUMBER), files.new_dir(spark, "checkpoint")
    sink = lambda parts, batch_id: write_batch(parts, path, batch_id)
    start_candles(sent, sink, checkpoint, "per_batch", app=path[-32:], trigger=_NOW, versioned=True).awaitTermination()
    return op.plain_candles(op.combine_candles(read_batches(spark, path, PARTIAL)))


def _late_stream(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Places of the parts in time and of the late trades, after a stream of four batches."""
    path, late = files.new_dir(spark, "parts"), files.new_dir(spark, "late")
    sent, checkpoint = _file_stream(spark, sf_dir, _ARRIVAL_TEXT), files.new_dir(spark, "checkpoint")
    sink = lambda parts, batch_id: write_batch(parts, path, batch_id)
    how = {"versioned": True, "late": late, "lateness": "10 minutes"}
    start_candles(sent, sink, checkpoint, "per_batch", app=path[-32:], trigger=_NOW, **how).awaitTermination()
    return path, late


@query("stream_late_trades", f'with {_T}, {_late_sql(_USABLE)} select tn as "tradeNo", cast(batch as bigint) as batch_id, dt from l where late')
def stream_late_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_late(spark, _late_stream(spark, sf_dir)[1]).select("tradeNo", "batch_id", "dt")


@query("stream_late_combined", f"with {_T} {_candle_sql(where=_USABLE)}")
def stream_late_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late trades of a stream put to its candles later on."""
    path, late = _late_stream(spark, sf_dir)
    parts = read_batches(spark, path, PARTIAL).drop("batch_id")
    return op.plain_candles(op.combine_candles(parts.unionByName(op.candle_partials(read_late(spark, late)))))


@query("stream_resent", f"with {_T} {_candle_sql(where=_USABLE)}")
def stream_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buys come again in a fourth batch, weeks after the watermark has forgotten them."""
    path, numbers = files.new_dir(spark, "parts"), files.new_dir(spark, "numbers")
    sent = _file_stream(spark, sf_dir, _TIME, "if(buySell = 'B', 3, null)")
    sink = lambda parts, batch_id: write_batch(parts, path, batch_id)
    how = {"versioned": True, "numbers": numbers, "trigger": _NOW}
    start_candles(sent, sink, files.new_dir(spark, "checkpoint"), "per_batch", app=path[-32:], **how).awaitTermination()
    return op.plain_candles(op.combine_candles(read_batches(spark, path, PARTIAL)))


@query(
    "stream_day_totals",
    f"""with {_T}, c as ({_candle_sql(where=_USABLE)}),
    d as (select cast(datetime as date) as day, ticker, count(*) as candles, arg_min(open, datetime) as open, max(high) as high,
                 min(low) as low, arg_max(close, datetime) as close, cast(sum(value) as bigint) as value from c group by all)
    select d.* from d where day + interval 1 day <= (select max(dt) from t where {_USABLE}) - interval 10 minute""",
)
def day_totals_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed, over three batches; the stream ends after each and goes on from its checkpoint."""
    path, checkpoint, folder = (files.new_dir(spark, n) for n in ("totals", "checkpoint", "messages"))
    for part in (f"{_TIME} < 2", f"{_TIME} = 2"):
        n = inputs.add_message_batches(spark, sf_dir, folder, _TIME, where=part)
        sent = stream_messages(spark, "parquet", folder, maxFilesPerTrigger=str(n))
        out = stream_day_totals(op.valid_trades(decoded_stream(sent)))
        writer = out.writeStream.outputMode("append").format("parquet").option("path", path)
        writer = writer.option("checkpointLocation", checkpoint).trigger(**_NOW)
        with state_partitions(spark, n):
            started = writer.start()
        started.awaitTermination()
    return spark.read.parquet(path)


def _metrics_of(mode: str) -> Query:
    number, cut = (_NUMBER, _BY_NUMBER) if mode == "per_batch" else (_TIME, _BY_TIME)
    kept = f"{_HEADER_OK} and k <> 0"
    sql = f"""with {_T}, f as (select *, {cut} as file from t), n as (select file, count(*) filter ({_USABLE}) as good,
              count(*) filter ({kept} and not ({_USABLE})) as bad from f group by file)
    select 'OK' as status, row_number() over (order by file) - 1 as batch_id, good as batch_size, bad as invalid_rows from n"""

    @query(f"stream_metrics_{mode}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, metrics = files.new_dir(spark, "candles"), files.new_dir(spark, "metrics")
        sink = candle_table(path, "keep_first" if mode == "per_batch" else "replace")
        (sent, n), checkpoint = _file_stream_of(spark, sf_dir, number), files.new_dir(spark, "checkpoint")
        with state_partitions(spark, n):
            started = start_candles(sent, sink, checkpoint, mode, app=path[-32:], trigger=_NOW, metrics=metrics)
        started.awaitTermination()
        recorded(started)
        return spark.read.parquet(metrics).select("status", "batch_id", "batch_size", "invalid_rows")

    return run


for _mode in ("per_batch", "stateful"):
    _metrics_of(_mode)


@query(
    "stream_ledger",
    f"""with {_T}, m as (select {_POS}, {_BY_NUMBER} as file from t)
    select topic, partition as part, file as batch_id, max("offset") + 1 as last_offset from m group by all""",
)
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that each of three batches has left in the ledger."""
    path, ledger = files.new_dir(spark, "candles"), files.new_dir(spark, "ledger")
    sent, checkpoint = _file_stream(spark, sf_dir, _NUMBER), files.new_dir(spark, "checkpoint")
    sink = candle_table(path, "keep_first")
    start_candles(sent, sink, checkpoint, "per_batch", app=path[-32:], trigger=_NOW, ledger=ledger).awaitTermination()
    return spark.read.parquet(ledger).select("topic", "part", "batch_id", "last_offset")


@query(
    "stream_quarantine_same_parse",
    _BAD.replace(f"select {_POS}", f"select {_BY_NUMBER} as batch_id, {_POS}"),
)
def stream_quarantine_same_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid messages set aside by the query that makes the candles."""
    path, bad = files.new_dir(spark, "candles"), files.new_dir(spark, "quarantine")
    sent, checkpoint = _file_stream(spark, sf_dir, _NUMBER), files.new_dir(spark, "checkpoint")
    sink = candle_table(path, "keep_first")
    start_candles(sent, sink, checkpoint, "per_batch", app=path[-32:], trigger=_NOW, quarantine=bad).awaitTermination()
    kept = spark.read.parquet(bad).select("batch_id", "topic", "partition", "offset", "problem")
    return kept.withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query(
    "stream_skips_empty",
    f"""with {_T}, m as (select {_POS}, {_BY_NUMBER} as batch_id, {_USABLE} as usable from t where tn % 3 <> 1)
    select 'OK' as status, batch_id, count(*) filter (usable) as batch_size, count(*) filter (usable) as kept,
           partition as part, max("offset") + 1 as last_offset
    from m group by batch_id, partition""",
)
def stream_skips_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any job as a stream. The second of three batches holds no message that it reads: no rows, metric or position of it."""
    path, metrics, ledger = (files.new_dir(spark, what) for what in ("trades", "metrics", "ledger"))
    sent = _file_stream(spark, sf_dir, _NUMBER).where("partition <> 1")
    started = start_stream(
        sent,
        [decoded_stream, op.valid_trades],
        lambda rows, number: write_batch(rows.select(*TRADE.names), path, number),
        files.new_dir(spark, "checkpoint"),
        _NOW,
        app=path[-32:],
        ledger=ledger,
        metrics=metrics,
    )
    started.awaitTermination()
    kept = read_batches(spark, path, TRADE).groupBy("batch_id").agg(F.count("*").alias("kept"))
    found = kept.join(spark.read.parquet(metrics).select("batch_id", "status", "batch_size"), "batch_id", "full")
    return found.join(spark.read.parquet(ledger).select("batch_id", "part", "last_offset"), "batch_id", "full")
