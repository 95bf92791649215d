"""How far messages have been read."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def offset_ranges(messages: DataFrame) -> DataFrame:
    """First and last position per topic partition; `until_offset` is exclusive.

    Take it before any filter, so that dropped messages count as read.
    """
    return messages.groupBy("topic", "partition").agg(
        F.min("offset").alias("from_offset"),
        (F.max("offset") + 1).alias("until_offset"),
        F.count("*").alias("n"),
    )


UNSAVED = ("start", "leave")


def start_positions(saved: DataFrame, held: DataFrame, unsaved: str = "start") -> DataFrame:
    """Where reading begins: topic, partition, `position`, and `rule`, which of these was used.

    `saved` has the saved positions of one application (topic, part, last_offset; see `sources.read_ledger`), `held` the
    ranges that the topics hold (topic, partition, from_offset, until_offset). A position within its range, ends
    included, is taken (`saved`), else the range's end (`outside`). A saved partition that is not held stays as it is
    (`not held`). A held one that was never saved begins at its start (`unsaved`), or with unsaved="leave" is
    not read. If nothing is saved at all, all begin at their ends (`ends`); if nothing is held either, that is an error.
    """
    if unsaved not in UNSAVED:
        raise ValueError(f"unsaved must be one of {UNSAVED}, got {unsaved!r}")
    known = saved.select("topic", F.col("part").alias("partition"), F.col("last_offset").alias("saved"))
    if known.isEmpty():
        if held.isEmpty():
            raise ValueError("no position is saved and no partition is held")
        return held.select("topic", "partition", F.col("until_offset").alias("position"), F.lit("ends").alias("rule"))
    # One row per topic partition on either side.
    joined = held.join(known, ["topic", "partition"], "full_outer")
    rule = F.expr("""case when saved is null then 'unsaved' when until_offset is null then 'not held'
        when saved between from_offset and until_offset then 'saved' else 'outside' end""")
    position = F.expr("case rule when 'unsaved' then from_offset when 'outside' then until_offset else saved end")
    found = joined.withColumn("rule", rule).withColumn("position", position)
    found = found.where("rule <> 'unsaved'") if unsaved == "leave" else found
    return found.select("topic", "partition", "position", "rule")


def starting_offsets(positions: DataFrame) -> str:
    """The text that Kafka's option `startingOffsets` takes for positions, a row per topic partition."""
    out: dict[str, dict[str, int]] = {}
    for topic, partition, position in positions.select("topic", "partition", "position").collect():
        out.setdefault(topic, {})[str(partition)] = position
    return json.dumps(out, sort_keys=True)


# So many batches of a partition are listed in one array.
_CHUNK = 100_000


def planned_batches(ranges: DataFrame, rate: int) -> DataFrame:
    """Ranges of positions cut into batches of at most `rate` messages of each topic partition.

    Batches are numbered from 0; a partition that has fewer messages is missing in the later ones. Ranges are cut by
    arithmetic: no message is read.
    """
    if rate < 1:
        raise ValueError(f"rate must be positive, got {rate!r}")
    held = ranges.where("until_offset > from_offset").withColumn("batches", F.expr(f"(until_offset - from_offset + {rate - 1}) div {rate}"))
    chunks = held.withColumn("chunk", F.expr(f"explode(sequence(0L, batches - 1, {_CHUNK}L))"))
    each = chunks.withColumn("batch_id", F.expr(f"explode(sequence(chunk, least(chunk + {_CHUNK - 1}, batches - 1)))"))
    first = f"from_offset + batch_id * {rate}"
    return each.selectExpr("batch_id", "topic", "partition", f"{first} as from_offset", f"least({first} + {rate}, until_offset) as until_offset")


def batch_options(planned: DataFrame, batch_id: int) -> dict[str, str]:
    """The options with which Kafka is read as a batch for one of the planned batches, a row per topic partition."""
    rows = planned.where(F.col("batch_id") == batch_id)
    ends = {"startingOffsets": "from_offset", "endingOffsets": "until_offset"}
    return {option: starting_offsets(rows.withColumn("position", F.col(column))) for option, column in ends.items()}


def with_planned_batch(messages: DataFrame, ranges: DataFrame, rate: int) -> DataFrame:
    """Messages with `batch_id`, the batch of `planned_batches` that they are in; messages outside of the ranges are left out."""
    starts = ranges.select("topic", "partition", F.col("from_offset").alias("_from"), F.col("until_offset").alias("_until"))
    within = messages.join(starts, ["topic", "partition"]).where("offset >= _from and offset < _until")
    return within.withColumn("batch_id", F.expr(f"(offset - _from) div {rate}")).select(*messages.columns, "batch_id")


def batch_sizes(trades: DataFrame, batch: Column | str) -> DataFrame:
    """Number of rows per batch."""
    batch = F.col(batch) if isinstance(batch, str) else batch
    return trades.groupBy(batch.alias("batch_id")).agg(F.count("*").alias("batch_size"))


def latest_offsets(ledger: DataFrame) -> DataFrame:
    """Newest position per application and topic partition of a ledger."""
    at = F.struct("ts", "batch_id")
    return ledger.groupBy("app_name", "topic", "part").agg(F.max_by("last_offset", at).alias("last_offset"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df`, and the means to count its rows while another action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def count_of(seen: Observation) -> int:
    """Rows that an action has seen. Call it only after an action has run over all of the frame."""
    try:
        return seen.get["n"]
    except Py4JJavaError as e:
        # Adaptive execution removes a stage that turned out empty, and the metric with it.
        # The empty row that is left then has no Python form; any other error is one.
        if "toPyRow" not in str(e) or "AssertionError" not in str(e):
            raise
        return 0
