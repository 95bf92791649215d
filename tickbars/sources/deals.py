"""The raw trades table, from delimited files or a database."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tickbars.functions import day_spellings
from tickbars.schemas import DEAL
from tickbars.sources.ranges import predicates_at, range_predicates


def read_deals_csv(spark: SparkSession, path: str | list[str], sep: str = ";", mode: str = "FAILFAST") -> DataFrame:
    """Delimited files with a header line. A bad value stops the read unless `mode` says otherwise.

    Spark parses the columns that a query uses, so bad values in others go unnoticed.
    """
    reader = spark.read.schema(DEAL).option("sep", sep).option("header", True)
    # The header is checked against the schema; without that, exchanged columns go unnoticed.
    return reader.option("enforceSchema", False).option("mode", mode).csv(path)


def read_deals_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "DEAL",
    driver: str | None = None,
    partition_on: str | None = "TRADENO",
    days: Sequence[dt.date] | None = None,
    num_partitions: int = 10,
    fetchsize: int = 10_000,
    query_timeout: int = 0,
    balanced: bool = False,
    **options: str,
) -> DataFrame:
    """Table scan in parallel.

    Ranges of `partition_on`, a numeric column, whose bounds the database is asked for. With `days`, only those
    days are read, and the bounds are those of each day, which is then read in `num_partitions` ranges.
    With `partition_on` None, a single connection reads each day or the whole table. Credentials go into `options`.
    `balanced`, of a whole table, reads that column alone first and cuts where its quantiles are: numbers that jump from
    day to day would leave most equal steps empty.
    """
    base = {
        "url": url,
        "fetchsize": str(fetchsize),
        "queryTimeout": str(query_timeout),
        **({"driver": driver} if driver else {}),
        **options,
    }
    if days is not None:
        properties = {k: v for k, v in base.items() if k != "url"}
        predicates = _day_ranges(spark, base, table, partition_on, days, num_partitions)
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    reader = spark.read.format("jdbc").options(**base).option("dbtable", table)
    if partition_on is None:
        return reader.load()
    bounds_query = f"(select min({partition_on}) as LO, max({partition_on}) as HI from {table}) b"
    low, high = spark.read.format("jdbc").options(**base).option("dbtable", bounds_query).load().first()
    if low is None:
        return reader.load()
    steps = (
        reader.option("numPartitions", num_partitions)
        .option("partitionColumn", partition_on)
        .option("lowerBound", int(low))
        .option("upperBound", int(high) + 1)
        .load()
    )
    if not balanced:
        return steps
    predicates = range_predicates(steps.select(partition_on), partition_on, num_partitions)
    properties = {k: v for k, v in base.items() if k != "url"}
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def _day_ranges(
    spark: SparkSession, base: dict[str, str], table: str, column: str | None, days: Sequence[dt.date], n: int
) -> list[str]:
    """Predicates that share out the rows of each day; days without rows get one that finds nothing."""
    spellings = {d: ", ".join(f"'{text}'" for text in day_spellings(d)) for d in dict.fromkeys(days)}
    if column is None or not spellings:
        return [f"TRADEDATE in ({texts})" for texts in spellings.values()] or ["1 = 0"]
    every = ", ".join(spellings.values())
    query = f"(select TRADEDATE as DAY_TEXT, min({column}) as LO, max({column}) as HI from {table} where TRADEDATE in ({every}) group by TRADEDATE) b"
    bounds = {r[0]: (r[1], r[2]) for r in spark.read.format("jdbc").options(**base).option("dbtable", query).load().collect()}
    out = []
    for day, texts in spellings.items():
        found = [bounds[t] for t in day_spellings(day) if t in bounds and bounds[t][0] is not None]
        whole = f"TRADEDATE in ({texts})"
        if not found:
            out.append(whole)
            continue
        low, high = int(min(lo for lo, _ in found)), int(max(hi for _, hi in found))
        step = -(-(high - low + 1) // n)
        cuts = list(range(low + step, high + 1, step))
        # Open at both ends, so that rows that come meanwhile are read too.
        out += [f"{whole} and {t}" for t in predicates_at(column, cuts)]
    return out
