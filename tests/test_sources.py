from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from helpers import at, by_key
from test_trades import deals
from tickbars.plans import backfill, backfill_day, run_job
from tickbars.plans.backfill import ZONE
from tickbars.plans.repair import repair, repair_plan
from tickbars.schemas import DEAL
from tickbars.sinks import candle_table, merge_candles, read_candles
from tickbars.sources import read_deals_csv, read_deals_jdbc

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_csv(spark, tmp_path):
    path = tmp_path / "deals.csv"
    path.write_text(
        ";".join(DEAL.names) + "\n"
        "1;01.09.2021;10:00:00;SBER;TQBR;10.50;3;31.50;REGULAR;B;MAIN\n"
        "2;01.09.2021;10:01:00;SBER;TQBR;11;1;11;;S;MAIN\n"
    )
    df = read_deals_csv(spark, str(path))
    assert df.schema == DEAL
    assert [(r.TRADENO, str(r.PRICE), r.TYPE) for r in df.orderBy("TRADENO").collect()] == [(1, "10.50", "REGULAR"), (2, "11.00", None)]
    assert by_key(backfill(df)) == {(at(10, 0), "SBER"): (10.5, 11.0, 10.5, 11.0, 42)}


def test_csv_with_a_bad_line_or_other_columns(spark, tmp_path):
    bad, swapped = tmp_path / "bad.csv", tmp_path / "swapped.csv"
    bad.write_text(";".join(DEAL.names) + "\nx;01.09.2021;10:00:00;SBER;TQBR;10;3;31;REGULAR;B;MAIN\n")
    swapped.write_text(";".join(reversed(DEAL.names)) + "\nMAIN;B;REGULAR;31;3;10;TQBR;SBER;10:00:00;01.09.2021;1\n")
    for path in (bad, swapped):
        with pytest.raises(Exception):
            read_deals_csv(spark, str(path)).collect()
    assert read_deals_csv(spark, str(bad), mode="DROPMALFORMED").collect() == []


@pytest.fixture(scope="module")
def derby(spark):
    """An in-process database of the driver's JVM; local mode is the only place where tasks see it."""
    url = "jdbc:derby:memory:trades;create=true"
    kinds = "TRADEDATE varchar(10), TRADETIME varchar(8)"
    for name, rows in (("DEAL", deals(spark)), ("EMPTY_DEAL", deals(spark).limit(0))):
        writer = rows.write.format("jdbc").option("createTableColumnTypes", kinds)
        writer.options(url=url, dbtable=name, driver=DERBY).save()
    return url


def test_jdbc_by_number_range(spark, derby):
    df = read_deals_jdbc(spark, derby, driver=DERBY, num_partitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r.TRADENO for r in df.collect()) == [0, 1, 2, 3]
    assert read_deals_jdbc(spark, derby, driver=DERBY, partition_on=None).rdd.getNumPartitions() == 1
    assert read_deals_jdbc(spark, derby, "EMPTY_DEAL", driver=DERBY).count() == 0


def test_jdbc_by_day(spark, derby):
    days = [dt.date(2021, 9, 1), dt.date(2021, 9, 2), dt.date(2021, 9, 3)]
    df = read_deals_jdbc(spark, derby, driver=DERBY, days=days)
    assert sorted(r.TRADENO for r in df.collect()) == [0, 1, 2, 3]
    one = read_deals_jdbc(spark, derby, driver=DERBY, days=days[:1], num_partitions=2)
    assert sorted(r.TRADENO for r in one.collect()) == [0, 2]
    assert [n for n in one.rdd.glom().map(len).collect() if n] == [1, 1]
    whole = read_deals_jdbc(spark, derby, driver=DERBY, days=days, partition_on=None)
    assert whole.rdd.getNumPartitions() == 3 and whole.count() == 4
    assert read_deals_jdbc(spark, derby, driver=DERBY, days=[]).count() == 0


def test_day_filter_reaches_the_database(spark, derby):
    made = backfill_day(read_deals_jdbc(spark, derby, driver=DERBY), dt.date(2021, 9, 2))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "In(TRADEDATE" in plan.replace("*", "")
    assert set(by_key(made)) == {(at(10, 0, day=2), "SBER")}


def test_job(spark, tmp_path):
    table, metrics = str(tmp_path / "candles"), str(tmp_path / "metrics")
    rows = deals(spark)
    assert run_job(rows, candle_table(table), dt.date(2021, 9, 1), metrics=metrics) == 2
    assert set(by_key(read_candles(spark, table))) == {(at(10, 0), "SBER")}
    assert run_job(rows, candle_table(table), dt.date(2021, 9, 5), metrics=metrics) == 0

    def fails(df, batch_id):
        raise RuntimeError("no connection")

    with pytest.raises(RuntimeError):
        run_job(rows, fails, dt.date(2021, 9, 1), metrics=metrics)
    got = sorted((r.status, r.batch_size) for r in spark.read.parquet(metrics).collect())
    assert got == [("FAIL", 0), ("OK", 0), ("OK", 2)]


def test_yesterday_is_the_default(spark):
    plan = backfill_day(deals(spark))._jdf.queryExecution().analyzed().toString()
    assert (dt.datetime.now(ZoneInfo(ZONE)).date() - dt.timedelta(days=1)).strftime("%d.%m.%Y") in plan


def test_jdbc_in_ranges_of_equal_size(spark, derby):
    df = read_deals_jdbc(spark, derby, driver=DERBY, num_partitions=4, balanced=True)
    assert sorted(r.TRADENO for r in df.collect()) == [0, 1, 2, 3]
    assert max(df.rdd.glom().map(len).collect()) <= 2
    assert read_deals_jdbc(spark, derby, "EMPTY_DEAL", driver=DERBY, balanced=True).count() == 0


def test_repair_of_damaged_days(spark, tmp_path):
    path, rows = str(tmp_path / "candles"), deals(spark)
    whole = backfill(rows)
    assert repair(rows, path) == [dt.date(2021, 9, 1), dt.date(2021, 9, 2)]
    assert by_key(read_candles(spark, path)) == by_key(whole)
    assert repair(rows, path) == []
    # A wrong close, and a candle that no trade has made.
    wrong = whole.where("day(datetime) = 2").withColumn("close", F.col("close") + 1)
    merge_candles(wrong.unionByName(wrong.withColumn("ticker", F.lit("NONE"))), path)
    plan = repair_plan(read_candles(spark, path), whole)
    assert {(r.day.day, r.ticker, r.n_stored, r.n_made) for r in plan.collect()} == {(2, "SBER", 1, 1), (2, "NONE", 1, 0)}
    assert repair(rows, path) == [dt.date(2021, 9, 2)]
    assert by_key(read_candles(spark, path)) == by_key(whole)
    assert repair_plan(read_candles(spark, path).repartition(7), whole).isEmpty()
