"""Data source `upsert`: keyed rows into a database table with INSERT ... ON CONFLICT.

    df.write.format("upsert").mode("append").options(
        module="psycopg2", url="...", tableName="CANDLES", keys="DATETIME, TICKER", policy="replace"
    ).save()

Every task opens one connection and sends its rows in chunks within one transaction. A failed task
leaves nothing behind, and a repeated one writes the same rows again, which the key makes harmless.
Tasks commit one by one, so a failed job can leave the rows of the tasks that had finished.
"""

from __future__ import annotations

import importlib
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamWriter,
    DataSourceWriter,
    WriterCommitMessage,
)

from tickbars.operators.candles import WIDE, cast_serving, serving_split
from tickbars.operators.progress import count_of, counted
from tickbars.operators.upsert import check_policy

_TYPES = (
    T.StringType,
    T.LongType,
    T.IntegerType,
    T.ShortType,
    T.ByteType,
    T.DoubleType,
    T.FloatType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.DecimalType,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")
# DB-API parameter styles.
_MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s"}


def upsert_statement(table: str, columns: list[str], keys: list[str], policy: str, mark: str) -> str:
    """The statement for one row. keep_first sets the key to itself, so that a stored row stays."""
    for name in [table, *columns]:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a plain SQL name: {name!r}")
    known = {c.upper() for c in columns}
    missing = [k for k in keys if k.upper() not in known]
    if missing or not keys:
        raise ValueError(f"keys {missing or keys} are not among the columns {columns}")
    key_names = {k.upper() for k in keys}
    rest = [c for c in columns if c.upper() not in key_names]
    changed = keys if check_policy(policy) == "keep_first" or not rest else rest
    return (
        f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) "
        f"ON CONFLICT ({', '.join(keys)}) "
        f"DO UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in changed)}"
    )


class UpsertWriter(DataSourceWriter, DataSourceStreamWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        for name in ("url", "tableName", "keys"):
            if not options.get(name):
                raise ValueError(f"the upsert source needs {name}")
        for f in schema.fields:
            if not isinstance(f.dataType, _TYPES):
                raise ValueError(f"a database parameter cannot hold {f.name}, a {f.dataType.simpleString()}")
        self.module = options.get("module", "psycopg2")
        self.url = options["url"]
        self.connect_args = json.loads(options.get("connectArgs", "{}"))
        self.chunk = int(options.get("batchSize", "1000"))
        self.style = options.get("paramstyle", "")
        # sqlite3 and some others take no Decimal or datetime.
        self.text_for = options.get("textFor", "")
        self.table = options["tableName"]
        self.columns = schema.fieldNames()
        self.keys = [k.strip() for k in options["keys"].split(",") if k.strip()]
        self.policy = check_policy(options.get("policy", "keep_first"))
        if self.policy == "newest":
            raise ValueError("the upsert source knows the policies keep_first and replace")
        upsert_statement(self.table, self.columns, self.keys, self.policy, "?")

    def _values(self, row: Row) -> tuple:
        if not self.text_for:
            return tuple(row)
        kinds = self.text_for.replace(" ", "").split(",")
        return tuple(str(v) if type(v).__name__ in kinds else v for v in row)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        first = next(iterator, None)
        if first is None:
            return WriterCommitMessage()
        driver = importlib.import_module(self.module)
        mark = _MARKS[self.style or driver.paramstyle]
        statement = upsert_statement(self.table, self.columns, self.keys, self.policy, mark)
        connection = driver.connect(self.url, **self.connect_args)
        try:
            cursor = connection.cursor()
            rows = (self._values(r) for r in itertools.chain([first], iterator))
            while chunk := list(itertools.islice(rows, self.chunk)):
                cursor.executemany(statement, chunk)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()
        return WriterCommitMessage()

    # Each task has committed its own rows: nothing is left to do for the job as a whole.
    def commit(self, messages, batchId=None) -> None:
        pass

    def abort(self, messages, batchId=None) -> None:
        pass


class UpsertDataSource(DataSource):
    """Register with `spark.dataSource.register(UpsertDataSource)`.

    Options: `url` (first argument of the driver's connect), `tableName`, `keys`; `policy` keep_first
    (default) or replace; `module` (DB-API module, default psycopg2), `connectArgs` (JSON object),
    `batchSize`, `paramstyle`, `textFor` (Python types to send as text).
    """

    @classmethod
    def name(cls) -> str:
        return "upsert"

    def writer(self, schema: T.StructType, overwrite: bool) -> UpsertWriter:
        if overwrite:
            raise ValueError("the upsert source appends by key; it replaces no table")
        return UpsertWriter(schema, dict(self._plain_options()))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> UpsertWriter:
        return UpsertWriter(schema, dict(self._plain_options()))

    def _plain_options(self) -> dict[str, str]:
        names = (
            "url tableName keys policy module connectArgs batchSize paramstyle textFor"
        ).split()
        return {n: self.options[n] for n in names if n in self.options}


def save_candles(
    df: DataFrame,
    policy: str = "keep_first",
    connections: int | None = None,
    kind: str = WIDE,
    misfits: str | None = None,
    **options: str,
) -> int:
    """Candles into a serving table through the `upsert` source.

    The five numbers go as decimals of `kind`, by default one that holds every candle. With a narrower kind, candles
    that do not fit stop the write, unless `misfits` names a Parquet table for them: then they are set aside there and
    their number is returned. `connections` bounds how many tasks write, and so how many connections are open at once.
    """
    df.sparkSession.dataSource.register(UpsertDataSource)
    aside = 0
    if misfits is None:
        out = cast_serving(df, kind)
    else:
        # Read for both parts.
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        out, rest = serving_split(df, kind)
    try:
        if misfits is not None:
            counting, seen = counted(rest, f"misfits_{uuid.uuid4().hex}")
            counting.write.mode("append").parquet(misfits)
            aside = count_of(seen)
        if connections:
            out = out.repartition(connections, "datetime", "ticker")
        settings = {"tableName": "CANDLES", "keys": "DATETIME, TICKER", "policy": policy, **options}
        out.write.format("upsert").mode("append").options(**settings).save()
    finally:
        if misfits is not None:
            df.unpersist()
    return aside


def candle_database(
    policy: str = "replace", connections: int | None = None, **options: str
) -> Callable[[DataFrame, int], None]:
    """Sink for `start_candles`: upserts each batch into a serving table; for the options see `save_candles`."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        save_candles(batch, policy, connections, **options)

    return sink
