"""WARC archives: written by Spark tasks, read back by a Python data source.

`write_archives` writes a record per row into gzip archives, a member a record, and returns the list of the archives.
Files of failed or repeated attempts are not in the list, so they are never read. `read_archives` plans ranges of the
files as partitions. In each member the headers are inflated first; record types and headers that the query filters on
are pushed down and tested there. Only then, and only if asked for, is the payload inflated. A member that names its
own length in the gzip header is left with a seek; archives without such lengths and plain ones are read too.

Defined cases: a null payload is empty; a null url has no header; a null id gives a record without a key and null
columns when read. With `dedupe`, all rows with the smallest id of a payload are responses and the others revisits; if
all their ids are null, all are responses. Repeated rows are repeated records. No rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)

from tickbars import files
from tickbars.llm.tools import stored

DATE = "2024-01-01T00:00:00Z"
# Payloads of at least so many bytes are written once and revisited.
MIN_REVISIT_BYTES = 0
# A payload that more than one record in so many holds is hot.
HOT = 1000
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
LEVEL = 6
_KEY = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """SHA-1 in base 32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def member(data: bytes) -> bytes:
    """A gzip member whose extra field SL holds the length of the member."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """The bytes of a WARC record; fields without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def page_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """The record of a page: a response, or a revisit that has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<{_KEY}{key}>" if key is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_KEY}{refers_to}>"}
    return record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def with_revisits(pages: DataFrame, dedupe: bool = True) -> DataFrame:
    """Rows (id, url, payload) with `first_id`: the smallest id of equal payloads, where it is another one.

    Payloads are equal if their length and SHA-256 are. Only digests with more than one row take part in the join, and
    those of more than one row in HOT, fewer than HOT digests, are told to all tasks: rows that hold one are spread out
    by their id and url instead of meeting in the task of their digest.
    """
    if not dedupe:
        return pages.withColumn("first_id", F.lit(None).cast(pages.schema["id"].dataType))
    keyed = pages.withColumn("sha", F.sha2("payload", 256))
    large = keyed.where(F.octet_length("payload") >= MIN_REVISIT_BYTES)
    counts = large.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    shared = stored(counts.where("n > 1"), "digests")
    is_hot = F.col("n") * HOT > pages.count()
    hot = shared.where(is_hot).select("sha", F.col("least").alias("hot_least"), F.lit(True).alias("hot"))
    rest = shared.where(~is_hot).select(F.col("sha").alias("key"), "least")
    told = keyed.join(F.broadcast(hot), "sha", "left")
    spread = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    met = told.withColumn("key", F.when(F.col("hot"), spread).otherwise(F.col("sha"))).join(rest, "key", "left")
    least = F.when(F.col("hot"), F.col("hot_least")).otherwise(F.col("least"))
    other = F.col("id").isNull() | (F.col("id") != least)
    return met.select("id", "url", "payload", F.when(other, least).alias("first_id"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    dedupe: bool = True,
) -> DataFrame:
    """Writes one record a row below `folder`, which all executors reach; gives the archives (file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done: list[dict] = []
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in range(4)]
            for key, url, payload, first in zip(*columns):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Filename": name}
                    size += out.write(member(record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))
                first = first.as_py()
                size += out.write(member(page_record(key.as_py(), url.as_py(), payload.as_py(), first, first is not None)))
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append({"file": name, "records": n, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"file": name, "records": n, "bytes": size})
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema)

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = with_revisits(plain, dedupe).withColumns({c: F.col(c).cast("string") for c in ("id", "first_id")})
    return stored(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "archives")


# ---------------------------------------------------------------- reading

COLUMNS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
_SCHEMA = ", ".join([*(f"{c} string" for c in COLUMNS), "payload_bytes bigint", "payload binary"])
_ARROW = pa.schema([*((c, pa.string()) for c in COLUMNS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


@dataclass
class Range(InputPartition):
    """Members of a file that start in a range of its bytes."""

    file: str
    start: int
    end: int


class _Bytes:
    """Reads at any place of a file, a large piece at a time."""

    PIECE = 1 << 20

    def __init__(self, source):
        self.source, self.size, self.base, self.held = source, source.size(), 0, b""

    def at(self, start: int, n: int) -> bytes:
        if start < self.base or start + n > self.base + len(self.held):
            self.source.seek(min(start, self.size))
            self.base, self.held = start, self.source.read(max(n, self.PIECE))
        return self.held[start - self.base : start - self.base + n]


class _Stream:
    """The content of a record from its first byte, inflated no further than asked for."""

    def __init__(self, data: _Bytes, start: int, gz: bool):
        self.data, self.place, self.out = data, start, bytearray()
        self.inflate = zlib.decompressobj(31) if gz else None

    def more(self, n: int) -> bool:
        if self.inflate is None:
            piece = self.data.at(self.place, n)
            self.place += len(piece)
        else:
            if self.inflate.eof:
                return False
            given = self.inflate.unconsumed_tail
            if not given:
                given = self.data.at(self.place, 1 << 16)
                self.place += len(given)
            if not given:
                return False
            piece = self.inflate.decompress(given, n)
            if not piece and not self.inflate.eof:
                return True
        self.out += piece
        return bool(piece)

    def until(self, mark: bytes, start: int) -> int:
        """Where the mark ends, inflating up to it; -1 if it does not come."""
        seen = start
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(start, len(self.out) - len(mark))
            if not self.more(2048):
                return -1
        return at + len(mark)

    def upto(self, n: int) -> None:
        while len(self.out) < n and self.more(n - len(self.out)):
            pass

    def end(self) -> int:
        """The place after a gzip member, inflating the rest of it piece by piece."""
        while not self.inflate.eof:
            del self.out[:]
            if not self.more(1 << 20) and not self.inflate.eof:
                return self.data.size
        return self.place - len(self.inflate.unused_data)


def _fields(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _own_length(head: bytes) -> int | None:
    """The length that a gzip header names in its field SL."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, stop = 12, 12 + struct.unpack("<H", head[10:12])[0]
    while at + 4 <= min(stop, len(head)):
        name, n = struct.unpack("<2sH", head[at : at + 4])
        if name == b"SL" and n == 8:
            return struct.unpack("<Q", head[at + 4 : at + 12])[0]
        at += 4 + n
    return None


def _starts(data: _Bytes, place: int) -> bool:
    """Whether a member with a record starts here."""
    try:
        return zlib.decompressobj(31).decompress(data.at(place, 512), 5) == b"WARC/"
    except zlib.error:
        return False


def _first(data: _Bytes, start: int, end: int) -> int:
    """Where the first member of a range starts, or its end."""
    mark = b"\x1f\x8b\x08"
    place = start
    while place < end:
        piece = data.at(place, min(1 << 16, end - place + len(mark) - 1))
        at = piece.find(mark)
        if at < 0:
            place += max(1, len(piece) - len(mark) + 1)
        elif _starts(data, place + at):
            return place + at
        else:
            place += at + 1
    return end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.files = json.loads(options["files"]) if "files" in options else None
        self.manifest = options.get("manifest")
        self.payload = options.get("payload", "skip")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        if self.payload not in ("skip", "check", "read"):
            raise ValueError("payload is one of skip, check, read")
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters):
        """Takes equality, membership and prefixes of header columns; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in COLUMNS:
                yield f
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append(("in", COLUMNS[column], (f.value,)))
            elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append(("in", COLUMNS[column], tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", COLUMNS[column], (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append(("has", COLUMNS[column], ()))
            else:
                yield f

    def _listed(self, fs: pafs.FileSystem, base: str) -> list[tuple[str, int]]:
        if self.manifest is not None:
            import pyarrow.dataset as ds

            own, path = pafs.FileSystem.from_uri(self.manifest)
            found = [f.path for f in own.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
            table = ds.dataset(found, filesystem=own).to_table(["file", "bytes"]) if found else pa.table({"file": [], "bytes": []})
            return list(zip(table["file"].to_pylist(), table["bytes"].to_pylist()))
        if self.files is not None:
            infos = fs.get_file_info([f"{base}/{name}" for name in self.files])
        else:
            infos = fs.get_file_info(pafs.FileSelector(base))
        good = [i for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        return [(i.path.rpartition("/")[2], i.size) for i in good]

    def partitions(self) -> list[Range]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        out = []
        for name, size in sorted(self._listed(fs, base)):
            # In a plain archive a payload can look like a record, so it is read from its start; payloads are skipped.
            step = self.split if name.endswith(".gz") else max(1, size)
            out += [Range(name, start, min(size, start + step)) for start in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for kind, name, values in self.tests:
            value = fields.get(name)
            if value is None or (kind == "in" and value not in values) or (kind == "starts" and not value.startswith(values[0])):
                return False
        return True

    def _row(self, stream: _Stream, body: int, fields: dict[str, str]) -> dict:
        row = {column: fields.get(name) for column, name in COLUMNS.items()}
        row |= {"payload_bytes": None, "payload": None}
        length = int(fields.get("content-length", 0))
        http = fields.get("content-type", "").startswith("application/http")
        start = stream.until(b"\r\n\r\n", body) if http and length else body
        if start < 0 or start > body + length:
            return row
        stated = _fields(bytes(stream.out[body:start])).get("content-length") if http else None
        row["payload_bytes"] = int(stated) if stated and stated.isdigit() else None
        if fields.get("warc-type") == "revisit" or self.payload == "skip":
            return row
        stream.upto(body + length)
        payload = bytes(stream.out[start : body + length])
        digest = fields.get("warc-payload-digest", "")
        if len(stream.out) < body + length or (digest.startswith("sha1:") and digest[5:] != digest_of(payload)):
            raise ValueError(f"record {row['record_id']} is damaged")
        return row | {"payload_bytes": len(payload), "payload": payload if self.payload == "read" else None}

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, base = pafs.FileSystem.from_uri(self.folder)
        gz = partition.file.endswith(".gz")
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(f"{base}/{partition.file}") as source:
            data = _Bytes(source)
            place = _first(data, partition.start, partition.end) if gz else partition.start
            while place < partition.end:
                stream = _Stream(data, place, gz)
                body = stream.until(b"\r\n\r\n", 0)
                if body < 0:
                    break
                fields = _fields(bytes(stream.out[: body - 4]))
                if self._wanted(fields):
                    rows.append(self._row(stream, body, fields))
                    size += 500 + len(rows[-1]["payload"] or b"")
                    if size > 8 << 20 or len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if gz:
                    known = _own_length(data.at(place, 64))
                    place = place + known if known else stream.end()
                else:
                    place += body + int(fields.get("content-length", 0)) + 4
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcSource(DataSource):
    """`format("warc")`: options path, manifest or files, payload (skip, check or read), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, manifest: str | None = None, payload: str = "skip") -> DataFrame:
    """The records below a folder: all archives, or those that a manifest lists."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", payload)
    if manifest is not None:
        reader = reader.option("manifest", manifest)
    return reader.load(folder)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back, and tells what each record is; responses are checked byte by byte."""
    spark = pages.sparkSession
    folder = files.new_dir(spark, "warc")
    written = write_archives(pages, folder)
    manifest = written.inputFiles()
    where = manifest[0].rpartition("/")[0] if manifest else None
    found = read_archives(spark, folder, where, "check").where(F.col("warc_type").isin("response", "revisit"))
    key = lambda c: F.regexp_extract(c, f"^<{_KEY}(.*)>$", 1)
    id_type = pages.schema["page_id"].dataType
    as_id = lambda c: F.when(F.startswith(c, F.lit(f"<{_KEY}")), key(c)).cast(id_type)
    return found.select(
        as_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.replace(F.col("payload_digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        as_id(F.col("refers_to")).alias("refers_to"),
    )
