"""Fill-in-the-middle texts, put together by a secondary sort.

A document is cut into units (lines), and these into a prefix, a middle and a suffix by the digest of its number. Its
output has the parts behind their marks in another order: `<P>`prefix`<S>`suffix`<M>`middle (psm) or
`<S>`suffix`<P>`prefix`<M>`middle (spm). Documents that are empty or hold a mark stay plain.

1. `pieces`: each part leaves its task in pieces of whole units, keyed by document and by position in the output.
2. One exchange on the document, each partition sorted by document and position (for a DataFrame, what
   repartitionAndSortWithinPartitions is for an RDD): the pieces of a document pass by one after the other, and digests
   or texts grow with them.
3. For restoration the same stream is parsed. A mark at the start of a piece says which part begins; pieces without
   their marks are sorted once more, by their place in the text, in the partition they are in. A second stream then
   digests the restored text.

The key is a digest of the document's number and text, so it is the same whenever a task is run again, and rows that
share a number, or have none, are spread out. Equal rows of a batch go as one, with their number.

Defined cases: null text is empty; an empty text is plain and has one empty piece and no units. A null number counts as
the text `null` in the digest. Each of several rows with the same number, or the same text, gives a row. A unit longer
than PIECE_BYTES is cut inside; no piece is larger. Columns other than the number and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the parts.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
# The order of the parts in a text.
_TEXT_ORDER = {"prefix": 0, "middle": 1, "suffix": 2}
SEED = 7
PIECE_BYTES = 1 << 18
# Rows and bytes that a stream hands on at once.
_ROWS, _BYTES = 8192, 4 << 20

_START, _PIECE, _END = range(3)


def cuts(data: bytes, number: object, seed: int = SEED, fim_percent: int = 100, spm_percent: int = 50) -> tuple[int, str, int, int]:
    """Number of units, form, and the bytes after which the prefix and the middle end (0 and 0 if plain)."""
    n = data.count(b"\n") + bool(data and data[-1] != 10)
    digest = hashlib.sha256(f"{seed}:{'null' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not data or h3 % 100 >= fim_percent or any(m in data for m in MARKS.values()):
        return n, "plain", 0, 0
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    after = lambda k: 0 if k == 0 else int(ends[k - 1]) + 1 if k <= len(ends) else len(data)
    return n, "spm" if h4 % 100 < spm_percent else "psm", after(first), after(second)


def _slices(data: bytes, start: int, end: int, most: int) -> Iterator[bytes]:
    """A part in pieces that end with a unit, if it is no longer than a piece; one empty piece of an empty part."""
    while end - start > most:
        cut = data.rfind(b"\n", start, start + most) + 1 or start + most
        yield data[start:cut]
        start = cut
    yield data[start:end]


def _chars(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _meta_fields(id_type: str) -> str:
    return f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint"


class _Rows:
    """Rows on their way into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= _ROWS or self.size >= _BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _schema(id_type: pa.DataType, before: str = "", **after: pa.DataType) -> pa.Schema:
    """Fields of what is known of a document, with the binary field `before` them and others `after` them."""
    meta = [("doc_id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    return pa.schema([*([(before, pa.binary())] if before else []), *meta, *after.items()])


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bytes: int = PIECE_BYTES,
    **how: int,
) -> DataFrame:
    """Pieces of the output of every document: `key`, what is known of the document (with its first piece only), `at`,
    its position in the output from 0, `copies`, the equal rows it stands for, and `data`. For `how` see `cuts`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = _Rows(_schema(batch.column(0).type, "key", at=pa.int32(), copies=pa.int64(), data=pa.binary()))
            rows = zip(batch.column(0).to_pylist(), batch.column(1))
            keyed = []
            for number, text in rows:
                data = text.as_py() or b""
                key = hashlib.blake2b(f"{number!r}:".encode() + data, digest_size=16).digest()
                keyed.append((key, number, data))
            copies = Counter(key for key, _, _ in keyed)
            for key, number, data in keyed:
                many = copies.pop(key, 0)
                if not many:
                    continue
                n, form, first, second = cuts(data, number, **how)
                if form == "plain":
                    stream, sizes = _slices(data, 0, len(data), piece_bytes), (None, None)
                else:
                    ranges = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(data))}
                    stream = (
                        MARKS[part] * (i == 0) + s
                        for part in ORDERS[form]
                        for i, s in enumerate(_slices(data, *ranges[part], piece_bytes))
                    )
                    sizes = _chars(data[:first]), _chars(data[first:second])
                meta = (number, n, form, *sizes)
                for at, piece in enumerate(stream):
                    yield from out.add((key, *meta, at, many, piece), len(piece))
                    meta = (None,) * 5
            yield from out.flush()

    plain = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(run, f"key binary, {_meta_fields(id_type)}, at int, copies bigint, data binary")


def in_order(found: DataFrame) -> DataFrame:
    """Pieces dealt out by document, each partition in the order of the output."""
    return found.repartition("key").sortWithinPartitions("key", "at")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces in order, as starts of documents (with what is known of them), pieces and ends (with the number of equal rows)."""
    key, at, copies = None, -1, 0
    for batch in batches:
        for row_key, *meta, row_at, many, data in zip(*(c.to_pylist() for c in batch.columns)):
            if row_key != key:
                if key is not None:
                    yield _END, copies
                key, at, copies = row_key, -1, 0
                yield _START, (key, meta)
            if row_at == 0:
                copies += many
            if row_at != at:  # else the piece of an equal row from another batch
                at = row_at
                yield _PIECE, data
    if key is not None:
        yield _END, copies


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, and `output`, the text to train on."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = _first(batches)
        if first is None:
            return
        out = _Rows(_schema(first.schema.field("doc_id").type, output=pa.binary()))
        for event, what in _events(batches):
            if event == _START:
                parts, meta = [], what[1]
            elif event == _PIECE:
                parts.append(what)
            else:
                text = b"".join(parts)
                for _ in range(what):
                    yield from out.add((*meta, text), len(text))
        yield from out.flush()

    made = in_order(pieces(docs, id_col, text_col, **how)).mapInArrow(run, f"{_meta_fields(id_type)}, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def _first(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The first batch, None if there is none, and all batches."""
    first = next(batches, None)
    return first, batches if first is None else chain([first], batches)


def fim_report(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Form and digests of the output of every document, and of the text restored from it."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = in_order(pieces(docs.select("doc_id", "text"), piece_bytes=piece_bytes))
    streamed = made.mapInArrow(_digest_outputs, f"key binary, {_meta_fields(id_type)}, place bigint, copies bigint, output_sha256 string, data binary")
    again = streamed.sortWithinPartitions("key", "place")
    return again.mapInArrow(_digest_restored, f"{_meta_fields(id_type)}, output_sha256 string, restored_sha256 string")


# Behind all pieces of a document: the row with what is known of it.
_SUMMARY = 1 << 62
_MARKED = {mark: _TEXT_ORDER[part] << 40 for part, mark in MARKS.items()}


def _digest_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests outputs as they pass by; hands their pieces on without marks, with their place in the text."""
    first, batches = _first(batches)
    if first is None:
        return
    after = {"place": pa.int64(), "copies": pa.int64(), "output_sha256": pa.string(), "data": pa.binary()}
    out = _Rows(_schema(first.schema.field("doc_id").type, "key", **after))
    nothing = (None,) * 5
    for event, what in _events(batches):
        if event == _START:
            (key, meta), digest, place = what, hashlib.sha256(), 0
            plain = meta[2] == "plain"
        elif event == _PIECE:
            digest.update(what)
            if not plain and what[:3] in _MARKED:
                place, what = _MARKED[what[:3]], what[3:]
            yield from out.add((key, *nothing, place, None, None, what), len(what))
            place += 1
        else:
            yield from out.add((key, *meta, _SUMMARY, what, digest.hexdigest(), b""))
    yield from out.flush()


def _digest_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests restored texts as their pieces pass by."""
    first, batches = _first(batches)
    if first is None:
        return
    schema = _schema(first.schema.field("doc_id").type, output_sha256=pa.string(), restored_sha256=pa.string())
    out, digest = _Rows(schema), hashlib.sha256()
    for batch in batches:
        for _, *meta, place, copies, output, data in zip(*(c.to_pylist() for c in batch.columns)):
            if place != _SUMMARY:
                digest.update(data)
                continue
            for _ in range(copies):
                yield from out.add((*meta, output, digest.hexdigest()))
            digest = hashlib.sha256()
    yield from out.flush()


def oracle_sql(seed: int = SEED) -> str:
    """The report in DuckDB's SQL."""
    part = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::ubigint"
    return rf"""
    with d as (select doc_id, coalesce(text, '') as text, sha256('{seed}:' || doc_id) as h from documents),
    u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units from d),
    c as (select *, len(units) as n, {part(0)} % (len(units) + 1) as c1, {part(1)} % (len(units) + 1) as c2,
                 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
                      when {part(3)} % 100 < 50 then 'spm' else 'psm' end as form from u),
    p as (select *, array_to_string(units[1:least(c1, c2)], '') as prefix,
                 array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') as middle,
                 array_to_string(units[greatest(c1, c2) + 1:], '') as suffix from c)
    select doc_id, cast(n as bigint) as n, form,
           case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
           case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
           sha256(text) as restored_sha256
    from p"""
