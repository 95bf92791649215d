"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Nothing is trained: ranks come from a rank file whose path is a parameter. The driver reads the file once and
broadcasts the table, whose size is that of the vocabulary.

Defined cases: a null text is empty, an empty text has no ids; repeated rows give repeated results; a text of any
length is taken whole, and a pre-token of n bytes takes O(n log n) steps. Equal ranks merge from the left.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_hash = xxhash.xxh3_64_intdigest

# Entries that a worker remembers of pre-tokens it has met, and their longest length.
MEMO_ENTRIES = 600_000
MEMO_CHARS = 48


class PerfectHash:
    """Distinct byte strings to the slots 0..n-1, one table cell for four keys.

    Keys fall into cells by one hash. A cell holds either a seed that sends its keys to slots of their own or,
    for a single key, the slot itself as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.n_cells = max(1, self.n // 4)
        cells: list[list[bytes]] = [[] for _ in range(self.n_cells)]
        for key in keys:
            cells[_hash(key) % self.n_cells].append(key)
        self.seeds = [0] * self.n_cells
        taken = bytearray(self.n)
        order = sorted(range(self.n_cells), key=lambda c: -len(cells[c]))
        for c in order:
            members = cells[c]
            if len(members) < 2:
                continue
            seed = 1
            while True:
                slots = {_hash(key, seed) % self.n for key in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[c] = seed
            for s in slots:
                taken[s] = 1
        free = iter([s for s in range(self.n) if not taken[s]])
        for c in order:
            if len(cells[c]) == 1:
                self.seeds[c] = -1 - next(free)

    def slot(self, key: bytes) -> int:
        """The slot of a member; an arbitrary one for any other string."""
        seed = self.seeds[_hash(key) % self.n_cells]
        return -1 - seed if seed < 0 else _hash(key, seed) % self.n


class Vocabulary:
    """Ranks of byte strings behind a perfect hash, and the strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.table = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ranks: list[int] = [0] * len(ranks)
        for key, rank in ranks.items():
            slot = self.table.slot(key)
            self.keys[slot], self.ranks[slot] = key, rank
        self.ranks_of_parts = ranks
        self.pieces: dict[int, bytes] = {rank: key for key, rank in ranks.items()}

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a base64 string and a rank in each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def rank(self, key: bytes) -> int | None:
        slot = self.table.slot(key)
        return self.ranks[slot] if self.keys[slot] == key else None

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank(piece)
        return [whole] if whole is not None else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Joins the neighbours of the lowest rank, the leftmost first, until none is left.

        A heap entry is one number: the rank, the start of the left part, the end of the right part. It is out of
        date if these two no longer are neighbours with those ends.
        """
        n, rank = len(piece), self.ranks_of_parts.get
        wide = n.bit_length()
        low = (1 << wide) - 1
        end = list(range(1, n + 1))  # of the part that starts here; 0 if none does
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                heap.append((r << wide | i) << wide | (i + 2))
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop, i = entry & low, entry >> wide & low
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = rank(piece[i : end[stop]])
                if r is not None:
                    heappush(heap, (r << wide | i) << wide | end[stop])
            k = before[i]
            if k >= 0:
                r = rank(piece[k:stop])
                if r is not None:
                    heappush(heap, (r << wide | k) << wide | stop)
        out, i = [], 0
        while i < n:
            found = rank(piece[i : end[i]])
            if found is None:
                raise ValueError(f"the vocabulary lacks the byte {piece[i : end[i]]!r}")
            out.append(found)
            i = end[i]
        return out


class Encoder:
    """Texts to ids and back, with a bounded memory of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.memo: dict[str, bytes] = {}  # ids as numbers of four bytes
        known = vocabulary.pieces
        self.pieces = pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        pieces, memo, to_ids = self.split(text), self.memo, self.vocabulary.encode_piece
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        try:
            return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32)
        except KeyError:
            pass
        out: list[bytes] = []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = array("i", to_ids(piece.encode())).tobytes()
                if len(piece) <= MEMO_CHARS:
                    memo[piece] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids))

    def decode_lists(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids; none of a null list."""
        ends = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), dtype=np.int64)
        pieces = self.pieces.take(lists.flatten())
        if pieces.null_count:
            raise KeyError("an id is not in the vocabulary")
        # The pieces of all lists lie one behind the other; a list's bytes end where its last piece does.
        _, places, data = pieces.buffers()
        cuts = np.frombuffer(places, np.int64)[ends] if len(pieces) else np.zeros(len(ends), np.int64)
        joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cuts), data])
        return joined.cast(pa.binary())


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast vocabulary with a name that workers know it by."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode_texts(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `ids`, the token ids of the whole text; no special tokens."""
    shared = _Shared(df.sparkSession, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            rows = [encode(t.as_py() or "") for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    plain = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column, the ids, and `decoded`, the bytes they stand for; null ids decode to no bytes."""
    shared = _Shared(df.sparkSession, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared).decode_lists
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode(batch.column(1))], names=[id_col, "ids", "decoded"])

    plain = df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded binary")


def ids_digest(ids: str | Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids, " "), 256)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encodes and decodes every document; counts and digests of both."""
    coded = decode_ids(encode_texts(docs, vocabulary), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        ids_digest("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
