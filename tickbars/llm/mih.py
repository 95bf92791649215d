"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

`fit` learns on a bounded sample: principal axes, several rotations that bring the projections close to the corners of a
cube (iterative quantisation, each from another start), and the Hamming radius that holds the wanted part of the sample's
own neighbours. `build_index` gives every vector its code. `search` takes the queries in blocks of bounded size; each task
splits the codes of its vectors into substrings with a bucket table each, one for as many vectors as CHUNK_ROWS. A code
within radius r of the query is within r // m of it in one of m substrings (with the remainder, in one of the first
substrings), so probing those buckets finds every code within the radius. What is within it is ranked by the distance
of the vectors, in double precision.

One rotation gives as many bits as there are axes, too few to tell a tenth neighbour from the rest where distances are
nearly alike; ROTATIONS of them give codes of up to 256 bits, within whose radius few others are.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold a null or non-finite component
take no part, as queries and as candidates; nor do rows without an id. A query's own row is no candidate; other rows of
its id are, also equal ones. Where a task holds fewer than k vectors within the radius, it widens it until it has k or
all. Equal distances go to the smaller id; repeated query rows are answered one by one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars import files
from tickbars.llm.tools import map_batches, stored

K = 10
# Rows that the codes are learnt from, and how many of them are asked to set the radius.
SAMPLE_ROWS = 8_192
PROBE_ROWS = 512
# Part of the sample's neighbours that the radius has to hold.
HOLD = 0.97
ROUNDS = 30
ROTATIONS = 4
# Queries that are sent to the executors at once.
QUERY_BLOCK = 4_096
# Vectors that share bucket tables.
CHUNK_ROWS = 65_536
PART_BITS = 8
# Axes that a rotation turns.
MAX_BITS = 64


@dataclass(frozen=True)
class Codes:
    """Projection to the rotated axes; bit i of a code is 1 on the positive side of axis i."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    @property
    def words(self) -> int:
        return -(-self.bits // 64)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of words of 64 bits for each vector."""
        padded = np.zeros((len(vectors), 64 * self.words), np.uint8)
        padded[:, : self.bits] = (vectors - self.mean) @ self.axes > 0
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(-1, self.words)


def bits_apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """In how many bits each of some codes differs from another."""
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def usable(vec: str | Column, length: int | None = None) -> Column:
    """Whether a vector takes part."""
    v = F.col(vec) if isinstance(vec, str) else vec
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.size(v) == length if length is not None else F.size(v) > 0
    return F.coalesce(v.isNotNull() & fits & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _usual_length(vectors: DataFrame) -> int | None:
    found = vectors.where(usable("vector")).groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    best = found.orderBy(F.desc("rows"), F.desc("n")).first()
    return best["n"] if best else None


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def _rotation(flat: np.ndarray, seed: int) -> np.ndarray:
    """A rotation after which the signs of the rows say most of them."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((flat.shape[1], flat.shape[1])))
    for _ in range(ROUNDS):
        corners = np.where(flat @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(corners.T @ flat)
        turn = (u @ vt).T
    return turn


def fit(sample: np.ndarray, k: int = K, seed: int = 7) -> Codes:
    """Codes and radius from a sample of vectors, one a row."""
    n, length = sample.shape
    bits = min(MAX_BITS, length)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    turned = np.concatenate([axes @ _rotation(flat, seed + i) for i in range(ROTATIONS)], axis=1)
    plain = Codes(mean, turned, turned.shape[1])
    codes, seen = plain.of(sample), []
    for i in range(min(n, PROBE_ROWS)):
        d = distances(sample, sample[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, n - 1)]
        seen.append(bits_apart(codes[near], codes[i]))
    found = np.concatenate(seen) if seen else np.empty(0)
    return Codes(mean, turned, int(np.quantile(found, HOLD, method="higher")) if len(found) else plain.bits)


def _sampled(vectors: DataFrame) -> np.ndarray:
    """At most SAMPLE_ROWS vectors, those of the smallest hashes of id and vector."""
    at = F.shiftrightunsigned(F.xxhash64("id", "vector"), 2)
    n = vectors.count()
    some = vectors.select(at.alias("at"), "vector").where(F.col("at") <= int(min(1.0, 2 * SAMPLE_ROWS / max(n, 1)) * 2**62))
    rows = some.orderBy("at").limit(SAMPLE_ROWS).collect()
    return np.array([r["vector"] for r in rows], np.float64)


def _plain(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return plain.where(F.col("id").isNotNull())


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Codes | None]:
    """All usable vectors with their codes, written to the shared folder, and what the codes were made with."""
    plain = _plain(vectors, id_col, vec_col)
    length = _usual_length(plain)
    good = plain.where(usable("vector", length)) if length else plain.where(F.lit(False))
    sample = _sampled(good)
    codes = fit(sample) if len(sample) else None

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codes.of(_matrix(batch.column(1), len(codes.mean))).view(np.int64)
        ends = pa.array(np.arange(0, made.size + 1, codes.words, dtype=np.int32))
        listed = pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))
        return pa.RecordBatch.from_arrays([*batch.columns, listed], names=["id", "vector", "code"])

    return stored(map_batches(good, make, "id bigint, vector array<double>, code array<bigint>"), "codes"), codes


class Buckets:
    """The codes of some vectors, a row of words each, by the value of each substring."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes
        self.m = -(-bits // PART_BITS)
        parts = codes.view(np.uint8)[:, : self.m]
        self.orders = [np.argsort(parts[:, p], kind="stable") for p in range(self.m)]
        self.sizes = [np.bincount(parts[:, p], minlength=256) for p in range(self.m)]
        self.ends = [np.cumsum(s) for s in self.sizes]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from this one in at most `radius` bits."""
        each, more = divmod(radius, self.m)
        own = code.view(np.uint8)
        marked, left = np.zeros(len(self.codes), bool), len(self.codes)
        for p in range(self.m):
            near = each if p <= more else each - 1
            if near < 0 or not left:
                break
            probed = np.bitwise_count(np.arange(256, dtype=np.uint8) ^ own[p]) <= near
            keys = np.flatnonzero(probed)
            if len(keys) <= 16:
                for k in keys.tolist():
                    marked[self.orders[p][self.ends[p][k] - self.sizes[p][k] : self.ends[p][k]]] = True
            else:
                marked[self.orders[p][np.repeat(probed, self.sizes[p])]] = True
            left = len(marked) - np.count_nonzero(marked)
        rows = np.flatnonzero(marked) if left else np.arange(len(marked))
        return rows[bits_apart(self.codes[rows] if left else self.codes, code) <= radius]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to CHUNK_ROWS rows or a little more."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        few = scores <= np.partition(scores, k - 1)[k - 1]
        ids, scores = ids[few], scores[few]
    order = np.lexsort((ids, scores))[:k]
    return ids[order], scores[order]


def search(index: DataFrame, codes: Codes | None, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of the index for each query (id, vector): query_id, rank from 1, vec_id, score."""
    spark = index.sparkSession
    path = files.new_dir(spark, "nearest")
    schema = "query_no int, query_id bigint, vec_id bigint, score double"
    result = "query_id bigint, rank int, vec_id bigint, score double"

    def answer(block: list) -> None:
        names = np.array([r["id"] for r in block], np.int64)
        points = np.array([r["vector"] for r in block], np.float64)
        shared = spark.sparkContext.broadcast((names, points, codes.of(points)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points, asked = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(names)
            for table in _chunks(batches):
                ids = table.column(0).chunk(0).to_numpy()
                vectors = _matrix(table.column(1).chunk(0), len(codes.mean))
                words = table.column(2).chunk(0).flatten().to_numpy().view(np.uint64).reshape(-1, codes.words)
                buckets = Buckets(words, codes.bits)
                for i, name in enumerate(names.tolist()):
                    radius = codes.radius
                    while True:
                        rows = buckets.within(asked[i], radius)
                        if np.count_nonzero(ids[rows] != name) >= k or radius >= codes.bits:
                            break
                        radius = min(codes.bits, radius + PART_BITS)
                    old_ids, old = best[i]
                    new = distances(vectors[rows], points[i])
                    # One more, as the query's own row may be among them.
                    best[i] = _nearest(np.append(old_ids, ids[rows]), np.append(old, new), k + 1)
            counts = [len(x) for x, _ in best]
            numbers = np.repeat(np.arange(len(names), dtype=np.int32), counts)
            found = [np.concatenate(x) for x in zip(*best)]
            columns = [pa.array(numbers), pa.array(names[numbers]), pa.array(found[0]), pa.array(found[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_no", "query_id", "vec_id", "score"])

        found = index.mapInArrow(run, schema)
        # The query's own row: of rows of its id and no distance, which can't be told apart, one.
        same = ((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)).alias("same")
        order = Window.partitionBy("query_no").orderBy("score", "vec_id")
        own = Window.partitionBy("query_no", "same").orderBy("score", "vec_id")
        others = found.select("*", same).withColumn("n", F.row_number().over(own)).where("not (same and n = 1)")
        ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)

    block: list = []
    length = len(codes.mean) if codes else None
    for row in queries.where(usable("vector", length)).toLocalIterator() if codes else ():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            answer(block)
            block = []
    if block:
        answer(block)
    elif not files.children(spark, path):
        return spark.createDataFrame([], result)
    return spark.read.schema(result).parquet(path)


def neighbours(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, among all rows."""
    index, codes = build_index(vectors)
    queries = _plain(vectors.where(F.col("vec_id") % every == 0), "vec_id", "embedding")
    return search(index, codes, queries, k)
